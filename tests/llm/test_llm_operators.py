"""Each operator against a plain version written here, and its defined results for odd input."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rowloom.llm import decontaminate, language, licences, lines, lm, mtree, packing, pii, quality, simhash
from rowloom.session import materialize

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id bigint, text string"


def low(text):
    return (text or "").translate(LOWER)


# -- line dedup

def test_lines_follow_site_shares(spark):
    rows = [(i, "a.org" if i < 40 else "b.org", f" menu \nown {i}\n\nfoot" if i % 2 else f"menu\nown {i}", 1, 2) for i in range(60)]
    rows += [(100, None, "menu\nx", 0, 0), (101, "a.org", None, 0, 0), (102, "a.org", "", 0, 0), (103, "c.org", "alone", 0, 0), (103, "c.org", "alone", 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, host string, text string, _site int, _left int")
    made = lines.drop_boilerplate(docs, ratio=0.4, min_pages=5, n_lines="all", n_dropped="gone")
    assert made.columns == [*docs.columns, "all", "gone"]
    counts, totals = Counter(), Counter()
    for _, host, text, *_ in rows:
        if host is not None and text is not None:
            totals[host] += 1
            counts.update({(host, x.strip(" \t\r")) for x in text.split("\n")} - {(host, "")})
    bad = {k for k, n in counts.items() if n >= 5 and n > 0.4 * totals[k[0]]}
    assert ("a.org", "menu") in bad and ("c.org", "alone") not in bad

    def want(host, text):
        if host is None or text is None:
            return text
        return "\n".join(x for x in text.split("\n") if (host, x.strip(" \t\r")) not in bad)

    assert sorted((r["doc_id"], r["text"] or "") for r in made.collect()) == sorted((i, want(h, t) or "") for i, h, t, *_ in rows)
    assert lines.drop_boilerplate(docs.limit(0)).count() == 0


def test_lines_of_a_very_long_page(spark):
    """A page of many lines, all of them boilerplate, takes time in proportion to them."""
    shared = [f"line {i}" for i in range(40_000)]
    rows = [(i, "h", "\n".join([*shared, f"own {i}", *shared[:3]])) for i in range(6)]
    rows += [(10 + i, "tie", "half" if i < 5 else f"x {i}") for i in range(10)]
    made = lines.drop_boilerplate(spark.createDataFrame(rows, "doc_id bigint, host string, text string"), ratio=0.5, n_dropped="gone")
    found = {r["doc_id"]: (r["text"], r["gone"]) for r in made.collect()}
    assert all(found[i] == (f"own {i}", 40_003) for i in range(6))
    assert all(found[10 + i] == ("half" if i < 5 else f"x {i}", 0) for i in range(10))


def test_site_of(spark):
    found = spark.createDataFrame([("HTTPS://WWW.Ab.example.com:80/x?y",), ("no address",), (None,)], "url string").select(lines.site_of(F.col("url")).alias("h"))
    assert [r["h"] for r in found.collect()] == ["ab.example.com", None, None]


# -- licences

def test_licences(spark):
    mit = next(t for n, t in licences.KNOWN if n == "MIT")
    rows = [
        (1, "Copyright (c) 1999 Some One\n\n" + mit.upper().replace("SUBLICENSE", "sub-licence")), (2, mit[:-30]), (3, "x\nReleased under the MIT Licence!\ny"),
        (4, None), (5, ""), (6, "Copyright 2001 A"), (7, "released\nunder the mit license"), (8, "Released under the MIT License."), (8, "Released under the MIT License."),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    found = sorted((r["doc_id"], r["line"], r["licence"]) for r in licences.scan(docs, licences.known_licences(spark)).collect())
    assert found == [(1, 0, "MIT"), (3, 2, "MIT"), (7, 0, "MIT"), (8, 0, "MIT"), (8, 0, "MIT")]
    assert licences.scan(docs, licences.known_licences(spark).limit(0)).count() == 0
    assert licences.scan(docs.limit(0), licences.known_licences(spark)).count() == 0


# -- language

def test_language(spark):
    words = {"aa": "kata sina mata", "bb": "grzb scholt brmf"}
    random.seed(1)
    text = lambda name: " ".join(random.choice(words[name].split()) for _ in range(20))
    rows = [(i, text(n), n, 0.5) for i, n in enumerate(["aa", "bb"] * 20)] + [(90, None, "aa", 0.1), (91, "123 --", "bb", 0.1), (92, "kata", None, 0.1), (93, "", None, 0.1), (94, "KATA " * 50_000, None, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double")
    model = language.train(docs)
    found = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    assert len(found) == len(rows)
    for i, _, n, _ in rows[:40]:
        assert found[i]["lang_pred"] == n and found[i]["score"] > 0.9
    assert [(found[i]["lang_pred"], found[i]["score"]) for i in (90, 91, 93)] == [("und", 0.0)] * 3
    assert found[92]["lang_pred"] == found[94]["lang_pred"] == "aa"
    empty = language.train(docs.limit(0))
    assert {r["lang_pred"] for r in language.predict(docs, empty).collect()} == {"und"}
    assert language.predict(docs.limit(0), model).count() == 0


def test_language_counts_match_a_plain_version(spark):
    texts = ["Ab c1d", "éa", "x", "İk  b", "ab ab"]
    docs = spark.createDataFrame([(i, t, "l") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    model = language.train(docs, buckets=1 << 10, orders=(2,))
    counts = Counter()
    for t in texts:
        kept = " " + " ".join(re.findall(r"[^\W\d_̀-ͯ]+[̀-ͯ]*[^\W\d_]*", t.lower())) + " "
        for a, b in itertools.pairwise(kept):
            clean = np.array([ord(a), ord(b)], dtype=np.uint32)
            counts[int(language._hashed(clean, 2, 1 << 10)[0])] += 1
    total = sum(counts.values())
    logs = np.full(1 << 10, 0.5)
    for k, n in counts.items():
        logs[k] += n
    assert np.allclose(model.logs[:, 0], np.log(logs / logs.sum())) and total == sum(counts.values())


def test_language_ties_go_to_the_smaller_name(spark):
    docs = spark.createDataFrame([(1, "abc", "zz"), (2, "abc", "mm")], "doc_id bigint, text string, lang string")
    assert {r["lang_pred"] for r in language.predict(docs, language.train(docs)).collect()} == {"mm"}


def test_language_held_out_accuracy(spark, sf):
    from rowloom.llm.queries import language_id

    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = language_id(spark, sf).join(truth, "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows) > 0


# -- language model

def plain_scores(docs, held, order, mass):
    counts = [Counter() for _ in range(order)]
    words = {i: [*re.findall("[^\x20\x09-\x0d]+", low(t)), None] for i, t in docs}
    for i, own in words.items():
        if not held(i):
            for k in range(order):
                counts[k].update(tuple(own[j : j + k + 1]) for j in range(len(own) - k))
    n, v = sum(counts[0].values()), len(counts[0])

    def p(h, w):
        if not h:
            return (counts[0][(w,)] + 0.5) / (n + 0.5 * (v + 1))
        lower, c = p(h[1:], w), counts[len(h) - 1][h]
        return (counts[len(h)][(*h, w)] + mass * lower) / (c + mass)

    for i, own in words.items():
        base = sum(math.log10(p((), w)) for w in own)
        yield i, (len(own), sum(counts[0][(w,)] > 0 for w in own), n, base, sum(math.log10(p(tuple(own[max(0, j - order + 1) : j]), w)) for j, w in enumerate(own)))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_against_plain_version(spark, order, tmp_path):
    random.seed(order)
    docs = [(i, " ".join(random.choice(["a", "B", "b", "longer-word", "é", "😀x"]) for _ in range(random.randint(0, 12)))) for i in range(80)]
    docs += [(80, None), (81, ""), (82, " \t\n"), (83, "a b " * 30_000)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(path)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    found = lm.score(spark.read.parquet(path), fold, order=order, mass=3.0, block_bytes=300, shard_bytes=400).collect()
    want = dict(plain_scores(docs, held, order, 3.0))
    assert len(found) == len(docs)
    for r in found:
        assert r["held_out"] == held(r["doc_id"])
        got = (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"])
        assert got == pytest.approx(want[r["doc_id"]], rel=1e-9)


def test_lm_edges(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], DOCS).coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path)
    nothing = lm.score(docs, F.lit(True)).collect()
    assert len(nothing) == 3 and {(r["train_tokens"], r["base_score"], r["score"]) for r in nothing} == {(0, 0.0, 0.0)}
    twice = [r for r in lm.score(docs, F.col("doc_id") == 2).collect() if r["doc_id"] == 1]
    assert len(twice) == 2 and len(set(twice)) == 1
    assert lm.score(docs.filter("doc_id > 5"), F.lit(False)).count() == 0


def test_lm_probabilities_sum_to_one():
    texts = [b"a b a c", b"b a", b"c"]
    words, edges = lm.tokens(texts)
    counts = [np.unique(keys, return_counts=True)[1] for _, keys in lm.ngrams(words, edges, 2)]
    machine = lm.Automaton(words, edges, 2, counts, words.size, counts[0].size, 2.0)
    for state in range(len(machine.fail)):
        total, rest = 0.0, 1.0
        for word in range(machine.width):
            s, cost = state, 0.0
            while (arc := machine.arcs.get(s * machine.width + word)) is None:
                cost += machine.fail_weight[s]
                s = machine.fail[s]
            total += 10 ** (cost + machine.weight[arc])
        rest = 10 ** (machine.unknown + (machine.fail_weight[state] if state else 0.0))
        assert total + rest == pytest.approx(1.0)


# -- packing

def least_padding(lengths, buckets):
    sizes = sorted(set(lengths))
    costs = []
    for k in range(1, min(buckets, len(sizes)) + 1):
        for inner in itertools.combinations(sizes[:-1], k - 1):
            edges = [*inner, sizes[-1]]
            costs.append(sum(min(e for e in edges if e >= x) - x for x in lengths))
    return min(costs)


def test_boundaries_are_optimal():
    random.seed(3)
    for _ in range(60):
        lengths = [random.randint(0, 40) for _ in range(random.randint(1, 9))]
        counts = Counter(lengths)
        for buckets in (1, 2, 3, 5):
            edges = packing.boundaries(list(counts), list(counts.values()), buckets)
            assert len(edges) <= buckets and edges == sorted(set(edges))
            assert sum(min(e for e in edges if e >= x) - x for x in lengths) == least_padding(lengths, buckets)
    assert packing.boundaries([], [], 4) == []


def test_packing(spark):
    random.seed(4)
    rows = [(i % 95, " ".join(["w"] * random.choice([0, 1, 3, 7, 50, 51])), 1, 2) for i in range(100)] + [(200, None, 0, 0), (None, "a b", 0, 0), (201, "w " * 5_000, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, bucket int, part int").repartition(5)
    found = packing.pack(docs, buckets=3, budget=100).collect()
    assert len(found) == len(rows)
    assert sorted(r["n_tokens"] for r in found) == sorted(len((t or "").split()) for _, t, *_ in rows)
    for (_, group) in itertools.groupby(sorted(found, key=lambda r: r["bucket"]), key=lambda r: r["bucket"]):
        own = sorted(group, key=lambda r: (r["batch"], r["place"]))
        room = max(1, 100 // max(1, own[0]["bucket_length"]))
        assert [(r["batch"], r["place"]) for r in own] == [divmod(k, room) for k in range(len(own))]
        assert all(r["n_tokens"] <= r["bucket_length"] for r in own)
        ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in own]
        assert ids == sorted(ids)
    assert packing.pack(docs.limit(0)).count() == 0


def test_rounded_lengths(spark):
    for digits in (3, 10):
        rows = spark.range(5000).select("id", packing.rounded(F.col("id"), digits).alias("r")).collect()
        for r in rows:
            step = 1 << max(0, int(r["id"]).bit_length() - digits) if r["id"] else 1
            assert r["r"] == -(-r["id"] // step) * step


# -- simhash

def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", low(text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in ids}


def test_fingerprints(spark):
    texts = ["", None, " \n", "One", "one two", "a b c", "A b c d é 😀", "x " * 70_000 + "y", *(" ".join(random.choices("abcdef", k=30)) for _ in range(50))]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    found = docs.select("doc_id", simhash.as_hex(simhash.fingerprint(F.col("text"))).alias("f"), F.xxhash64("text").alias("x")).collect()
    for r in found:
        assert r["f"] == f"{plain_fingerprint(texts[r['doc_id']]):016x}"
    one = next(r for r in found if texts[r["doc_id"]] == "a b c")
    assert one["f"] == f"{one['x'] & (1 << 64) - 1:016x}"


@pytest.mark.parametrize("most", [2, 7, 1000])
def test_components_are_exact(spark, most):
    random.seed(most)
    prints = {}
    for i in range(200):
        if i % 4 and prints:
            base = random.choice(list(prints.values()))
            for _ in range(random.choice([0, 1, 2, 3, 4])):
                base ^= 1 << random.randrange(64)
            prints[i] = base
        else:
            prints[i] = random.getrandbits(64)
    signed = {i: p - (1 << 64) if p >> 63 else p for i, p in prints.items()}
    rows = spark.createDataFrame([(p,) for p in set(signed.values())], "fp bigint")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(rows, most=most)).collect()}
    want = plain_components(list(prints), prints)
    groups = {}
    for i, c in want.items():
        groups.setdefault(c, set()).add(signed[i])
    made = {}
    for p in set(signed.values()):
        made.setdefault(found.get(p, p), set()).add(p)
    assert sorted(map(sorted, made.values())) == sorted(map(sorted, {frozenset(g) for g in groups.values()}))


def test_signatures_are_not_sent_through_the_driver(spark):
    """A fingerprint has 64 signatures, which the planner sizes as one: the fingerprints look small enough to send."""
    fingerprints = spark.range(5_000).select(F.xxhash64("id").alias("fp")).union(spark.sql("select 0L union all select 5L"))
    made = simhash.links(materialize(fingerprints, "groups"))
    assert (0, 5) in {tuple(r) for r in made.collect()}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_long_chains_become_one_component(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.sql("select 1000L, 1000L"))
    found = simhash.components(chain).collect()
    assert {r["root"] for r in found} == {0} and len(found) == 301


def test_keep_one(spark):
    words = [f"w{i}" for i in range(300)]
    text = " ".join(words)
    near = " ".join([*words[:150], "changed", *words[151:]])
    rows = [(5, text, 1), (3, near, 1), (9, text, 1), (7, "other words here", 1), (7, "other words here", 1), (11, None, 1), (12, "", 1), (None, text, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _gone int")
    prints = [plain_fingerprint(t) for _, t, _ in rows]
    if (prints[0] ^ prints[1]).bit_count() <= 3:
        want = [None, 3, 7, 11]
    else:
        want = [None, 3, 5, 7, 11]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=lambda x: -1 if x is None else x) == want
    assert simhash.keep_one(docs.limit(0)).count() == 0


# -- top-k

def plain_top(rows, k):
    good = sorted({(i, tuple(math.floor(1024 * float(x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    for i, q in good:
        if i % 100 == 0:
            others = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i and len(v) == len(q))
            yield from ((i, rank, j, -s) for rank, (s, j) in enumerate(others[:k], 1))


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6) * rng.choice([0.01, 1, 30])]) for i in range(700)]
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1100, [0.0] * 6), (1200, None), (1201, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1300, [float("nan")] * 6), (1301, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [rows[3], (1400, [1.0, 2.0]), (1401, [3.0, 4.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("length", F.lit("x")).withColumn("shard", F.lit(1))
    found = mtree.top_k(vectors, F.col("vec_id") % 100 == 0, shard_rows=150, query_block=3, page=8)
    assert sorted(map(tuple, found.collect())) == sorted(plain_top(rows, 10))
    assert mtree.top_k(vectors.limit(0), F.lit(True)).count() == 0


def test_huge_components_stay_exact(spark):
    rows = [(0, [1e6, 2.0, -1e5]), (1, [3e5, 1e6, 7.0]), (2, [1e6, 2.0, -1e5]), (3, [-1e6, 1.0, 1.0])]
    found = mtree.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") == 0)
    assert sorted(map(tuple, found.collect())) == sorted(plain_top(rows, 10))


def test_licence_among_thousands_of_blank_and_copyright_lines(spark):
    known = [row for row in licences.KNOWN if row[0] in ("BSD-3-Clause", "MIT")]
    bsd = next(text for name, text in known if name == "BSD-3-Clause")
    filler = "\n  \n--\nCopyright (c) 2020 A B\n" * 3_000
    rows = [(1, filler + bsd + filler), (2, bsd.replace("\n", filler)), (3, filler + "Licensed under the MIT License." + filler), (4, filler + bsd + " more"), (5, filler)]
    found = licences.scan(spark.createDataFrame(rows, DOCS), spark.createDataFrame(known, "licence string, text string"))
    whole = found.filter("line = 0").select("doc_id", "licence").collect()
    assert sorted(map(tuple, whole)) == [(1, "BSD-3-Clause"), (2, "BSD-3-Clause"), (3, "MIT")]


# -- personal data

def luhn(digits):
    values = [int(c) * (i % 2 + 1) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


def plain_spans(text):
    text = text or ""
    tests = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
    )
    return ",".join(f"{name}:{m.start()}:{m.end()}" for name, pattern, ok in tests for m in re.finditer(pattern, text) if ok(m[0]))


PIECES = ["a", "b@", "@", ".", "1", "23", "4111 1111 1111 1111", "5500-0000-0000-0004", " ", "+", "-", "255", "256", "1.2.3.4", "é", "😀", "x.y", "_", "%", "(", ")", "0"]


def test_base_spans(spark):
    random.seed(6)
    rows = [(i, "".join(random.choices(PIECES, k=random.randint(0, 30))), 1) for i in range(3000)]
    rows += [(9000, None, 1), (9001, "", 1), (9002, "1.2.3.4 " * 2_000, 1), (9003, "a" * 50_000, 1), (9004, "a@b" + ".c" * 20_000, 1), (9005, "1 " * 30_000, 1), (9001, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, pii_email int")
    found = pii.spans(docs).select("doc_id", "text", pii.listed(pii.BASE).alias("s")).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["s"] == plain_spans(r["text"])


def test_added_spans_and_scores(spark):
    rows = [(1, "my bank account GB82 WEST 1234 5698 7654 32."), (2, "GB82 WEST 1234 5698 7654 33"), (3, "ssn 123-45-6789"), (4, "123-45-6789"), (5, "mail to a@b.cc")]
    found = {r["doc_id"]: r for r in pii.spans(spark.createDataFrame(rows, DOCS)).collect()}
    assert [(s["start"], s["stop"], s["score"]) for s in found[1]["pii_iban"]] == [(16, 43, 1.0)]
    assert not found[2]["pii_iban"] and not found[4]["pii_national"]
    assert found[3]["pii_national"][0]["match"] == "123-45-6789" and found[5]["pii_email"][0]["score"] == 1.0
    masked = {r["doc_id"]: r["text"] for r in pii.masked(spark.createDataFrame([*rows, (6, None), (7, "x")], DOCS)).collect()}
    assert masked[1] == "my bank account <iban>." and masked[5] == "mail to <email>" and masked[6] is None and masked[7] == "x"


def test_accounts_before_capitals_and_digits(spark):
    def checked(country, rest):
        turned = "".join(str(int(c, 36)) for c in rest + country + "00")
        return f"{country}{98 - int(turned) % 97:02d}{rest}"

    plain, spaced, other = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", checked("QQ", "12345678901234")
    cases = [
        (f"pay to {plain} Please confirm", [plain]), (f"{spaced} BIC COBADEFF", [spaced]), (f"{plain} 2024 {spaced}", [plain, spaced]),
        (f"NO12 345 {spaced} X", [spaced]), (f"{spaced} {spaced}", [spaced, spaced]), (f"{plain}X {plain}0 A{plain}", []),
        ("GB82 WEST 1234 5698 7654 32 AND MORE", ["GB82 WEST 1234 5698 7654 32"]), (f"é😀 {plain} A1", [plain]),
        (f"{other} ABC", [other]), (plain[:-1] + "1 Please", []), (f"{plain} {checked('NO', '86011117947')} " * 400, [plain, checked("NO", "86011117947")] * 400),
    ]
    found = {r["doc_id"]: r for r in pii.spans(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], DOCS)).collect()}
    for i, (text, wanted) in enumerate(cases):
        assert [s["match"] for s in found[i]["pii_iban"]] == wanted, text[:80]
        assert all(text[s["start"] : s["stop"]] == s["match"] for s in found[i]["pii_iban"])
        assert all(a["stop"] <= b["start"] for a, b in zip(found[i]["pii_iban"], found[i]["pii_iban"][1:]))


def test_context_on_both_sides(spark):
    one, two = "123-45-6789", "987-65-4321"
    cases = [
        (f"{one} (SSN)", [one]), (f"SSN: {one}, {two}", [one, two]), (f"{one}, {two} ssn", [one, two]), (f"{one} {'x' * 40} ssn", []),
        (f"ssn{' ' * 37}{one}", [one]), (f"ssn{' ' * 38}{one}", []), (f"xssn{' ' * 37}{one}", []), (f"{one}{' ' * 37}ssn", [one]), (f"{one}{' ' * 38}ssn", []),
        ("é😀" * 300 + f" ssn {one} " + "😀" * 700 + f"{two} ssn", [one, two]), (f"{one} ssn {'y' * 50} {two}", [one]),
        ("z" * 500 + f" ssn     {one}" + "z", [one]), (f"ssn {one}; {'w' * 60}; " * 500, [one] * 500), (one, []),
    ]
    found = {r["doc_id"]: r for r in pii.spans(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], DOCS)).collect()}
    for i, (text, wanted) in enumerate(cases):
        assert [s["match"] for s in found[i]["pii_national"]] == wanted, text[:80]
        assert all(text[s["start"] : s["stop"]] == s["match"] for s in found[i]["pii_national"])


# -- decontamination

def plain_windows(docs, items, window=10):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))
    for i, text in docs:
        words, hit, names = split(text), set(), set()
        for name, item in items:
            own = split(item)
            k = min(window, len(own))
            windows = {tuple(own[j : j + k]) for j in range(len(own) - k + 1)} if own else set()
            for p in range(len(words) - k + 1):
                if tuple(words[p : p + k]) in windows:
                    hit.update(range(p, p + k))
                    names.add(name)
        yield i, len(words), tuple(sorted(hit)), tuple(sorted({str(n) for n in names if n is not None}))


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 120])
def test_windows(spark, block_bytes):
    random.seed(7)
    words = ["a", "B", "é", "c1", "dd"]
    text = lambda n: random.choice([" ", ", ", "-"]).join(random.choices(words, k=n))
    items = [(i, text(random.randint(0, 14))) for i in range(12)] + [(20, None), (None, "dd dd dd"), (3, "é é"), (21, "c1"), (21, "c1")]
    docs = [(i, text(random.randint(0, 60))) for i in range(60)] + [(90, None), (91, ""), (92, "..."), (93, items[0][1]), (93, items[0][1]), (94, "x y " * 20_000 + (items[1][1] or ""))]
    frame, bench = spark.createDataFrame(docs, DOCS + "").withColumn("hits", F.lit(1)), spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.scan(frame, bench, window=4, block_bytes=block_bytes).collect()
    made = sorted((r["doc_id"], r["n_words"], tuple(r["hits"]), tuple(r["items"])) for r in found)
    want = sorted(plain_windows(docs, items, 4))
    assert made == want
    kept = decontaminate.remove(frame, bench, window=4, block_bytes=block_bytes)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _, hits, _ in want if not hits)
    assert decontaminate.scan(frame.limit(0), bench).count() == 0
    assert {r["n_words"] > 0 and len(r["hits"]) > 0 for r in decontaminate.scan(frame, bench.limit(0)).collect()} == {False}


def test_longest_match():
    bench = decontaminate.Benchmark([("1", "a b c d e f g")], 3)
    rows = decontaminate.findings([b"x a b c d e y", b"b c", b"e f g a b c"], bench)
    assert [r[3] for r in rows] == [5, 0, 3]


def test_suffix_arrays():
    rng = np.random.default_rng(8)
    for _ in range(100):
        ids = np.append(rng.integers(1, rng.choice([2, 3, 50]) + 1, rng.integers(0, 60)), 0)
        depth = int(rng.integers(1, 20))
        order = decontaminate.suffix_array(ids, depth)
        keys = [tuple(ids[i : i + depth]) for i in order]
        assert keys == sorted(keys) and sorted(order) == list(range(ids.size))


# -- quality

def test_quality(spark):
    random.seed(9)
    good = lambda: " ".join(random.choices(["plain", "words", "go", "here."], k=40))
    bad = lambda: " ".join(random.choices(["###", "$$!!", "||"], k=40))
    rows = [(i, bad() if i % 5 == 0 else good(), 0.7) for i in range(300)] + [(900, None, 0.1), (901, "", 0.1), (902, "go " * 60_000, 0.1), (1, "words here.", 0.1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(150)] + [(None, 1), (7, None), (5000, 1), (3, 1)], "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    found = quality.score(docs, model).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    for r in found:
        if 150 <= r["doc_id"] < 300:
            assert (r["score"] >= 0.5) == (r["doc_id"] % 5 > 0)
    by = {r["doc_id"]: r["score"] for r in found}
    assert by[900] == by[901]
    assert quality.train(docs, labels.limit(0)) is None
    assert {r["score"] for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


def test_quality_held_out(spark):
    from rowloom.llm.queries import quality_scores

    folder = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    rows = quality_scores(spark, folder).join(truth, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows) > 0


def test_negative_risk_is_kept_from_falling():
    rng = np.random.default_rng(10)
    positive, rest = rng.normal(1, 1, (400, 3)), np.vstack([rng.normal(1, 1, (500, 3)), rng.normal(-1, 1, (500, 3))])
    model = quality.fit(positive.astype(np.float32), rest.astype(np.float32), 0.5)
    z = (rest - model["mean"]) / model["spread"] @ model["weights"][:-1] + model["weights"][-1]
    assert ((z > 0) == (np.arange(1000) < 500)).mean() > 0.9


