"""Filter audit, source mixing and hard-negative mining against plain versions, and their defined results for odd input."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.llm import audit, decontaminate, language, mixing, negatives, packing

SPACE = re.compile("[^\x20\x09-\x0d]+")


# -- filter audit

def plain_failures(rows):
    """Letters that each (id, text) fails."""
    found = []
    for i, text in rows:
        text = text or ""
        words = SPACE.findall(text)
        capitals = sum("A" <= c <= "Z" for c in text)
        bad = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * capitals > 3 * len(text), "D": bool(set(text) & set("#$%&*|")),
               "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t in rows)}
        found.append({c for c, b in bad.items() if b})
    return found


def plain_audit(docs, labels):
    """One document after the other through every order."""
    fails = plain_failures([(i, t) for i, t, _ in docs])
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    for part in {p or "" for _, _, p in docs}:
        rows = [(i, f) for (i, _, p), f in zip(docs, fails, strict=True) if (p or "") == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        made = {}
        for order in permutations("ABCDE"):
            left = rows
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if letter in r[1]]
                all_fail = sum(letter in f for _, f in rows)
                left = [r for r in left if letter not in r[1]]
                removed_by[letter] += len(gone)
                made["".join(order), step] = (letter, [len(left), len(gone), all_fail - len(gone), sum(f == {letter} for _, f in rows),
                                                       sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)])
        out |= {(part, *key): (*counts, removed_by[letter]) for key, (letter, counts) in made.items()}
    return out


def audit_rows(seed=3):
    draw = random.Random(seed)
    texts = [None, "", "Short TEXT", "a|b", "word " * 300, " ".join(f"w{i}" for i in range(250)), " ".join(f"W{i}" for i in range(250)), "x y " * 10, "long " * 40_000]
    texts += [" ".join(draw.choice(["Up", "low", "a#b", "c", f"n{draw.randrange(400)}"]) for _ in range(draw.randrange(150, 320))) for _ in range(25)]
    docs = [(i, draw.choice(texts), draw.choice(["en", "de", "", None])) for i in range(160)]
    docs += [(None, texts[2], "en"), (None, texts[2], "en"), (7, texts[2], "en"), (7, texts[2], "en"), (5, "twice", "de"), (5, "twice", "de")]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(0, 160, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (7, 1, 1)]
    return docs, labels


def test_audit_equals_documents_one_by_one(spark):
    docs, labels = audit_rows()
    table = spark.createDataFrame([(*d, 0, "x", b"") for d in docs], "doc_id bigint, text string, lang string, mask int, part string, digest binary").repartition(5)
    marks = spark.createDataFrame([(*x, True) for x in labels], "doc_id bigint, quality int, toxic int, good boolean")
    made = audit.audit(table, marks)
    assert made.dtypes == [("part", "string"), ("filter_order", "string"), ("step", "int"), *[(c, "bigint") for c in (
        "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]]
    found = made.collect()
    got = {tuple(r)[:3]: tuple(r)[3:] for r in found}
    assert len(got) == len(found) and got == plain_audit(docs, labels)
    assert audit.audit(table.limit(0), marks).count() == 0
    unlabelled = audit.audit(table, marks.limit(0))
    assert unlabelled.agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_one_document_in_many_copies(spark):
    """A third of the rows share a text; each is a copy but the first."""
    rows = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same' ELSE concat('own ', id) END AS text", "'en' AS lang")
    marked = audit.copies(audit.failures(rows), 4)
    assert marked.filter(F.col("mask").bitwiseAND(16) > 0).count() == 999


@pytest.mark.parametrize("filters", [1, 3, 5])
def test_survival_words(filters):
    words = audit.survival_words(filters)
    for mask, word in enumerate(words.tolist()):
        assert [word >> s & 1 for s in range(1 << filters)] == [int(not s & mask) for s in range(1 << filters)]


def test_too_many_filters():
    with pytest.raises(ValueError):
        audit.survival_words(6)


@pytest.mark.parametrize("sizes", [[], [0], [1], [2, 1], [1000], [3, 0, 77, 4096, 1], [65_537]])
def test_carry_save_counts(sizes):
    draw = np.random.default_rng(1)
    count, total = audit.PositionalCount(), np.zeros(32, dtype=int)
    for n in sizes:
        words = draw.integers(0, 1 << 32, n, dtype=np.uint32)
        count.add(words)
        total += (words[:, None] >> np.arange(32, dtype=np.uint32) & 1).sum(axis=0).astype(int)
    assert count.totals(32) == total.tolist()
    assert all(level.size <= 2 for level in count.levels)


# -- mixing

def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Hand out by weight; full sources stop and the rest is handed out again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        heft = sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and rest * weight[s] / heft > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else rest * weight[s] / heft for s in names}
        full |= over


def plain_draw(doc_id, text, seed=mixing.SEED):
    known = ":".join([str(seed), "" if doc_id is None else str(doc_id), text or ""])
    return int(hashlib.md5(known.encode()).hexdigest()[:13], 16) / 16**13


def mixing_rows():
    draw = random.Random(5)
    names = ["b", "a", "Z", "é", "\U0001f600", "￮", "", None, "none"]
    rows = [(i, draw.choice(names[:-1] + ["a"] * 5), "w " * draw.randrange(0, 90)) for i in range(700)]
    rows += [(900, "none", ""), (901, "none", None), (902, "a", "w x " * 30_000), (None, "b", "x"), (None, "b", "y z"), (3, "b", "r r"), (3, "b", "r r")]
    return rows


def test_mixing_equals_plain_version(spark):
    rows = mixing_rows()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, source string, text string, _draw int, rate int").repartition(4)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(SPACE.findall(t or ""))
    aims = plain_targets(sizes)
    wanted = []
    for i, s, t in rows:
        n, rate = len(SPACE.findall(t or "")), aims[s] / sizes[s] if sizes[s] else 0.0
        copies = int(rate) + (plain_draw(i, t) < rate - int(rate))
        wanted.append((str(i), n, sizes[s], round(aims[s], 6), n * copies))
    found = mixing.shares(docs)
    again = mixing.shares(docs.repartition(7))
    got = lambda df: sorted((str(r["doc_id"]), r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in df.collect())
    assert got(found) == sorted(wanted) == got(again)
    assert abs(sum(aims.values()) - 1.5 * sum(sizes.values())) < 1e-6

    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "size", "source_size", "target", "copies"]
    total = mixed.agg(F.sum("size")).first()[0]
    assert total == sum(w[-1] for w in wanted)
    assert mixing.shares(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_taken_words_come_near_their_targets(spark):
    docs = spark.range(30_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 7) END AS source", "repeat('w ', 1 + CAST(id % 50 AS INT)) AS text")
    for row in mixing.shares(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max(F.col("taken") / F.col("size")).alias("most")).collect():
        assert abs(row["taken"] - row["target"]) < 0.05 * row["target"] and row["most"] <= 2


@pytest.mark.parametrize("sizes", [{"a": 0, "b": 0}, {"a": 10}, {None: 4}, {"a": 1, "b": 1, "c": 1_000, "d": 5, None: 7}, {f"s{i:03d}": (i * 37) % 101 for i in range(120)}])
def test_targets(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    found = {r["source"]: r["target"] for r in mixing.targets(table).collect()}
    wanted = plain_targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0)
    assert {s: pytest.approx(t) for s, t in wanted.items()} == found


# -- hard negatives

def plain_mine(rows, asks, k=5, n=10, least=30, greatest=90, scale=256):
    seen = {}
    for i, label, vector in rows:
        if i is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        seen[i, str(label), tuple(int(np.floor(scale * float(x))) for x in vector)] = None
    out = []
    for i, label, v in seen:
        if not asks(i):
            continue
        others = [(-sum(a * b for a, b in zip(v, w)), j, name) for j, name, w in seen if j != i and len(w) == len(v)]
        same = sorted((s, j) for s, j, name in others if name == label)[:k]
        for s, j in same:
            inside = sorted((t, m) for t, m, name in others if name != label and least * -s <= 100 * -t <= greatest * -s)[:n]
            out += [(i, j, rank, m, -s, -t) for rank, (t, m) in enumerate(inside, 1)]
    return sorted(out)


VECTORS = "vec_id bigint, label int, embedding array<double>"


def vector_rows(n=400, seed=2, length=12):
    draw = np.random.default_rng(seed)
    rows = [(i, int(draw.integers(0, 4)), [float(x) for x in draw.normal(size=length)]) for i in range(n)]
    rows += [(9001, None, [1.0] * length), (None, 1, [1.0] * length), (9002, 1, None), (9003, 1, [float("nan")] * length), (9004, 1, [None] * length), (9005, 2, [float("inf")] * length)]
    rows += [(9100, 1, [1.0, 2.0]), (9101, 1, [2.0, 1.0]), (9102, 2, [1.0, 1.0]), (9200, 1, []), (9201, 1, []), (9202, 3, []), rows[3], rows[3], (50, 3, rows[7][2]), (rows[5][0], 1, rows[6][2])]
    return rows


@pytest.mark.parametrize("shard_bytes", [1 << 23, 4_000])
def test_mining_equals_plain_version(spark, shard_bytes):
    rows = vector_rows()
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS + ", row int, shard string").repartition(3)
    made = negatives.mine(table, F.col("vec_id") % 50 == 0, shard_bytes=shard_bytes)
    assert [t for _, t in made.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    wanted = plain_mine(rows, lambda i: i % 50 == 0)
    assert sorted(map(tuple, made.collect())) == wanted and len(wanted) > 100
    assert negatives.mine(table.limit(0), F.lit(True)).count() == 0


def test_mining_ties_and_large_components(spark):
    rows = [(i, i % 3, [float(i % 4), 1.0, 0.0]) for i in range(60)]
    large = [(100 + i, i % 2, [1e7 * (i % 5 + 1), 2e9, 3.0]) for i in range(30)]
    table = spark.createDataFrame(rows + large, VECTORS)
    made = negatives.mine(table, F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, made.collect())) == plain_mine(rows + large, lambda i: i % 10 == 0)


def test_windows_are_whole_numbers():
    for score in [*range(-40, 40), 10**18, -(10**18)]:
        low, high = negatives.window(score, 30, 90)
        assert 100 * low >= 30 * score > 100 * (low - 1) and 100 * high <= 90 * score < 100 * (high + 1)


def test_bounds_leave_components_unread():
    """Clustered vectors with a few large dimensions: most candidates go before the small ones are read."""
    draw = np.random.default_rng(4)
    strength = 0.7 ** np.arange(64)
    centres = draw.normal(size=(40, 64)) * strength * 4
    of = draw.integers(0, 40, 4000)
    vectors = np.floor(256 * (centres[of] + draw.normal(size=(4000, 64)) * strength * 0.1))
    labels = np.array([str(c % 5) for c in of], dtype=object)
    shard = negatives.Shard(np.arange(4000), labels, vectors)
    for i in range(0, 4000, 400):
        scores = vectors @ vectors[i]
        same = sorted((-scores[j], j) for j in range(4000) if j != i and labels[j] == labels[i])[:5]
        near = negatives.positives_of(shard, i, labels[i], vectors[i], 5)
        assert near == [(j, -s) for s, j in same]
        windows = [negatives.window(s, 30, 90) for _, s in near]
        found = negatives.negatives_of(shard, i, labels[i], vectors[i], windows, 10)
        for (low, high), lines in zip(windows, found, strict=True):
            assert lines == [(j, -s) for s, j in sorted((-scores[j], j) for j in range(4000) if labels[j] != labels[i] and low <= scores[j] <= high)[:10]]
    assert shard.read < 0.5 * 10 * 4000 * 64


# -- bounds of earlier operators

def test_long_text_and_many_languages_in_bounded_memory():
    """20 MB of text with 4 and 1 MB with 400 languages: far below what one row of figures per n-gram would take."""
    rng = np.random.default_rng(0)
    for languages, size in ((4, 20 << 20), (400, 1 << 20)):
        logs = np.log(rng.random((language.BUCKETS, languages)))
        model = language.Model([f"l{i:03d}" for i in range(languages)], logs, np.zeros(languages), language.letters(), language.ORDERS)
        text = "".join(rng.choice(list("abcdefghij klmno"), 1024)) * (size // 1024)
        tracemalloc.start()
        names, _ = model.predict([text])
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 500 << 20
        counts = logs.T @ np.sum([np.bincount(language._hashed(language._points([text], model.kinds)[0], k, language.BUCKETS), minlength=language.BUCKETS) for k in language.ORDERS], axis=0)
        assert names == [f"l{int(counts.argmax()):03d}"]


def test_posterior_equals_the_plain_sum():
    rng = np.random.default_rng(1)
    logs, prior = np.log(rng.random((language.BUCKETS, 5))), np.log([1, 2, 3, 4, 5])
    model = language.Model(list("abcde"), logs, prior, language.letters(), language.ORDERS)
    texts = ["", None, "1 2 3", "zz é"] + ["".join(rng.choice(list("abc dé"), rng.integers(1, 40))) for _ in range(200)]
    for text, name, score in zip(texts, *model.predict(texts), strict=True):
        clean, _, has = language._points([text], model.kinds)
        total = prior + sum(logs[language._hashed(clean, k, language.BUCKETS)].sum(axis=0) for k in language.ORDERS)
        share = np.exp(total - total.max())
        assert (name, round(score, 9)) == (("abcde"[int(total.argmax())], round(float((share / share.sum()).max()), 9)) if has[0] else ("und", 0.0))


def test_bytes_that_are_no_text(spark):
    docs = spark.sql("SELECT 1 AS doc_id, CAST(X'61FF62C3' AS STRING) AS text UNION ALL SELECT NULL, 'abc'")
    model = language.train(docs.withColumn("lang", F.lit("x")))
    assert {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, model).collect()} == {1: "x", None: "x"}


def test_a_window_of_many_items_is_looked_up_once():
    items = [(str(i), "the end") for i in range(20_000)] + [("x", " ".join(f"w{j % 50}" for j in range(400)))]
    bench = decontaminate.Benchmark(items)
    draw = random.Random(2)
    text = " ".join(draw.choices(["the", "end", "of", "w1", "w2"], k=300_000))
    tracemalloc.start()
    (n, hits, windows, longest), = decontaminate.findings([text.encode()], bench)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 300_000 and len(hits) == 2 * text.count("the end") and longest == 2
    assert len(windows) == 1 and len(bench.items_of(windows)) == 20_000 and peak < 300 << 20


def test_longest_match_over_all_items():
    """The longest run that begins with a window, whichever of the items that share it goes on."""
    draw = random.Random(6)
    for _ in range(60):
        items = [" ".join(draw.choices("abc", k=draw.randrange(0, 14))) for _ in range(8)]
        texts = [" ".join(draw.choices("abcd", k=draw.randrange(0, 30))) for _ in range(5)]
        bench = decontaminate.Benchmark([(str(i), t) for i, t in enumerate(items)], 3)
        for text, row in zip(texts, decontaminate.findings([t.encode() for t in texts], bench), strict=True):
            words, best = text.split(), 0
            for item in map(str.split, items):
                least = min(3, len(item)) or 99
                for i in range(len(words)):
                    for j in range(len(item) - least + 1):
                        k = 0
                        while i + k < len(words) and j + k < len(item) and words[i + k] == item[j + k]:
                            k += 1
                        best = max(best, k if k >= least else 0)
            assert row[3] == best


def test_boundaries_of_long_texts_are_exact(spark):
    """Lengths far beyond 1024, where bins hold several: the padding is that of the best boundaries over all lengths."""
    draw = random.Random(8)
    sizes = [int(draw.lognormvariate(7.5, 1.3)) for _ in range(1500)] + [5461] * 40 + [20_011, 20_020]
    rows = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, size bigint")
    made = packing.pack(rows, length=F.col("size"), digits=6)
    found = {r["bucket_length"]: r["longest"] for r in made.groupBy("bucket_length").agg(F.max("n_tokens").alias("longest")).collect()}
    counts = Counter(sizes)
    best = packing.boundaries(list(counts), list(counts.values()), packing.BUCKETS)
    waste = lambda edges: sum(min(e for e in edges if e >= s) - s for s in sizes)
    assert all(length == longest for length, longest in found.items())
    assert waste(found) == waste(best)
