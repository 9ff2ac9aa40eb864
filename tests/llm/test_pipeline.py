"""The pipeline over a small corpus with planted cases, against its stages written plainly."""

import random
import re
from collections import Counter

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from rowloom.llm import lines, packing, simhash
from test_llm_operators import plain_components, plain_fingerprint, plain_windows

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double"


def corpus():
    random.seed(11)
    words = {"aa": ["kata", "sina", "mata", "ilo", "vesi", "puu", "talo", "joki"], "bb": ["grzb", "scholt", "brmf", "krank", "zwist", "drumf", "plotz", "knurr"]}
    prose = lambda name, n: " ".join(random.choice(words[name]) + random.choice(["", "", ",", "."]) for _ in range(n))
    items = [(1, prose("aa", 16)), (2, "Alpha beta, gamma delta")]
    rows = []
    for i in range(80):
        name = "aa" if i % 3 else "bb"
        text = f"{prose(name, 60)}\n{prose(name, 60)}"
        if i % 4 == 0:
            text = "Kata menu top\n" + text
        rows.append((i, text, name, f"s{i % 2}"))
    rows += [
        (100, rows[7][1], "aa", "s0"), (101, rows[7][1], "aa", "s1"), (102, rows[7][1] + " vesi", "aa", "s0"),
        (103, "12345 --- !!", None, "s0"), (104, None, "aa", "s0"), (105, "", None, None),
        (106, prose("aa", 30) + " " + items[0][1], "aa", "s1"), (107, items[1][1].upper(), "bb", "s1"),
        (108, prose("bb", 900), "bb", None), (108, prose("bb", 900), "bb", None),
    ]
    return [(i, t, lang, s, None if t is None else len(t), 0.5) for i, t, lang, s in rows], items


def plainly(rows, items):
    """(doc_id, text) after the first four stages."""
    docs = [(i, t, s) for i, t, _, s, *_ in rows if t and re.search(r"[^\W\d_]", t)]
    counts, totals = Counter(), Counter()
    for _, t, s in docs:
        if s is not None:
            totals[s] += 1
            counts.update({(s, x.strip(" \t\r")) for x in t.split("\n")} - {(s, "")})
    bad = {k for k, n in counts.items() if n >= lines.MIN_PAGES and n > lines.RATIO * totals[k[0]]}
    assert bad
    docs = [(i, "\n".join(x for x in t.split("\n") if (s, x.strip(" \t\r")) not in bad)) for i, t, s in docs]
    groups = plain_components(sorted({i for i, _ in docs}), {i: plain_fingerprint(t) for i, t in docs})
    once = {}
    for i, t in docs:
        if groups[i] == i:
            once.setdefault(i, t)
    hit = {i for i, _, hits, _ in plain_windows(list(once.items()), items) if hits}
    assert hit == {106, 107}
    return {i: t for i, t in once.items() if i not in hit}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("sf")
    rows, items = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(where / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(where / "benchmark.parquet"))
    return str(where)


def test_pipeline_against_plain_stages(spark, folder):
    rows, items = corpus()
    # the copied row 108 has two texts, of which one stays
    rows = [r for k, r in enumerate(rows) if k != len(rows) - 1]
    want = plainly(rows, items)
    found = contract.queries()["pipeline"](spark, folder).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(want)
    sizes = {i: len(t.split()) for i, t in want.items()}
    assert {r["doc_id"]: r["n_tokens"] for r in found if r["doc_id"] != 108} == {i: n for i, n in sizes.items() if i != 108}
    edges = packing.boundaries(list(Counter(sizes.values())), list(Counter(sizes.values()).values()), packing.BUCKETS)
    for r in found:
        assert r["bucket_length"] == min(e for e in edges if e >= sizes[r["doc_id"]]) == edges[r["bucket"]]
    for b, edge in enumerate(edges):
        own = [(r["batch"], r["place"]) for r in sorted(found, key=lambda r: r["doc_id"]) if r["bucket"] == b]
        assert own == [divmod(k, packing.BUDGET // edge) for k in range(len(own))]


def test_no_stage_sends_signatures_through_the_driver(spark, folder, monkeypatch):
    """What the near copies are linked by is 64 times the documents, which the planner sizes as one each."""
    plans, found = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda edges: plans.append(edges._jdf.queryExecution().executedPlan().toString()) or found(edges))
    assert contract.queries()["pipeline"](spark, folder).count() > 0
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]


def test_stages_keep_the_columns_and_stand_empty_tables(spark, folder):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and "simhash" in names
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    empty = spark.createDataFrame([], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, empty):
            made = stage(spark, given, folder)
            if name != names[-1]:
                assert made.schema.names == docs.schema.names
                assert [f.dataType for f in made.schema] == [f.dataType for f in docs.schema]
        assert made.count() == 0


def test_every_operator_is_registered():
    known = contract.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in known) == 1
    assert "pipeline" in known
