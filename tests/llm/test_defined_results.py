"""Defined results for null ids, empty tables, very long texts and extra columns with the operators' own names."""

import pytest
from pyspark.sql import functions as F

from rowloom.llm import decontaminate, licences, lines, lm, packing, pii, queries, quality, simhash

DOCS = "doc_id bigint, text string"
OWN = ("_key", "_site", "bones", "unit", "line", "head", "digest", "block", "shard", "held_out", "fp", "least", "root",
       "component_id", "n_tokens", "bucket", "part", "place", "start", "hits", "items", "n_words", "slots", "host_")


def widened(docs):
    """The same rows with columns called like those the operators make."""
    return docs.select("*", *[F.lit(1).alias(c) for c in OWN if c not in docs.columns])


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    text = "Some words that stand here in a row, and some more of them to make it longer"
    rows = [(1, text), (2, text), (3, "Released under the MIT license."), (4, None), (5, ""), (6, "a b c"), (6, "a b c"), (None, text)]
    widened(spark.createDataFrame(rows, DOCS)).repartition(2).write.parquet(path)
    return spark.read.parquet(path)


def test_columns_of_the_same_names_change_nothing(docs, spark):
    plain, known = docs.select("doc_id", "text"), licences.known_licences(spark)
    items = spark.createDataFrame([(1, "a b c", 1)], "item_id bigint, text string, start int")
    runs = {
        "licences": lambda d: licences.scan(d, known),
        "simhash": lambda d: simhash.near_duplicates(d),
        "packing": lambda d: packing.pack(d),
        "decontaminate": lambda d: decontaminate.scan(d, items).select("doc_id", "n_words", F.size("hits"), F.size("items")),
    }
    for name, run in runs.items():
        got, want = (sorted(map(repr, run(d).collect())) for d in (docs, plain))
        assert got == want and got, name
    got = lm.score(docs, F.lit(False)).collect()
    assert len(got) == 8 and {r["train_tokens"] for r in got} == {3 * 18 + 6 + 1 + 1 + 2 * 4}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.filter("doc_id IS NOT NULL").collect()) == [1, 3, 4, 6]
    assert len(pii.spans(docs).columns) == len(docs.columns) + len(pii.BASE + pii.ADDED)


def test_rows_without_an_id_are_held_out(spark, tmp_path):
    rows = [(i, "der die das und" if i % 2 else "the cat and dog", "de" if i % 2 else "en") for i in range(40)]
    rows += [(None, "der die das und", "xx")] * 5
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    made = {name: queries.QUERIES[name](spark, str(tmp_path)).collect() for name in ("op3_language_id", "op4_lm_scoring", "op10_quality")}
    for name, found in made.items():
        assert len(found) == 45 and all(r["held_out"] for r in found if r["doc_id"] is None), name
    assert {r["lang_pred"] for r in made["op3_language_id"]} == {"de", "en"}
    learned = sum(not r["held_out"] for r in made["op4_lm_scoring"])
    assert {r["train_tokens"] for r in made["op4_lm_scoring"]} == {5 * learned}
    assert 0 < learned < 40


def test_empty_tables_give_no_rows(docs, spark):
    none = docs.select("doc_id", "text").limit(0)
    assert pii.spans(none).count() == 0 and pii.masked(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0 and packing.pack(none).count() == 0
    assert licences.scan(none, licences.known_licences(spark)).count() == 0
    assert quality.score(none, None).count() == 0


def test_very_long_texts(spark):
    text = "one two three four " * 30_000
    docs = spark.createDataFrame([(1, text), (2, text), (3, text + "\nReleased under the MIT license."), (4, "mail a@b.cc " * 20_000)], DOCS)
    assert {r["doc_id"]: r["line"] for r in licences.scan(docs, licences.known_licences(spark)).collect()} == {3: 2}
    # four shingles in equal numbers: many bits are ties, which a few more words decide otherwise in text 3
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs.filter("doc_id <> 3")).collect()} == {1: 1, 2: 1, 4: 4}
    assert {r["doc_id"]: r["n"] for r in pii.spans(docs).select("doc_id", F.size("pii_email").alias("n")).collect()} == {1: 0, 2: 0, 3: 0, 4: 20_000}
    assert {r["doc_id"]: r["n_tokens"] for r in packing.pack(docs).collect()} == {1: 120_000, 2: 120_000, 3: 120_005, 4: 40_000}
    assert lines.drop_boilerplate(docs.withColumn("host", F.lit("h"))).count() == 4
