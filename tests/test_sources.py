"""Readers over files that are cut into many splits, against readers with one task a file."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from rowloom.functions.text import NA_TOKENS
from rowloom.operators.curate import join_by_position
from rowloom.sources import tables
from rowloom.sources.buckets import drop_bucketed, write_bucketed
from rowloom.sources.records import read_records
from rowloom.sources.snapshots import Snapshot

SCHEMA = "id bigint, title string, note string"


@pytest.fixture
def splits_of(spark):
    """Sets the size of splits; several of them share a task."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def cut(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")

    yield cut
    for n, v in before.items():
        spark.conf.set(n, v)


def written(folder, name, rows, ending="\n"):
    with open(folder / f"{name}.csv", "w", newline="") as out:
        lines = csv.writer(out, lineterminator=ending)
        lines.writerow(["id", "title", "note"])
        lines.writerows(rows)


def random_rows(seed, n, begin=0):
    draw = random.Random(seed)
    texts = ["plain", "", 'said "yes"', "two\nlines", "\n", "a,b", "\n\n\nfour", 'quote "\n" break', "x" * 90, "é\nü", "\n" * 40, '""', "end\n"]
    return [(begin + i, draw.choice(texts), draw.choice(texts)) for i in range(n)]


def one_task(spark, path):
    """Spark's own reader for records over lines."""
    return spark.read.schema(SCHEMA).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


@pytest.mark.parametrize("size", [64, 1_000, 1 << 20])
def test_records_over_split_edges(spark, tmp_path, splits_of, size):
    """With splits of 64 bytes nearly every edge lies inside a quoted field, and some records cover several splits."""
    folder = tmp_path / "t"
    folder.mkdir()
    data = {"a": random_rows(1, 60), "b": random_rows(2, 1, 1000), "c": [], "d": random_rows(3, 80, 2000)}
    for name, rows in data.items():
        written(folder, name, rows)
    (folder / "e.csv").write_text("")
    (folder / "f.csv").write_text('\n\n\nid,title,note\n\n5000,"a\n\nb",x\n\n\n5001,y,"z"')
    want = [r for rows in data.values() for r in rows] + [(5000, "a\n\nb", "x"), (5001, "y", "z")]
    want = [tuple(None if x in NA_TOKENS else x for x in r) for r in want]
    splits_of(size)
    found = tables.read_table(spark, str(folder), SCHEMA, pos="pos", multiline=True)
    assert found.columns == ["id", "title", "note", "pos"]
    got = sorted(found.collect(), key=lambda r: r["pos"])
    assert [r["pos"] for r in got] == list(range(len(want)))
    assert [(r["id"], r["title"], r["note"]) for r in got] == want
    plain = one_task(spark, str(folder)).filter("id IS NOT NULL")
    same = sorted(tuple(None if x in NA_TOKENS else x for x in r) for r in plain.collect())
    assert sorted(((i, t or "", n or "") for i, t, n in same)) == sorted((i, t or "", n or "") for i, t, n in want)
    unnumbered = tables.read_table(spark, str(folder), SCHEMA, multiline=True)
    assert sorted((r["id"], r["title"] or "", r["note"] or "") for r in unnumbered.collect()) == sorted((i, t or "", n or "") for i, t, n in want)
    sent, dealt = (sorted(map(tuple, read_records(spark, str(folder), pos="pos", most_sent=n).collect())) for n in (10**6, 0))
    assert sent == dealt and len(sent) == len(want)
    if size == 64:
        tasks = read_records(spark, str(folder)).select(F.spark_partition_id().alias("task")).distinct().count()
        assert tasks > 1


def test_windows_line_ends(spark, tmp_path, splits_of):
    written(tmp_path, "a", [(1, "x", "y"), (2, "two\r\nlines", "z"), (3, "", "w")], ending="\r\n")
    splits_of(24)
    found = tables.read_table(spark, str(tmp_path), SCHEMA, pos="pos", multiline=True).orderBy("pos").collect()
    assert [tuple(r) for r in found] == [(1, "x", "y", 0), (2, "two\r\nlines", "z", 1), (3, None, "w", 2)]


def test_records_without_header_and_of_nothing(spark, tmp_path, splits_of):
    (tmp_path / "a.csv").write_text('1,"a\nb"\n2,c\n')
    assert sorted(r[0] for r in read_records(spark, str(tmp_path), header=False).collect()) == ['1,"a\nb"', "2,c"]
    (tmp_path / "a.csv").write_text("")
    assert read_records(spark, str(tmp_path), pos="pos").count() == 0


# --- snapshots ------------------------------------------------------------------------


def test_snapshot_looks_up_only_what_is_new(spark, tmp_path):
    snapshot = Snapshot(spark, str(tmp_path / "s"))
    asked = []

    def build(unseen):
        asked.append(sorted(r[0] for r in unseen.collect()))
        return unseen.filter("name <> 'none'").select("name", F.concat(F.lit("found "), "name").alias("value"))

    first = spark.createDataFrame([("a",), ("b",), ("none",), (None,), ("a",)], "name string")
    second = spark.createDataFrame([("b",), ("c",), ("none",)], "name string")
    with pytest.raises(ValueError):
        snapshot.read()
    one = snapshot.grow(first, "name", build)
    two = snapshot.grow(second, "name", build)
    again = snapshot.grow(first.unionByName(second), "name", build)
    assert asked == [["a", "b", "none"], ["c"]] and snapshot.versions() == [1, 2]
    rows = [("a", "found a", 1), ("b", "found b", 1), ("c", "found c", 2)]
    assert sorted(map(tuple, one.collect())) == rows[:2]
    assert sorted(map(tuple, two.collect())) == rows == sorted(map(tuple, again.collect()))
    assert snapshot.read(1).count() == 2


def test_interrupted_and_competing_runs_leave_the_old_version(spark, tmp_path):
    snapshot = Snapshot(spark, str(tmp_path / "s"))
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    plain = lambda unseen: unseen.withColumn("value", F.lit(1))
    snapshot.grow(names.limit(1), "name", plain)

    def broken(unseen):
        raise OSError("lost")

    with pytest.raises(OSError):
        snapshot.grow(names, "name", broken)
    with pytest.raises(Exception):
        snapshot.grow(names, "name", lambda unseen: unseen.withColumn("value", F.raise_error(F.lit("no")).cast("int")))
    assert snapshot.versions() == [1] and snapshot.read().count() == 1

    def overtaken(unseen):
        Snapshot(spark, str(tmp_path / "s")).grow(names, "name", plain)
        return plain(unseen)

    with pytest.raises(RuntimeError):
        snapshot.grow(names, "name", overtaken)
    assert snapshot.versions() == [1, 2] and snapshot.read().count() == 2
    assert not list((tmp_path / "s" / "versions").glob(".*json"))


# --- tables for few tasks and for joins -----------------------------------------------


def test_bucketed_tables_meet_without_an_exchange(spark, tmp_path):
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "true"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        left = write_bucketed(spark.range(500).selectExpr("id AS pos", "id * 2 AS a"), "pos", 6, str(tmp_path / "left"), "left_rows")
        right = write_bucketed(spark.range(0, 700, 7).selectExpr("id AS pos", "id * 3 AS b"), "pos", 6)
        joined = join_by_position(left, right)
        assert sorted(map(tuple, joined.collect())) == [(i, 2 * i, 3 * i) for i in range(0, 500, 7)]
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        grouped = left.groupBy("pos").agg(F.sum("a"))
        grouped.collect()
        assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString()
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
        drop_bucketed(spark, "left_rows")
    assert (tmp_path / "left").exists()


def test_few_row_groups_are_dealt_to_all_cores(spark, tmp_path):
    spark.range(100).selectExpr("id", "id AS x").coalesce(1).write.parquet(str(tmp_path / "one"))
    dealt = tables.read_dealt(spark, str(tmp_path / "one"), ["id"], 5)
    assert dealt.columns == ["id"] and dealt.rdd.getNumPartitions() == 20 and dealt.count() == 100
    assert tables.read_dealt(spark, str(tmp_path / "one"), ["id"], 1).rdd.getNumPartitions() == 1
