"""Explicit row order and running totals without a single-task sort.

A row's place in its file is meaning, not accident, in ordered lists, keep-first
rules and positional joins. It is held in a ``pos`` column.
"""

from __future__ import annotations

from functools import reduce
from math import isfinite

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.session import materialize


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet; the key columns of ``left`` stay."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[F.col(c) for c in right.columns if c not in keys],
    )
    condition = reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    )
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def _with_offsets(numbered: DataFrame, groups: list[str], name: str, keep: list[str]) -> DataFrame:
    """Turn ids that rise by one inside each group into one dense numbering.

    There is one group per partition or input split. Spark picks the join by the
    size of the table of offsets.
    """
    totals = numbered.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first")
    )
    before = Window.orderBy(*groups).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *groups, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    dense = F.col("_offset") + F.col("_id") - F.col("_first")
    return numbered.join(offsets, groups).select(*keep, dense.alias(name))


def fix_splits(spark: SparkSession) -> None:
    """Make all later scans cut files alike: Spark derives the size of splits from the cores it has at the time unless told."""
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))


def _split_offsets(splits: DataFrame) -> DataFrame:
    """Adds the rows before each split (_path, _start, _n), files by path and splits by place.

    One row a split: running counts inside the files, and one running count over the files.
    """
    inside = Window.partitionBy("_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)
    files = splits.groupBy("_path").agg(F.sum("_n").alias("_rows"))
    files = files.select("_path", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    placed = splits.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return placed.join(files, "_path").withColumn("_offset", F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def ingest_order(df: DataFrame, name: str = "pos") -> DataFrame:
    """Number the rows of a file scan 0..n-1 in file order, files by path.

    ``df`` comes straight from ``spark.read``, or is a filter of that. A first pass only counts the rows
    of every split; nothing but these counts is written. The numbers are those
    of the rows in their file, where the format knows them (Parquet), and otherwise
    counted up in each split, which meets its offset by a 64-bit key. The second
    pass must then cut the files as the first did: ``spark.sql.files.minPartitionNum`` is
    fixed at its present value where it is unset, and a row whose split was not counted is an error, not a guess.
    """
    spark, columns = df.sparkSession, df.columns
    meta = F.col("_metadata")
    if "row_index" in df.select(meta).schema[0].dataType.names:
        path = meta["file_path"]
        keyed = df.select("*", F.xxhash64(path).alias("_split"), meta["row_index"].alias("_id"))
        counts = df.groupBy(path.alias("_path")).agg(
            F.count(F.lit(1)).alias("_n"), F.max(meta["row_index"]).alias("_last"))
        splits = materialize(counts.select("*", F.xxhash64("_path").alias("_split"), F.lit(0).alias("_start"), F.lit(0).alias("_first")), "splits")
        if splits.filter(F.col("_last") + 1 != F.col("_n")).isEmpty():
            return _numbered(keyed, splits, columns, name)
    fix_splits(spark)
    path, start = meta["file_path"], meta["file_block_start"]
    keyed = df.select("*", F.xxhash64(path, start).alias("_split"), F.monotonically_increasing_id().alias("_id"))
    counts = df.select(path.alias("_path"), start.alias("_start"), F.monotonically_increasing_id().alias("_id"))
    counts = counts.groupBy("_path", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    splits = materialize(counts.select("*", F.xxhash64("_path", "_start").alias("_split")), "splits")
    return _numbered(keyed, splits, columns, name)


def _numbered(keyed: DataFrame, splits: DataFrame, columns: list[str], name: str) -> DataFrame:
    """``keyed`` rows (_split, _id) with their numbers, from the counted splits (_path, _start, _n, _first, _split)."""
    if splits.count() != splits.select("_split").distinct().count():
        raise ValueError("two splits have the same key")
    offsets = materialize(_split_offsets(splits).select("_split", "_n", "_first", "_offset"), "offsets")
    place = F.col("_id") - F.col("_first")
    known = (place >= 0) & (place < F.col("_n"))
    number = F.when(known, F.col("_offset") + place).otherwise(F.raise_error(F.lit("the files were cut anew between two passes")).cast("bigint"))
    return keyed.join(offsets, "_split", "left").select(*columns, number.alias(name))


def dense_order(df: DataFrame, *order: Column | str, name: str = "pos") -> DataFrame:
    """Number rows 0..n-1 in the given order.

    The sort is range-partitioned and its result written once; only the row
    counts of the partitions are added up in one place. The order should tell
    rows apart, as rows that tie cannot be split over partitions.
    """
    columns = [c for c in df.columns if c != name]
    ordered = df.orderBy(*order).select(*columns, F.monotonically_increasing_id().alias("_id"))
    fixed = materialize(ordered, "order").withColumn("_part", F.shiftright("_id", 33))
    return _with_offsets(fixed, ["_part"], name, columns)


def concat_rows(first: DataFrame, second: DataFrame, pos: str = "pos", dense: bool = True) -> DataFrame:
    """Union by column name; the second table's rows come after the first's.

    ``dense`` numbers the result 0..n-1. Otherwise the second table's positions
    are moved behind the largest of the first, whose positions are read for it.
    """
    if dense:
        tagged = first.withColumn("_src", F.lit(0)).unionByName(second.withColumn("_src", F.lit(1)))
        return dense_order(tagged, "_src", pos, name=pos).drop("_src")
    last = first.agg(F.max(pos)).first()[0]
    behind = 0 if last is None else last + 1
    return first.unionByName(second.withColumn(pos, F.col(pos) + F.lit(behind).cast("bigint")))


def head(df: DataFrame, n: int = 5, pos: str = "pos") -> DataFrame:
    """The first rows in input order."""
    return df.orderBy(pos).limit(n)


def running_sums(
    df: DataFrame,
    order: str,
    values: list[str],
    keys: list[str] | None = None,
    rows_per_bin: int = 1_000_000,
) -> DataFrame:
    """Exact inclusive running sums of ``values`` in rising ``order`` within ``keys``.

    Adds ``run_<value>`` columns. ``df`` has one row per key and order value and
    is read several times, so it should be a written table. Cut points taken
    from all of it split the order into bins of about ``rows_per_bin`` rows, so
    even a key with most rows is sorted in many tasks. Any cut points give exact
    sums: they only say who sorts what. Infinite values lie in the outer bins.
    """
    keys = keys or []
    bins = -(-df.count() // rows_per_bin)
    cuts = []
    if bins > 1:
        probabilities = [i / bins for i in range(1, bins)]
        found = df.approxQuantile(order, probabilities, 1 / (2 * bins))
        cuts = sorted({x for x in found if isfinite(x)})
    edges = [-float("inf"), *cuts, float("inf")]
    binned = Bucketizer(
        splits=edges, inputCol="_order", outputCol="_bin", handleInvalid="keep"
    ).transform(df.withColumn("_order", F.col(order).cast("double"))).drop("_order") if cuts else (
        df.withColumn("_bin", F.lit(0.0))
    )

    totals = binned.groupBy(*keys, "_bin").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_bin", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values]
    )
    inside = (
        Window.partitionBy(*keys, "_bin").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = null_safe_join(binned, offsets, [*keys, "_bin"])
    return joined.select(
        *df.columns,
        *[(F.col(f"_o_{v}") + F.sum(v).over(inside)).alias(f"run_{v}") for v in values],
    )
