"""Ordered label lists and label frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.operators.order import dense_order, null_safe_join


def ordered_lists(
    df: DataFrame, key: str, value: str, pos: str, out: str = "labels", kept: str | None = None
) -> DataFrame:
    """One list per key: its values in input order, repeats kept: (key, out, first).

    ``pos`` is a whole number unique per row. ``kept`` names a boolean column:
    rows where it is false leave their key in place but not their value. A list
    is one value of a row; ``list_parts`` is for keys whose lists outgrow a row.
    """
    item = F.struct(F.col(pos).alias("pos"), F.col(value).alias("value"))
    if kept:
        item = F.when(F.col(kept), item)
    return df.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda x: x["value"]).alias(out),
        F.min(pos).alias("first"),
    )


def list_parts(df: DataFrame, key: str, value: str, pos: str, size: int, out: str = "labels") -> DataFrame:
    """The lists of ``ordered_lists`` in parts of ``size`` values: (key, part, out).

    The parts of a key in order are its whole list. Ranks come from numbering all
    rows by key and position, so a key that holds most rows is spread over many
    tasks and none gathers more than ``size`` values.
    """
    numbered = dense_order(df.select(key, value, pos), key, pos, name="_n")
    firsts = numbered.groupBy(key).agg(F.min("_n").alias("_first"))
    ranked = null_safe_join(numbered, firsts, [key])
    item = F.struct(F.col(pos).alias("pos"), F.col(value).alias("value"))
    return (
        ranked.withColumn("part", F.expr(f"(_n - _first) div {size}"))
        .groupBy(key, "part")
        .agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["value"]).alias(out))
    )


def label_counts(df: DataFrame, labels: str, pos: str | None = None) -> DataFrame:
    """Occurrences of each label over all lists: (label, n[, first]).

    A label repeated in a row, or an entity on several rows, counts each time.
    ``first`` is the place of the first occurrence, for breaking ties: the row's
    position and the place in its list in one number, because a minimum over
    numbers is hashed and one over structs is sorted.
    """
    if pos is None:
        return df.select(F.explode(labels).alias("label")).groupBy("label").agg(
            F.count(F.lit(1)).alias("n")
        )
    long = df.select(F.col(pos).alias("_pos"), F.posexplode(labels).alias("_i", "label"))
    place = F.col("_pos").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("_i")
    return long.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.min(place.cast("decimal(38,0)")).alias("first")
    )


def top_labels(counts: DataFrame, k: int = 20, tie: str = "first") -> DataFrame:
    """The k most frequent labels; equal counts in order of ``tie``."""
    return counts.orderBy(F.desc("n"), F.asc(tie)).limit(k)


def cumulative_counts(top: DataFrame, tie: str = "first") -> DataFrame:
    """Running total in rank order after a leading zero row: (rank, label, n, total).

    Meant for the k rows of ``top_labels``; that small table is ranked in one task.
    """
    ranked = Window.orderBy(F.desc("n"), F.asc(tie))
    upto = ranked.rowsBetween(Window.unboundedPreceding, 0)
    rows = top.select(
        F.row_number().over(ranked).cast("bigint").alias("rank"),
        "label",
        "n",
        F.sum("n").over(upto).alias("total"),
    )
    zero = top.sparkSession.range(1).select(
        F.lit(0).cast("bigint").alias("rank"),
        F.lit("").alias("label"),
        F.lit(0).cast("bigint").alias("n"),
        F.lit(0).cast("bigint").alias("total"),
    )
    return zero.unionByName(rows)


def rare_labels(counts: DataFrame, threshold: float = 10) -> DataFrame:
    """Labels that occur fewer than ``threshold`` times."""
    return counts.filter(F.col("n") < threshold).select("label")


def median_count(counts: DataFrame) -> float:
    """The median of the label counts, a threshold that fits any scale; 0 without labels."""
    return counts.agg(F.median("n")).first()[0] or 0.0


def mark_kept(df: DataFrame, value: str, rare: DataFrame, out: str = "kept") -> DataFrame:
    """Rows of single labels with a column that is false for the rare ones; a NULL label can be rare too."""
    marks = rare.select(F.col("label").alias(value), F.lit(True).alias("_rare")).distinct()
    return null_safe_join(df, marks, [value], "left").withColumn(out, F.col("_rare").isNull()).drop("_rare")


def prune_labels(df: DataFrame, labels: str, rare: DataFrame, row: list[str]) -> DataFrame:
    """Take the rare labels out of every list; emptied lists stay as rows.

    The lists become rows, which are matched with the rare labels, and are put
    together again; ``row`` names the columns that tell rows apart. Rows that
    are still in long form need only ``mark_kept`` and one ``ordered_lists``.
    """
    long = df.select(*row, F.posexplode(labels).alias("_i", "label"))
    marked = mark_kept(long, "label", rare, "_kept_row").filter("_kept_row")
    lists = marked.groupBy(*row).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "label"))), lambda x: x["label"]).alias("_kept")
    )
    empty = F.when(F.col(labels).isNotNull(), F.array().cast(df.schema[labels].dataType))
    joined = null_safe_join(df, lists, row, "left")
    return joined.withColumn(labels, F.coalesce("_kept", empty)).select(*df.columns)
