"""Counts, summaries and length profiles."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions.text import parse_list
from rowloom.operators.order import running_sums
from rowloom.session import materialize

# The fractions of the length profile.
LENGTH_FRACTIONS = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99, "p99_9": 0.999}


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first; NULLs are not counted."""
    return (
        df.filter(F.col(column).isNotNull()).groupBy(column)
        .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)
    )


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    """Exact number of distinct values; NULLs are not counted."""
    return df.agg(F.count_distinct(column).alias("n_distinct"))


def _value_counts_fixed(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of what is neither NULL nor NaN, written once: one pass over the rows serves all that follows."""
    present = F.col(column).isNotNull()
    if df.schema[column].dataType.typeName() in ("float", "double"):
        present = present & ~F.isnan(column)
    counts = df.filter(present).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return materialize(counts, "values")


def _picked_ranks(counts: DataFrame, total: int, fractions: list[float]):
    """Aggregates that pick the values around each fraction, and how to blend them."""
    places = [q * (total - 1) for q in fractions]
    ranks = sorted({rank for place in places for rank in (floor(place), ceil(place))})
    ranked = running_sums(counts, "value", ["n"])
    picks = [
        F.max(F.when((F.col("run_n") > rank) & (F.col("run_n") - F.col("n") <= rank), F.col("value")))
        .cast("double").alias(f"_{rank}")
        for rank in ranks
    ]
    blends = []
    for p in places:
        low, high = F.col(f"_{floor(p)}"), F.col(f"_{ceil(p)}")
        # equal neighbours may be infinite, whose difference is no number
        blends.append(F.when(low == high, low).otherwise(low + (high - low) * F.lit(p - floor(p))))
    return ranked, picks, blends


def quantiles(df: DataFrame, column: str, fractions: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per fraction (q, value).

    Equal values are combined first; the ranks then come from running sums that
    are sorted in many tasks, so the number of distinct values is no limit.
    """
    counts = _value_counts_fixed(df, column)
    total = counts.agg(F.sum("n")).first()[0] or 0
    ranked, picks, blends = _picked_ranks(counts, total, fractions)
    found = ranked.agg(*picks)
    pairs = F.array(*[F.struct(F.lit(q).alias("q"), b.alias("value")) for q, b in zip(fractions, blends)])
    return found.select(F.inline(pairs))


def describe_numeric(df: DataFrame, column: str) -> DataFrame:
    """count, mean, sample std, min, quartiles and max of a numeric column."""
    counts = _value_counts_fixed(df, column)
    value, n = F.col("value").cast("double"), F.col("n")
    total, mean = counts.agg(F.sum("n"), F.sum(value * n) / F.sum(n)).first()
    ranked, picks, blends = _picked_ranks(counts, total or 0, [0.25, 0.5, 0.75])
    spread = F.sum(n * (value - F.lit(mean)) * (value - F.lit(mean)))
    p25, p50, p75 = blends
    return ranked.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("count"),
        F.sqrt(F.try_divide(spread, F.sum("n") - 1)).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        *picks,
    ).select(
        "count", F.lit(mean).cast("double").alias("mean"), "std", "min",
        p25.alias("p25"), p50.alias("p50"), p75.alias("p75"), "max",
    )


def describe_text(df: DataFrame, columns: list[str], pos: str | None = None) -> DataFrame:
    """count, unique, top and freq of each column, one row per column.

    One scan and one aggregate for any number of columns: every row gives a row
    for each of its values. Equal frequencies are settled by first appearance (``pos``) or by value,
    numbers as such and all else by its text. Lists count as values and are shown as text.
    """

    def value(i: int, name: str) -> Column:
        kind = df.schema[name].dataType
        number = F.col(name).cast("double") + F.lit(0.0) if isinstance(kind, T.NumericType) else F.lit(None).cast("double")
        whole = F.col(name) + 0 if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col(name)  # -0.0 is 0.0
        shown = F.to_json(name) if isinstance(kind, T.ArrayType) else whole.cast("string")
        return F.struct(F.lit(i).alias("_c"), number.alias("_number"), shown.alias("_text"))

    long = df.select(F.inline(F.array(*[value(i, c) for i, c in enumerate(columns)])), *([F.col(pos).alias("_pos")] if pos else []))
    first = F.min("_pos") if pos else F.lit(0)
    counts = long.filter("_text IS NOT NULL").groupBy("_c", "_number", "_text").agg(F.count(F.lit(1)).alias("_n"), first.alias("_first"))
    made = counts.groupBy("_c").agg(
        F.sum("_n").alias("_count"),
        F.count(F.lit(1)).alias("_unique"),
        F.min_by("_text", F.struct(-F.col("_n"), "_first", "_number", "_text")).alias("top"),
        F.max("_n").alias("freq"),
    )
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "_c int, column string")
    return names.join(made, "_c", "left").select(
        "column", F.coalesce("_count", F.lit(0)).alias("count"), F.coalesce("_unique", F.lit(0)).alias("unique"), "top", "freq")


def length_profile(df: DataFrame, length: str) -> DataFrame:
    """n, mean, median, max, min and upper percentiles of a length column.

    Rows are first counted per length. k different lengths need k * k / 2
    characters in all, so the exact percentiles are taken from few rows.
    """
    per_length = df.groupBy(F.col(length).alias("v")).agg(F.count(F.lit(1)).alias("w")).filter("v IS NOT NULL")
    fractions = F.array(*[F.lit(q) for q in LENGTH_FRACTIONS.values()])
    profile = per_length.agg(
        F.coalesce(F.sum("w"), F.lit(0)).alias("n"),
        (F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("mean"),
        F.max("v").cast("bigint").alias("longest"),
        F.min("v").cast("bigint").alias("shortest"),
        F.percentile("v", fractions, F.col("w")).alias("_q"),
    )
    return profile.select(
        "n", "mean", F.col("_q")[0].alias("median"), "longest", "shortest",
        *[F.col("_q")[i].alias(name) for i, name in enumerate(LENGTH_FRACTIONS)],
    )


def sketch_error(size: int) -> float:
    """How far, as a share of all rows, the rank of a sketched quantile is off, in 99 of 100 cases: the published figure."""
    return 2.296 / size**0.9723


def length_sketches(df: DataFrame, length: str, by: list[str] | None = None, size: int = 200) -> DataFrame:
    """(by..., sketch): a mergeable quantile sketch of a whole-number column per group.

    The opt-in beside the exact ``length_profile``: a few KB that can be stored for a
    partition or a day and merged later without its rows. ``size`` sets the error, see ``sketch_error``.
    """
    value = F.col(length).cast("bigint")
    return df.filter(value.isNotNull()).groupBy(*(by or [])).agg(F.kll_sketch_agg_bigint(value, size).alias("sketch"))


def merged_sketches(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The sketches of coarser groups, or of several tables in one union."""
    return sketches.groupBy(*(by or [])).agg(F.kll_merge_agg_bigint("sketch").alias("sketch"))


def sketch_profile(sketches: DataFrame) -> DataFrame:
    """The columns of ``sketches`` with n, median and the upper percentiles instead of the sketch."""
    kept = [c for c in sketches.columns if c != "sketch"]
    found = {"median": 0.5, **LENGTH_FRACTIONS}
    return sketches.select(
        *kept, F.kll_sketch_get_n_bigint("sketch").alias("n"),
        *[F.kll_sketch_get_quantile_bigint("sketch", F.lit(q).cast("double")).alias(name) for name, q in found.items()],
    )


def longest_row(df: DataFrame, text: str, pos: str = "pos") -> DataFrame:
    """The row with the longest text, the first one on ties, with ``length``.

    An aggregate, so each task sends one row, and what is worked out from the result is not
    worked out for every row: Spark moves a projection below a limit.
    """
    sized = df.filter(F.col(text).isNotNull()).withColumn("length", F.char_length(text))
    first = F.min_by(F.struct("*"), F.struct(-F.col("length"), F.col(pos)))
    return sized.agg(first.alias("_row")).filter("_row IS NOT NULL").select("_row.*")


def matrix_shape(df: DataFrame, vector: str) -> DataFrame:
    """Rows and width of a table of vectors."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size(vector)).cast("bigint").alias("width"))


def unparsed_lists(df: DataFrame, text: str) -> DataFrame:
    """How many list texts there are and how many of them do not parse."""
    return df.agg(
        F.count(text).alias("n_lists"),
        F.count_if(F.col(text).isNotNull() & parse_list(text).isNull()).alias("n_unparsed"),
    )
