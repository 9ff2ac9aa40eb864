"""Conversion of a text column that may fail row by row, with accounting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def convert(
    df: DataFrame,
    column: str,
    how: Callable[[str], str | None] | Column,
    out: str = "output",
) -> DataFrame:
    """Add ``out`` and ``ok``; a failed or empty conversion gives NULL and ok = 0.

    ``how`` is a column expression, or a Python function of one text. Every error
    the function raises counts as a failed conversion of that row. No row is lost.
    """
    if isinstance(how, Column):
        result = how
    else:

        @F.pandas_udf("string")
        def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            def safely(text):
                try:
                    return how(text)
                except Exception:
                    return None

            for texts in batches:
                yield texts.map(safely).astype(object)

        result = apply(F.col(column))
    converted = df.withColumn(out, result)
    success = F.coalesce(F.col(out) != "", F.lit(False))
    return converted.withColumn(out, F.when(success, F.col(out))).withColumn(
        "ok", F.col(out).isNotNull().cast("int")
    )


def _outcomes() -> list[Column]:
    success = F.coalesce(F.sum("ok"), F.lit(0)).cast("bigint")
    total = F.count(F.lit(1))
    return [
        total.alias("total"),
        success.alias("success"),
        (total - success).alias("failure"),
        F.round(F.try_divide(success * 100.0, total), 2).alias("success_rate"),
    ]


def outcome_counts(converted: DataFrame) -> DataFrame:
    """total, success, failure and the success rate in percent (NULL if no rows)."""
    return converted.agg(*_outcomes())


def write_counted(converted: DataFrame, write: Callable[[DataFrame], None]) -> DataFrame:
    """``write`` the successes and give the ``outcome_counts`` of all rows, observed while they were written.

    The rows are converted once and nothing but the output is stored.
    """
    seen = Observation()
    write(successes(converted.observe(seen, *_outcomes())))
    found = seen.get
    schema = "total bigint, success bigint, failure bigint, success_rate double"
    row = tuple(found[name] for name in ("total", "success", "failure", "success_rate"))
    return converted.sparkSession.createDataFrame([row], schema)


def successes(converted: DataFrame, out: str = "output") -> DataFrame:
    """Only the converted values, as lines to write."""
    return converted.filter("ok = 1").select(F.col(out).alias("value"))
