"""Bulk line conversion that takes up new files and appends its successes.

The chunked form of ``operators.convert``: files are read in micro-batches, each
batch appends its lines as one committed step, and a restart goes on after the
last committed batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rowloom.operators.convert import convert, successes


def convert_files(
    spark: SparkSession,
    source: str,
    target: str,
    how: Callable[[str], str | None] | Column,
    checkpoint: str,
    names: list[str],
    column: str,
    sep: str = "\t",
    files_per_batch: int = 1_000,
) -> StreamingQuery:
    """Convert one column of headerless files; stops when all present files are done."""
    fields = F.split("value", r"\Q" + sep + r"\E", -1)
    rows: DataFrame = (
        spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(source)
        .filter(F.length("value") > 0)
        .select(*[F.try_element_at(fields, F.lit(i)).alias(n) for i, n in enumerate(names, 1)])
    )
    return (
        successes(convert(rows, column, how)).writeStream.format("text")
        .option("path", target).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
