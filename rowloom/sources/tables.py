"""Delimited tables, headerless files, and results that are computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions.text import list_text, null_tokens
from rowloom.operators.order import ingest_order
from rowloom.sources.records import read_records


def read_table(
    spark: SparkSession, path: str, schema: str, pos: str | None = None, multiline: bool = False
) -> DataFrame:
    """Delimited file with a header, quoted fields and missing-value tokens.

    Large files are split, with ``multiline`` too, which allows line breaks inside
    quotes (see ``records``). ``pos`` adds the row number.
    """
    if multiline:
        records = read_records(spark, path, pos=pos)
        line = F.rtrim(F.col("record"), F.lit("\r"))
        parsed = F.from_csv(line, schema, {"quote": '"', "escape": '"', "multiLine": "true"})
        rows = records.withColumn("_row", parsed).select("_row.*", *([pos] if pos else []))
    else:
        raw = (
            spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"')
            .option("encoding", "UTF-8").csv(path)
        )
        rows = ingest_order(raw, pos) if pos else raw
    texts = {f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType)}
    return rows.select(
        *[null_tokens(F.col(f"`{c}`")).alias(c) if c in texts else F.col(f"`{c}`") for c in rows.columns]
    )


def read_dealt(spark: SparkSession, path: str, columns: list[str], tasks: int | None = None) -> DataFrame:
    """Columns of a Parquet table for work that costs far more than reading: at least ``tasks`` tasks share the rows.

    A file with one row group is one task however many cores there are. Where the scan's splits, which
    are counted without running anything, are fewer than ``tasks`` (the session's cores unless given), the
    columns asked for, and nothing else, are dealt out once, in four parts for each task, as
    texts differ in length. The rows are the same either way.
    """
    rows = spark.read.parquet(path).select(*columns)
    tasks = tasks or spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= tasks else rows.repartition(4 * tasks)


def read_headerless(
    spark: SparkSession, path: str, names: list[str], sep: str = "\t", pos: str | None = None
) -> DataFrame:
    """Headerless delimited lines, all columns text, empty fields kept, blank lines skipped.

    A field that a short line lacks is NULL.
    """
    lines = read_lines(spark, path, "value", pos)
    fields = F.split("value", r"\Q" + sep + r"\E", -1)
    kept = [pos] if pos else []
    return lines.select(*kept, *[F.try_element_at(fields, F.lit(i)).alias(n) for i, n in enumerate(names, 1)])


def read_lines(
    spark: SparkSession, path: str, name: str = "value", pos: str | None = None, keep_blank: bool = False
) -> DataFrame:
    """One value per line; blank lines are skipped, and not numbered, unless kept."""
    raw = spark.read.text(path)
    if not keep_blank:
        raw = raw.filter(F.length("value") > 0)
    rows = ingest_order(raw, pos) if pos else raw
    return rows.withColumnRenamed("value", name)


def write_table(df: DataFrame, path: str) -> None:
    """Delimited files with a header and no row index; lists become list text, and blanks around a value stay."""
    lists = {f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)}
    flat = df.select(*[list_text(F.col(f"`{c}`")).alias(c) if c in lists else F.col(f"`{c}`") for c in df.columns])
    flat.write.mode("overwrite").option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """One value per line; every run replaces the whole output."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, on whatever file system it names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def cached_table(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Compute once, then always read the frozen result.

    Only a completed write counts; what an interrupted one left is replaced.
    """
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
