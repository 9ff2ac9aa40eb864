"""Wide numeric matrices as tab-separated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: A separator that no line holds: lines are read and written as one field.
NEVER = "\u0001"


def _quoted(text: Column) -> Column:
    doubled = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[\t\n\r"]'), doubled).otherwise(text)


def write_matrix(df: DataFrame, id_col: str, vector: str, path: str, width: int) -> None:
    """Id column and columns "0".."width-1"; every file begins with the header.

    A row is one text field, so a matrix of thousands of columns needs no plan of thousands of columns.
    """
    header = "\t".join([id_col, *map(str, range(width))])
    fields = F.transform(vector, lambda v: F.coalesce(v.cast("string"), F.lit("")))
    line = F.concat_ws("\t", F.coalesce(_quoted(F.col(id_col).cast("string")), F.lit("")), F.array_join(fields, "\t"))
    (
        df.select(line.alias(header)).write.mode("overwrite").option("header", True)
        .option("sep", NEVER).option("quote", "").option("escapeQuotes", False).option("emptyValue", "").csv(path)
    )


def read_matrix(
    spark: SparkSession, path: str, id_name: str = "id", element: str = "double", out: str = "features"
) -> DataFrame:
    """First column = id, the rest one vector; an empty or unreadable number is NULL.

    The first line of every file is its header. Ids may be quoted but hold no line breaks.
    """
    lines = (
        spark.read.schema("value string").option("header", True).option("sep", NEVER).option("quote", "")
        .option("enforceSchema", True).option("maxCharsPerColumn", -1).csv(path)
    )
    quoted = F.regexp_extract("value", r'^("(?:[^"]++|"")*+")', 1)
    raw = F.when(F.col("value").startswith('"'), quoted).otherwise(F.substring_index("value", "\t", 1))
    plain = F.when(
        raw.startswith('"'), F.replace(F.substring(raw, F.lit(2), F.length(raw) - 2), F.lit('""'), F.lit('"'))
    ).otherwise(raw)
    rest = F.substring("value", F.length(raw) + 2, F.length("value"))
    numbers = F.transform(F.split(rest, "\t", -1), lambda v: v.try_cast(element))
    return lines.select(plain.alias(id_name), numbers.alias(out))
