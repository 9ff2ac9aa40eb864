"""Tables that are written in buckets of a key, so that they meet on it without a shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rowloom.session import scratch_path


def write_bucketed(df: DataFrame, key: str, buckets: int | None = None, path: str | None = None, name: str | None = None) -> DataFrame:
    """Write ``df`` in ``buckets`` (the session's shuffle partitions unless given) of ``key``, each sorted by it, and read that.

    Two tables with equal keys and numbers of buckets are joined, grouped or
    numbered by the key without an exchange; the shuffle is paid once, here. The table is in the
    session's catalog as ``name``, its files below ``path`` or else in the shared scratch folder.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = name or f"bucketed_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, key)  # one file a bucket
    dealt.write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", path or scratch_path(spark, name)).saveAsTable(name)
    return spark.table(name)


def drop_bucketed(spark: SparkSession, name: str) -> None:
    """Forget a table; files under a path that the caller named stay."""
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
