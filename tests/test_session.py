"""The shared folder, and who deletes what lies in it."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from rowloom.operators import order
from rowloom.plans.queries import QUERIES
from rowloom.session import materialize, scratch, scratch_path, shared, shared_folder


def folders(spark) -> set[str]:
    root = f"{shared_folder(spark)}/rowloom-{spark.sparkContext.applicationId}".removeprefix("file:")
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_only_what_executors_see_is_shared():
    assert shared("local[8]", "file") and shared("local-cluster[3,2,1024]", "file")
    assert not shared("spark://host:7077", "file") and not shared("yarn", "file")
    assert shared("yarn", "hdfs") and shared("spark://host:7077", "s3a")


def test_a_block_deletes_what_it_wrote(spark):
    materialize(spark.range(3), "kept_before")
    before = folders(spark)
    with scratch(spark):
        numbered = order.dense_order(spark.range(20).withColumn("k", F.col("id") % 3), "k", "id")
        with scratch(spark):
            inner = materialize(spark.range(5), "inner")
            assert inner.count() == 5
            made = folders(spark)
            assert any(x.startswith("inner") for x in made)
        assert not any(x.startswith("inner") for x in folders(spark))
        assert numbered.count() == 20 and folders(spark) > before
        scratch_path(spark, "never_written")
    assert folders(spark) == before


def test_a_block_deletes_after_an_error(spark):
    before = folders(spark)
    with pytest.raises(ZeroDivisionError), scratch(spark):
        materialize(spark.range(3), "lost")
        raise ZeroDivisionError
    assert folders(spark) == before


def test_a_whole_plan_leaves_nothing(spark):
    before = folders(spark)
    with scratch(spark):
        rows = QUERIES["curate_table"](spark, "/root/testdata/sf0.001").collect()
        assert rows and len(folders(spark)) > len(before)
    assert folders(spark) == before


def test_what_is_shared_by_a_run_outlasts_the_block(spark):
    from rowloom.session import outlasting

    with scratch(spark):
        with outlasting():
            kept = materialize(spark.range(4), "kept")
        gone = materialize(spark.range(4), "gone")
        assert gone.count() == 4
    assert kept.count() == 4 and not any(x.startswith("gone") for x in folders(spark))
