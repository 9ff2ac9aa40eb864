"""Delimited records with line breaks inside quotes, from files that are cut into splits.

A line begins a record if an even number of quotes stands before it in its file. A
first pass counts the quotes of every split; their running parity tells each
split whether it begins inside quotes. The second pass then cuts every split into records on its own. Only
the record that a split leaves open and the lines that end it in later splits are put together by a shuffle.

Quotes must be those of quoted fields, doubled where they are part of a value; a lone quote in
an unquoted field would turn the parity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.operators.order import fix_splits
from rowloom.session import materialize

_RECORDS = "split bigint, seq bigint, part boolean, record string"
_NAMES = ["split", "seq", "part", "record"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    fix_splits(spark)
    raw = spark.read.option("lineSep", "\n").text(path)
    file, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    return raw.select(file.alias("file"), start.alias("start"), F.xxhash64(file, start).alias("split"), "value")


def _splits(lines: DataFrame, quote: str) -> DataFrame:
    """One row a split: (file, start, split, odd, header): begins inside quotes; holds its file's first line that is not blank."""
    n_quotes = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    counts = lines.groupBy("file", "start", "split").agg(
        F.sum(n_quotes).alias("quotes"), F.count_if(F.trim(F.rtrim(F.col("value"), F.lit("\r"))) != "").alias("content"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    earlier = {c: F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("quotes", "content")}
    return materialize(counts.select(
        "file", "start", "split", (earlier["quotes"] % 2 == 1).alias("odd"), ((earlier["content"] == 0) & (F.col("content") > 0)).alias("header"),
    ), "splits")


def _cutter(quote: str):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, inside, seq, held = None, False, -1, []

        def batch_of(seqs, parts, records) -> pa.RecordBatch:
            n = len(records)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, split), pa.int64()), pa.array(seqs, pa.int64()), pa.array(parts, pa.bool_()), pa.array(records, pa.string())], names=_NAMES)

        def rest() -> Iterator[pa.RecordBatch]:
            if held:
                yield batch_of([seq], [inside or seq < 0], ["\n".join(held)])

        for batch in batches:
            keys = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for begin, end in zip(edges, edges[1:]):
                if begin == end:
                    continue
                if keys[begin] != split:
                    yield from rest()
                    split, inside, seq, held = int(keys[begin]), batch.column(1)[begin].as_py(), -1, []
                value = batch.column(2).slice(begin, end - begin)
                through = int(inside) + np.cumsum(pc.count_substring(value, quote).to_numpy())
                quotes_before = np.r_[int(inside), through[:-1]]
                blank = pc.equal(pc.utf8_trim_whitespace(value), "").to_numpy(zero_copy_only=False)
                content = (quotes_before % 2 == 1) | ~blank
                value, starts = value.filter(pa.array(content)), np.flatnonzero(quotes_before[content] % 2 == 0)
                inside = bool(through[-1] % 2)
                first = int(starts[0]) if len(starts) else len(value)
                held += value.slice(0, first).to_pylist()
                if not len(starts):
                    continue
                if held:
                    yield batch_of([seq], [seq < 0], ["\n".join(held)])
                # all but the last record of the slice end in it
                if len(starts) > 1:
                    offsets = pa.array(starts - first, pa.int32())
                    whole = pa.ListArray.from_arrays(offsets, value.slice(first, int(starts[-1]) - first))
                    joined = pc.binary_join(whole, "\n")
                    n = len(starts) - 1
                    yield batch_of(np.arange(seq + 1, seq + 1 + n), np.zeros(n, dtype=bool), joined)
                seq += len(starts)
                held = value.slice(int(starts[-1])).to_pylist()
        yield from rest()

    return cut


#: Splits (a key and a mark each) that are sent to all tasks; beyond them lines move to their split's task.
MOST_SENT = 1_000_000


def _marked(lines: DataFrame, splits: DataFrame, most_sent: int) -> DataFrame:
    """(split, odd, value) with the lines of a split in one task and in order."""
    marks = splits.select("split", "odd")
    if splits.count() <= most_sent:
        # the lines stay where they were read
        return lines.select("split", "value").join(F.broadcast(marks), "split").select("split", "odd", "value")
    dealt = lines.select("split", "value", F.monotonically_increasing_id().alias("place")).join(marks, "split").repartition("split")
    return dealt.sortWithinPartitions("split", "place").select("split", "odd", "value")


def read_records(spark: SparkSession, path: str, quote: str = '"', header: bool = True, pos: str | None = None, most_sent: int = MOST_SENT) -> DataFrame:
    """One row a record: (record), the text with its line breaks, without the first of each file if ``header``.

    Blank lines between records are skipped. ``pos`` adds the number of the record, in
    the order of the paths and of the file; for that the files are read once more.
    """
    lines = _lines(spark, path)
    splits = _splits(lines, quote)
    made = _marked(lines, splits, most_sent).mapInArrow(_cutter(quote), _RECORDS)

    whole = made.filter(~F.col("part")).select("split", "seq", "record")
    # what crosses an edge: a record left open, then the lines that lead from split to split until it ends
    pieces = made.filter("part").join(splits.select("split", "file", "start"), "split")
    order = Window.partitionBy("file").orderBy("start", "seq")
    owned = pieces.withColumn("owner", F.sum((F.col("seq") >= 0).cast("int")).over(order))
    parts = F.array_sort(F.collect_list(F.struct("start", "seq", "split", "record")))
    crossing = owned.groupBy("file", "owner").agg(parts.alias("p")).select(
        F.col("p")[0]["split"].alias("split"), F.col("p")[0]["seq"].alias("seq"),
        F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record"))
    records = whole.unionByName(crossing)
    if not header and not pos:
        return records.select("record")

    if pos:
        counted = made.filter("seq >= 0").groupBy("split").agg(F.max("seq").alias("last"))
        n = F.coalesce(F.col("last") + 1, F.lit(0)) - F.when(F.col("header"), int(header)).otherwise(0)
        inside = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
        per_split = splits.join(counted, "split", "left").withColumn("n", n)
        files = per_split.groupBy("file").agg(F.sum("n").alias("rows"))
        before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
        files = files.select("file", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
        offset = F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))
        splits = materialize(per_split.join(files, "file").select("split", "header", offset.alias("offset")), "offsets")
    named = records.join(splits, "split")
    kept = named.filter(~(F.col("header") & (F.col("seq") == 0))) if header else named
    if not pos:
        return kept.select("record")
    place = F.col("offset") + F.col("seq") - (F.when(F.col("header"), 1).otherwise(0) if header else F.lit(0))
    return kept.select("record", place.alias(pos))
