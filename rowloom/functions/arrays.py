"""Functions on label lists, token-id sequences and numeric vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from rowloom.functions.text import _column


def indicator(labels: Column | str, classes: list[str]) -> Column:
    """0/1 vector over the ordered classes; a NULL in the list is no class."""
    labels = _column(labels)
    if not classes:
        return F.array().cast("array<int>")
    every = F.split(F.lit("\x00".join(classes)), "\x00")
    return F.transform(every, lambda name: F.when(labels.isNotNull(), F.coalesce(F.array_contains(labels, name), F.lit(False))).cast("int"))


def top_class(scores: Column | str, classes: list[str]) -> Column:
    """Class of the first highest score."""
    scores = _column(scores)
    every = F.split(F.lit("\x00".join(classes)), "\x00")
    return F.try_element_at(every, F.array_position(scores, F.array_max(scores)).cast("int"))


def cast_vector(vector: Column | str, element: str) -> Column:
    """Vector with another element type, such as smallint or double."""
    return _column(vector).cast(f"array<{element}>")


#: Values of a batch that are worked on together in Python.
PART_VALUES = 1 << 20


def bounded_parts(lists: pa.ListArray, amounts: np.ndarray, most: int) -> Iterator[pa.ListArray]:
    """The rows of a batch in order, in runs whose amounts add up to at most ``most``; a larger row is alone.

    What is made from a run is several times its size, and Spark limits only the batch.
    """
    edges = np.r_[0, np.cumsum(amounts, dtype=np.int64)]
    begin = 0
    while begin < len(lists):
        end = max(begin + 1, int(np.searchsorted(edges, edges[begin] + most, "right")) - 1)
        yield lists.slice(begin, end - begin)
        begin = end


def _filled(rows: int, width: int, places: pa.ListArray, amounts: np.ndarray | None) -> pa.ListArray:
    row = np.repeat(np.arange(rows), np.diff(places.offsets.to_numpy()))
    at = row * width + places.flatten().to_numpy(zero_copy_only=False)
    flat = np.bincount(at.astype(np.int64), weights=amounts, minlength=rows * width).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(flat))


def tally(width: int):
    """Column function (indices) -> vector of how often each index occurs."""

    @F.arrow_udf("array<int>")
    def fill(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for indices in batches:
            # a row costs its vector besides what it holds
            for part in bounded_parts(indices, np.diff(indices.offsets.to_numpy()) + width, 2 * PART_VALUES):
                yield _filled(len(part), width, part, None)

    return fill


def _counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for lists in bounded_parts(batch, np.diff(batch.offsets.to_numpy()), PART_VALUES):
            sizes = np.diff(lists.offsets.to_numpy())
            key = np.repeat(np.arange(len(lists), dtype=np.int64) << 32, sizes)
            key |= lists.flatten().to_numpy(zero_copy_only=False)
            found, n = np.unique(key, return_counts=True)
            places = np.searchsorted(found >> 32, np.arange(len(lists) + 1)).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array((found & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], names=["bucket", "n"])
            yield pa.ListArray.from_arrays(pa.array(places), pairs)


def sparse_counts(indices: Column) -> Column:
    """Each index that occurs in the list with how often it does, in order."""

    @F.arrow_udf("array<struct<bucket:int,n:bigint>>")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _counted(batches)

    return counted(_column(indices))


def frame_ids(ids: Column | str, limit: int = 512, start: int = 0, end: int = 2) -> Column:
    """Start and end ids around the sequence, cut so that the whole fits ``limit``."""
    return F.concat(
        F.array(F.lit(start)), F.slice(_column(ids), 1, limit - 2), F.array(F.lit(end))
    )


def pad_ids(ids: Column | str, length: Column, pad: int = 1) -> Column:
    """The sequence filled up with the padding id to the given length."""
    ids = _column(ids)
    return F.concat(ids, F.array_repeat(F.lit(pad), (length - F.size(ids)).cast("int")))


def validity_mask(ids: Column | str, length: Column) -> Column:
    """1 for every position of the sequence, 0 for padding up to ``length``."""
    n = F.size(_column(ids))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), (length - n).cast("int")))


def truncate(ids: Column | str, limit: int = 1024) -> Column:
    """The first ``limit`` positions."""
    return F.slice(_column(ids), 1, limit)
