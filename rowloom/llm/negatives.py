"""Hard-negative mining by vertical scans with branch and bound.

A shard holds its vectors by dimension. For an anchor the dimensions are read in order
of the anchor's descending magnitude, a few at a time. What the unread dimensions
can still add to a score lies between sums of the least and the greatest product
of the anchor's component with the shard's range in a dimension. With these bounds a
bitmap of candidates shrinks: for the positives to rows that can reach the k-th best
lower bound; for the negatives to rows that can lie in the window of a positive, and there reach its k-th best lower bound.
Rows that are left when all dimensions are read have exact scores.

Every vector goes to one shard and is read there once per pass; the anchors, a stated query set,
stream through every shard after its vectors, in order, so a task holds one shard and one batch.
The best of the shards are merged by rank. There are two passes: positives, then negatives within their windows.

Components are floor(scale * x), so scores are whole numbers and exact.

Defined results: rows with a null id or label, a null vector, or a null or non-finite component (scaled or not) take no
part; repeated rows count once, and rows with the anchor's own id are neither its positives nor its
negatives; rows that share an id and differ are rows of their own; rows meet rows of their own length only; ties go to the smaller
id; scores beyond 64 bits are kept at the nearest 64-bit number, windows too; an anchor without
positives, or a positive without negatives, has no rows; very long vectors make smaller shards; extra columns are
ignored whatever they are called; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.session import materialize

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: The window of a positive score p, in hundredths of it.
LEAST, GREATEST = 30, 90
SHARD_BYTES = 8 << 20
#: Dimensions read between two looks at the bounds.
STEP = 8
#: Sums of whole numbers below this are exact as doubles.
EXACT = float(1 << 53)
LONG = (-(1 << 63), (1 << 63) - 1)


def floored(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as a double that holds a whole number; NULL if the vector takes no part."""
    made = F.transform(vector, lambda x: x.cast("double") * scale)
    bad = F.exists(made, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    # beyond 2^52 a double is whole already, and too large for floor's 64 bits; adding 0 turns -0 into 0
    return F.when(vector.isNotNull() & ~bad, F.transform(made, lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x) + F.lit(0.0)))


class Shard:
    """Vectors by dimension, with ids, labels and the range of each dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids = ids
        self.names, self.labels = np.unique(labels, return_inverse=True)
        self.columns = np.ascontiguousarray(vectors.T)
        self.least, self.most = self.columns.min(axis=1, initial=np.inf), self.columns.max(axis=1, initial=-np.inf)
        self.reach = np.maximum(np.abs(self.least), np.abs(self.most))
        #: Components read, to tell how much the bounds save.
        self.read = 0

    def of_label(self, label: str) -> np.ndarray:
        at = np.searchsorted(self.names, label)
        return self.labels == at if at < len(self.names) and self.names[at] == label else np.zeros(len(self.ids), dtype=bool)

    def scan(self, anchor: np.ndarray, bitmap: np.ndarray, shrink) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of the rows of ``bitmap`` that ``shrink(lower, upper)`` keeps to the end."""
        columns, least, most = self.columns, self.least, self.most
        if not (np.abs(anchor) * self.reach).sum() < EXACT:
            anchor, columns, least, most = (_whole(x) for x in (anchor, columns, least, most))
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = np.stack([anchor * least, anchor * most])[:, order]
        low, high = (np.append(np.cumsum(e[::-1])[::-1], 0) for e in (ends.min(axis=0), ends.max(axis=0)))
        alive = np.flatnonzero(bitmap)
        score = np.zeros(len(alive), dtype=columns.dtype)
        for begin in range(0, len(order), STEP):
            if not len(alive):
                break
            dims = order[begin : begin + STEP]
            self.read += len(dims) * len(alive)
            some = columns[dims] if len(alive) == len(self.ids) else columns[np.ix_(dims, alive)]
            score = score + anchor[dims] @ some
            end = begin + len(dims)
            kept = shrink(score + low[end], score + high[end])
            alive, score = alive[kept], score[kept]
        return alive, score


def _whole(x: np.ndarray) -> np.ndarray:
    """The same whole numbers without a limit of size."""
    flat = np.empty(x.size, dtype=object)
    flat[:] = [int(v) for v in x.ravel()]
    return flat.reshape(x.shape)


def _kth(values: np.ndarray, k: int):
    """The k-th greatest value."""
    if values.dtype == object:
        return np.sort(values)[-k]
    return np.partition(values, len(values) - k)[len(values) - k]


def _first(shard: Shard, places: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(id, score) of the k best, ties by id."""
    best = np.lexsort((shard.ids[places], -scores))[:k]
    return [(int(shard.ids[places[i]]), min(max(int(scores[i]), LONG[0]), LONG[1])) for i in best]


def positives_of(shard: Shard, anchor_id: int, label: str, anchor: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best rows of the anchor's label."""

    def shrink(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        return upper >= _kth(lower, k) if len(lower) > k else np.ones(len(lower), dtype=bool)

    return _first(shard, *shard.scan(anchor, shard.of_label(label) & (shard.ids != anchor_id), shrink), k)


def window(score: int, least: int, greatest: int) -> tuple[int, int]:
    """The whole numbers n with least * score <= 100 * n <= greatest * score."""
    return -(-least * score // 100), greatest * score // 100


def negatives_of(
    shard: Shard, anchor_id: int, label: str, anchor: np.ndarray, windows: list[tuple[int, int]], k: int
) -> list[list[tuple[int, int]]]:
    """For each window the k best rows of other labels with a score in it."""
    wanted = [(low, high) for low, high in dict.fromkeys(windows) if low <= high]
    if not wanted:
        return [[] for _ in windows]

    def shrink(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        kept = np.zeros(len(lower), dtype=bool)
        for low, high in wanted:
            sure = lower[(lower >= low) & (upper <= high)]
            least = max(low, _kth(sure, k)) if len(sure) >= k else low
            kept |= (upper >= least) & (lower <= high)
        return kept

    places, scores = shard.scan(anchor, ~shard.of_label(label) & (shard.ids != anchor_id), shrink)
    found = {}
    for low, high in wanted:
        inside = (scores >= low) & (scores <= high)
        found[low, high] = _first(shard, places[inside], scores[inside], k)
    return [found.get(w, []) for w in windows]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of equal (shard, length, kind)."""
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy() for i in range(3)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:]):
            if begin < end:
                yield tuple(keys[:, begin].tolist()), batch.slice(begin, end - begin)


def _vectors(batch: pa.RecordBatch, length: int) -> np.ndarray:
    return batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, length)


def _through_shards(rows: DataFrame, anchors: DataFrame, shards: int, answer, schema: str) -> DataFrame:
    """``answer(shard, anchor rows)`` for all anchors in every shard.

    ``rows`` has row, shard, length, vec_id, label, vector; ``anchors`` the same without shard, and ``scores``.
    """
    everywhere = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint")))
    names = ["shard", "length", "kind", "row", "vec_id", "label", "vector", "scores"]
    stored = rows.withColumn("kind", F.lit(0)).withColumn("scores", F.lit(None).cast("array<bigint>"))
    asked = anchors.withColumn("kind", F.lit(1)).withColumn("shard", everywhere)
    both = stored.select(names).unionByName(asked.select(names))
    ordered = both.repartition(shards, "shard").sortWithinPartitions("shard", "length", "kind", "row")
    fields = [part.split(" ")[0] for part in schema.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, shard = None, [], None
        for (number, length, kind), batch in _runs(batches):
            if at != (number, length):
                at, waiting, shard = (number, length), [], None
            if kind == 0:
                waiting.append((batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(zero_copy_only=False), _vectors(batch, length)))
                continue
            if shard is None and waiting:
                shard, waiting = Shard(*(np.concatenate(x) for x in zip(*waiting, strict=True))), []
            if shard is None:
                continue
            found = []
            columns = [batch.column(c).to_pylist() for c in ("row", "vec_id", "label", "scores")]
            for row, vec_id, label, scores, vector in zip(*columns, _vectors(batch, length), strict=True):
                found += [(row, *line) for line in answer(shard, vec_id, label, vector, scores)]
            if found:
                made = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays(made, names=fields)

    return ordered.mapInArrow(scan, schema)


def mine(
    vectors: DataFrame, anchors: Column, vec_id: str = "vec_id", label: Column | str = "label", vector: str = "embedding",
    *, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, greatest: int = GREATEST,
    scale: int = SCALE, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    For each row for which ``anchors`` holds and each of its ``positives`` best rows of its label: the
    ``negatives`` best rows of other labels with a score between ``least`` and ``greatest`` hundredths of the positive's.
    """
    label = F.col(label) if isinstance(label, str) else label
    narrow = vectors.select(
        F.col(vec_id).cast("bigint").alias("vec_id"), label.cast("string").alias("label"), floored(F.col(vector), scale).alias("vector"),
        F.coalesce(anchors, F.lit(False)).alias("asks"),
    ).dropna(subset=["vec_id", "label", "vector"])
    # one row of each kind, numbered and dealt to shards once for both passes
    rows = narrow.groupBy("vec_id", "label", "vector").agg(F.max("asks").alias("asks")).select(
        F.monotonically_increasing_id().alias("row"), F.size("vector").alias("length"), "*")
    rows = materialize(rows, "vectors")
    n_bytes = rows.agg(F.sum(8 * F.greatest("length", F.lit(1))).alias("n")).first()["n"] or 0
    shards = max(1, -(-n_bytes // shard_bytes))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards).cast("bigint")))
    asked = rows.filter("asks").withColumn("scores", F.lit(None).cast("array<bigint>"))

    def near(shard: Shard, own: int, name: str, anchor: np.ndarray, _) -> list[tuple]:
        return positives_of(shard, own, name, anchor, positives)

    def hard(shard: Shard, own: int, name: str, anchor: np.ndarray, scores: list[int]) -> list[tuple]:
        found = negatives_of(shard, own, name, anchor, [window(s, least, greatest) for s in scores], negatives)
        return [(place, *line) for place, lines in enumerate(found) for line in lines]

    first = _through_shards(dealt, asked, shards, near, "row bigint, positive_id bigint, positive_score bigint")
    by_score = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id")
    first = first.withColumn("place", F.row_number().over(by_score) - 1).filter(F.col("place") < positives)
    first = materialize(first, "positives")
    scores = F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"])
    asked = rows.filter("asks").join(first.groupBy("row").agg(scores.alias("scores")), "row")

    second = _through_shards(dealt, asked, shards, hard, "row bigint, place bigint, negative_id bigint, negative_score bigint")
    by_score = Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id")
    second = second.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= negatives)
    owners = rows.filter("asks").select("row", F.col("vec_id").alias("anchor_id"))
    named = first.withColumn("place", F.col("place").cast("bigint")).join(owners, "row")
    return second.join(named, ["row", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
