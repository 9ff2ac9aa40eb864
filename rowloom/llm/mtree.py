"""Exact top-k by inner product with an M-tree and best-first search.

Inner products become distances: with one more coordinate, sqrt(M^2 - |x|^2) for a
stored vector and 0 for a query, where M is the largest norm, the squared Euclidean distance is
|q|^2 + M^2 - 2 q.x, so the nearest is the largest product.

Every shard of the vectors is an M-tree of pages. A leaf page holds vectors and
their distance to the page's routing object; an inner page holds for each child a
routing object, a covering radius and the distance to its own routing object.
The search takes the page with the least possible distance first and leaves out,
by the stored parent distances and the triangle inequality, entries whose distance need
not be computed. A shard returns its best k for each query; the best k of
those over all shards are the answer.

Every distinct vector goes to one shard, where a task builds the tree once; all queries, a stated set, stream through it
behind the vectors, ``query_block`` at a time. The k-th best score within a small sample of the vectors is
a bound that a search starts with; only what is surely worse is left out, so the bound changes no result.

Components become floor(scale * x) as whole numbers, so scores are exact; bounds are
floating point numbers with a margin.

Defined results: vectors that are null, or that hold null, NaN or infinite
components, take no part, as query or candidate; ids that are null and vectors without components neither; repeated
rows count once, and rows with the query's own id are not its candidates; rows that share an id and differ are rows of their own; a
query meets vectors of its own length only; ties go to the smaller id; scores
beyond 64 bits are kept at the nearest 64-bit number; texts and other columns are ignored, whatever they are called; an empty table
gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.negatives import _runs, _vectors
from rowloom.session import materialize

SCALE = 1024
PAGE = 64
SHARD_ROWS = 8_192
QUERY_BLOCK = 1_024
#: Vectors of the sample that gives a search its first bound.
SAMPLE = 256
#: Products of whole numbers below this stay within 64 bits for up to 2^15 components.
SMALL = 1 << 24
MARGIN = 1e-9
#: The least 64-bit number.
LEAST = -(1 << 63)


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """scale * x of each component as a double, still to be floored; NULL if the vector takes no part."""
    made = F.transform(vector, lambda x: x.cast("double") * scale)
    bad = F.exists(made, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(vector.isNotNull() & ~bad, made)


class MTree:
    """An M-tree over rows of ``points`` (augmented vectors), built by splitting around two far objects."""

    def __init__(self, points: np.ndarray, page: int = PAGE):
        self.points = points
        self.page = page
        #: Rows offered and distances computed, to tell how much the bounds save.
        self.offered = self.computed = 0
        #: Per page: routing row, radius, and rows (leaf) or children (inner) with their distances to the routing row.
        self.routing: list[int] = []
        self.radius: list[float] = []
        self.entries: list[np.ndarray] = []
        self.to_parent: list[np.ndarray] = []
        self.leaf: list[bool] = []
        self.root = self._build(np.arange(len(points)))

    def _distance(self, row: int, rows: np.ndarray) -> np.ndarray:
        apart = self.points[rows] - self.points[row]
        return np.sqrt(np.einsum("ij,ij->i", apart, apart))

    def _add(self, routing, radius, entries, to_parent, leaf) -> int:
        self.routing.append(routing)
        self.radius.append(radius)
        self.entries.append(entries)
        self.to_parent.append(to_parent)
        self.leaf.append(leaf)
        return len(self.routing) - 1

    def _build(self, rows: np.ndarray) -> int:
        """Number of the page that covers ``rows``; parts are halves by the nearer of two far rows."""
        routing = int(rows[0])
        distance = self._distance(routing, rows)
        if rows.size <= self.page:
            return self._add(routing, float(distance.max(initial=0)), rows, distance, True)
        parts, want = [rows], -(-rows.size // self.page)
        while len(parts) < min(want, self.page):
            parts.sort(key=len)
            largest = parts.pop()
            a = int(largest[self._distance(int(largest[0]), largest).argmax()])
            from_a = self._distance(a, largest)
            b = int(largest[from_a.argmax()])
            side = np.argsort(from_a - self._distance(b, largest), kind="stable")
            parts += [largest[side[: side.size // 2]], largest[side[side.size // 2 :]]]
        children = np.array([self._build(p) for p in parts])
        middles = np.array([self.routing[c] for c in children])
        return self._add(routing, float(distance.max()), children, self._distance(routing, middles), False)

    def search(self, query: np.ndarray, keep, bound: float = np.inf) -> None:
        """Offer ``keep(rows)`` the rows of every page that may hold one not farther than ``bound``.

        ``keep`` returns the distance beyond which nothing more is wanted.
        """
        points = self.points
        first = float(np.linalg.norm(query - points[self.routing[self.root]]))
        queue = [(max(0.0, first - self.radius[self.root]), self.root, first)]
        while queue:
            least, page, middle = heapq.heappop(queue)
            if least > bound:
                break
            near, entries = self.to_parent[page], self.entries[page]
            if self.leaf[page]:
                rows = entries[np.abs(middle - near) <= bound]
                if rows.size:
                    self.offered += rows.size
                    bound = min(bound, keep(rows))
                continue
            radii = np.array([self.radius[c] for c in entries])
            open_ = np.flatnonzero(np.abs(middle - near) - radii <= bound)
            if not open_.size:
                continue
            apart = points[[self.routing[c] for c in entries[open_]]] - query
            self.computed += open_.size
            distance = np.sqrt(np.einsum("ij,ij->i", apart, apart))
            for c, d, r in zip(entries[open_].tolist(), distance.tolist(), radii[open_].tolist(), strict=True):
                if d - r <= bound:
                    heapq.heappush(queue, (max(0.0, d - r), c, d))


def _products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact products, kept within 64 bits."""
    if rows.dtype != object:
        return rows @ query
    return np.array([max(LEAST, min(-LEAST - 1, int(x))) for x in rows.dot(query)], dtype=np.int64)


def _integers(vectors: np.ndarray) -> np.ndarray:
    """Floors as int64, or as Python integers if products might not fit."""
    floors = np.floor(vectors)
    if np.abs(floors).max(initial=0) < SMALL and floors.shape[1] <= 1 << 15:
        return floors.astype(np.int64)
    return np.array([[int(x) for x in row] for row in floors], dtype=object).reshape(floors.shape)


class Shard:
    """The vectors of a shard under one tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, page: int = PAGE):
        self.ids, self.vectors = ids, vectors
        real = vectors.astype(np.float64)
        self.unit = max(1.0, np.abs(real).max(initial=0))
        real = real / self.unit
        norms = np.einsum("ij,ij->i", real, real)
        self.top = norms.max(initial=0)
        self.tree = MTree(np.column_stack([real, np.sqrt(np.maximum(self.top - norms, 0))]), page)

    def best(self, query_id: int, query: np.ndarray, k: int, floor: int | None = None) -> list[tuple[int, int]]:
        """(id, score) of the best k, without the query's own id; scores below ``floor`` may be missing."""
        vectors = self.vectors
        if vectors.dtype != query.dtype:
            vectors, query = vectors.astype(object), query.astype(object)
        unit = max(1.0, np.abs(query.astype(np.float64)).max(initial=0))
        probe = np.append(query.astype(np.float64) / unit, 0.0)
        # distances are those of a query of its own scale: the order of the products stays
        reach = float(probe @ probe + self.top)
        found: list[tuple[int, int]] = []

        def distance(score: int) -> float:
            if score <= LEAST:  # all that is less counts as equal
                return np.inf
            return float(np.sqrt(max(0.0, reach - 2 * (score / unit / self.unit)) + MARGIN * max(1.0, reach)))

        def keep(rows: np.ndarray) -> float:
            nonlocal found
            scores = _products(vectors[rows], query)
            found += [(-s, i) for s, i in zip(scores.tolist(), self.ids[rows].tolist(), strict=True) if i != query_id]
            if len(found) < k:
                return np.inf
            found = heapq.nsmallest(k, found)
            return distance(-found[-1][0])

        self.tree.search(probe, keep, np.inf if floor is None else distance(floor))
        return [(i, -negative) for negative, i in heapq.nsmallest(k, found)]


def first_bound(sample: tuple[np.ndarray, np.ndarray] | None, query_id: int, query: np.ndarray, k: int) -> int | None:
    """The k-th best score within the sample: the answer holds no lesser one."""
    if sample is None:
        return None
    ids, vectors = sample
    others = ids != query_id
    if others.sum() < k:
        return None
    if vectors.dtype != query.dtype:
        vectors, query = vectors.astype(object), query.astype(object)
    return int(np.sort(_products(vectors[others], query))[-k])


def top_k(vectors: DataFrame, queries: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10, scale: int = SCALE,
          shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK, page: int = PAGE, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best for every row for which ``queries`` holds."""
    narrow = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), scaled(F.col(vector), scale).alias("vector"), queries.alias("asks"))
    narrow = narrow.filter("vector IS NOT NULL AND vec_id IS NOT NULL AND size(vector) > 0")
    # one row of each kind, so that no repeated row fills a shard
    rows = narrow.groupBy("vec_id", "vector").agg(F.max("asks").alias("asks")).withColumn("length", F.size("vector"))
    rows = materialize(rows, "vectors")
    spot = F.xxhash64("vec_id", "vector")
    shards = max(1, -(-rows.count() // shard_rows))
    few = rows.select("length", "vec_id", "vector").orderBy(spot, "vec_id").limit(sample).collect()
    samples = {
        n: (np.array([r["vec_id"] for r in few if r["length"] == n], dtype=np.int64), _integers(np.array([r["vector"] for r in few if r["length"] == n])))
        for n in {r["length"] for r in few}
    }
    sent = rows.sparkSession.sparkContext.broadcast(samples)
    everywhere = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint")))
    names = ["shard", "length", "kind", "vec_id", "vector"]
    stored = rows.withColumn("kind", F.lit(0)).withColumn("shard", F.pmod(spot, F.lit(shards).cast("bigint")))
    asked = rows.filter("asks").withColumn("kind", F.lit(1)).withColumn("shard", everywhere)
    ordered = stored.select(names).unionByName(asked.select(names)).repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "length", "kind", "vec_id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, shard = None, [], None
        for (number, length, kind), batch in _runs(batches):
            if at != (number, length):
                at, waiting, shard = (number, length), [], None
            if kind == 0:
                waiting.append((batch.column("vec_id").to_numpy(), _vectors(batch, length)))
                continue
            if waiting:
                ids, points = (np.concatenate(x) for x in zip(*waiting, strict=True))
                shard, waiting = Shard(ids, _integers(points), page), []
            if shard is None:
                continue
            for begin in range(0, batch.num_rows, query_block):
                some = batch.slice(begin, query_block)
                found = []
                for query_id, query in zip(some.column("vec_id").to_pylist(), _integers(_vectors(some, length)), strict=True):
                    floor = first_bound(sent.value.get(length), query_id, query, k)
                    found += [(query_id, *pair) for pair in shard.best(query_id, query, k, floor)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])

    near = ordered.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
