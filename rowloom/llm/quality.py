"""Quality of a text, learned from trusted positives and unlabelled text.

The loss is the non-negative risk of positive-unlabelled learning,
pi * E_P[l(g)] + max(0, E_U[l(-g)] - pi * E_P[l(-g)]) with the squared loss l(z) = (1 - z)^2 / 4, for a linear g. All of
it depends on the texts through the second moments of their features alone, so one pass over all positives and all
unlabelled rows gives two small matrices, and Adam minimises the risk on these; where the second part
turns negative, the step goes up along it instead. Labels of 0 are never read.

The prior pi is estimated from positives and unlabelled text too. The rows are halved by their ids; a least-squares
score that tells positives from unlabelled rows is learned on each half and counted into bins on the other. A region where
the score is high holds at most pi of its share of the positives from unlabelled text, plus the negatives in it; the
region with the least upper confidence bound of (share of unlabelled rows) / (share of positives) gives pi.

A text is described by the shares of its bytes and of hashed pairs of bytes, by how its words and lines repeat, and by
lengths, as whole numbers from 0 to 1023; so the moments are exact sums, the same in any order of the tasks.

Defined results: null is an empty text, which gets the score of a text without features; a text of any length counts
as one row and is described whole; without positives every score is 0.5; an id with several labels counts as positive if any of
them is 1, and all rows of such an id are positives; repeated rows count as often as they come; a row with a null id is
unlabelled; labels without a document or with a null id or value teach nothing; positives beyond ``positives`` ids are left out by
the hash of the id, equal hashes by id, and stay unlabelled; where one half has no positives the other gives the prior, and 0.5 if
neither does; an empty table gets no rows; other columns are kept, and one called like the score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.llm.words import chunks, joined_hash

#: The most ids of positives that are sent to the tasks.
POSITIVES = 100_000
CHUNK_BYTES = 1 << 20
STEPS = 600
#: Buckets of byte pairs, a power of two, and the greatest value of a feature.
PAIRS, FULL = 64, 1023
WIDTH = 256 + PAIRS + 8
#: Base of the hashes of words and lines, an odd number, and its inverse modulo 2^64.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
#: Least spread of a feature, and the weight of squared weights in the loss.
FLOOR, DECAY = 0.03, 0.03
#: Bins of the score between -RANGE and RANGE for the prior, and the chance that its bound fails.
BINS, RANGE, DELTA = 2048, 2.0, 0.1
#: Tasks that sum moments, for each core.
TASKS = 4


def _powers(base: int, n: int) -> np.ndarray:
    """base ^ 0 to base ^ (n - 1) modulo 2^64."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, out=out)


def _prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of mixed bytes times powers of FACTOR, modulo 2^64, before each place and at the end."""
    terms = _powers(FACTOR, data.size)
    terms *= joined_hash(np.arange(256, dtype=np.uint64), np.uint64(1))[data]
    return np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(terms, out=terms)])


def _runs(data: np.ndarray, sums: np.ndarray, back: np.ndarray, gap: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: pieces between gaps, distinct pieces, pieces equal to the one before.

    The hash of a piece is a difference of two prefix sums, moved to power 0, with its length; so its cost does not
    grow with the length of the longest piece.
    """
    n = edges.size - 1
    apart = gap[data]
    turns = np.flatnonzero(apart[1:] != apart[:-1]) + 1
    if data.size and not apart[0]:
        turns = np.concatenate([[0], turns])
    begin, end = turns[0::2], turns[1::2]
    hashes = joined_hash((end - begin).astype(np.uint64), (sums[end] - sums[begin]) * back[begin])
    owner = np.searchsorted(edges, begin, side="right") - 1
    count = np.bincount(owner, minlength=n)
    keyed = joined_hash(owner.astype(np.uint64), hashes)
    _, first = np.unique(keyed, return_index=True)
    distinct = np.bincount(owner[first], minlength=n)
    same = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    again = np.bincount(owner[1:][same], minlength=n)
    return count, distinct, again


def features(texts: list[bytes | None]) -> np.ndarray:
    """One row of whole numbers from 0 to FULL for each text."""
    n = len(texts)
    sizes = np.array([len(t or b"") + 1 for t in texts], dtype=np.int64)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join([(t or b"") + b"\n" for t in texts]), dtype=np.uint8)
    mixed = np.arange(1 << 16, dtype=np.uint64) * np.uint64(FACTOR)
    bucket = (mixed >> np.uint64(65 - PAIRS.bit_length())).astype(np.uint8)
    pairs = bucket[data[:-1].astype(np.uint16) << 8 | data[1:]]
    shares = np.empty((n, 256 + PAIRS))
    for i, (begin, end) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        shares[i, :256] = np.bincount(data[begin:end], minlength=256)
        shares[i, 256:] = np.bincount(pairs[begin : end - 1], minlength=PAIRS)
    shares[:, :256] /= sizes[:, None]
    shares[:, 256:] /= np.maximum(sizes - 1, 1)[:, None]
    space, line = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
    space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    line[0x0A] = True
    extra = []
    sums, back = _prefix_sums(data), _powers(INVERSE, data.size)
    for gap in (space, line):
        count, distinct, again = _runs(data, sums, back, gap, edges)
        some = np.maximum(count, 1)
        extra += [np.sqrt(again / some), np.sqrt(1 - distinct / some), np.log1p(count) / 10, np.sqrt((sizes - 1) / some) / 10]
    return np.rint(FULL * np.clip(np.column_stack([np.sqrt(shares), *extra]), 0, 1))


def moments(rows: np.ndarray) -> np.ndarray:
    """Sums of the products of all features, and of each with one, which comes last."""
    rows = np.column_stack([rows, np.ones(len(rows))])
    return rows.T @ rows


class Space:
    """Two moment matrices, divided by their counts, over features of mean 0 and spread 1."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray):
        positive, unlabelled = positive / positive[-1, -1], unlabelled / unlabelled[-1, -1]
        both = (positive + unlabelled) / 2
        self.mean = both[-1, :-1]
        self.spread = np.maximum(np.sqrt(np.maximum(np.diag(both)[:-1] - self.mean**2, 0)), FLOOR)
        change = np.diag(np.append(1 / self.spread, 1.0))
        change[-1, :-1] = -self.mean / self.spread
        self.p, self.u = (change.T @ m @ change for m in (positive, unlabelled))
        self.decay = np.append(np.full(len(self.mean), DECAY), 0.0)

    def model(self, weights: np.ndarray) -> dict:
        return {"weights": weights, "mean": self.mean, "spread": self.spread}


def loss(m: np.ndarray, w: np.ndarray, sign: int) -> tuple[float, np.ndarray]:
    """Mean of (1 - sign * g)^2 / 4 over the rows behind ``m``, and its gradient."""
    pulled = m @ w
    return float((1 - 2 * sign * pulled[-1] + w @ pulled) / 4), (pulled - sign * m[-1]) / 2


def negative_part(space: Space, w: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """Risk of the negatives, E_U[l(-g)] - prior * E_P[l(-g)], and its gradient."""
    (u, du), (p, dp) = loss(space.u, w, -1), loss(space.p, w, -1)
    return u - prior * p, du - prior * dp


def minimise(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, rate: float = 0.01) -> dict:
    """Linear score of least non-negative risk, from moments."""
    space = Space(positive, unlabelled)
    w, m, v = (np.zeros(len(positive)) for _ in range(3))
    for step in range(1, steps + 1):
        negative, part = negative_part(space, w, prior)
        gradient = -part if negative < 0 else part + prior * loss(space.p, w, 1)[1]
        gradient = gradient + space.decay * w
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return space.model(w)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS) -> dict:
    """``minimise`` over rows of features."""
    return minimise(moments(positive.astype(np.float64)), moments(unlabelled.astype(np.float64)), prior, steps)


def separate(positive: np.ndarray, unlabelled: np.ndarray) -> dict:
    """Least-squares score that tells positives from unlabelled rows, from moments."""
    space = Space(positive, unlabelled)
    both = (space.p + space.u) / 2 + np.diag(space.decay)
    return space.model(np.linalg.solve(both, (space.p[-1] - space.u[-1]) / 2))


def linear(rows: np.ndarray, model: dict) -> np.ndarray:
    """The linear score g of each row of features."""
    return (rows - model["mean"]) / model["spread"] @ model["weights"][:-1] + model["weights"][-1]


def bins_of(g: np.ndarray) -> np.ndarray:
    return np.clip(((g + RANGE) * (BINS / (2 * RANGE))).astype(np.int64), 0, BINS - 1)


def share_of_positives(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The prior, from the counts of both kinds in bins of the score."""
    p, u = (np.cumsum(c[::-1]) for c in (positive, unlabelled))
    n_p, n_u = int(p[-1]), int(u[-1])
    p, u = p[p > 0] / n_p, u[p > 0] / n_u
    slack = sum(np.sqrt(np.log(4 / DELTA) / 2 / n) for n in (n_p, n_u))
    best = int(np.argmin((u + slack) / p))
    return float(min(1.0, max(u[best] / p[best], 1 / n_u)))


def _scored(texts: list[bytes | None], model: dict | None) -> np.ndarray:
    if model is None or not texts:
        return np.full(len(texts), 0.5)
    return 1 / (1 + np.exp(-np.clip(2 * linear(features(texts) / FULL, model), -500, 500)))


def _summed(rows: DataFrame) -> dict[tuple[bool, int], np.ndarray]:
    """Moments of the rows (trusted, half, text) by (trusted, half), in units of FULL; exact in any order.

    A task sums its texts; its matrices go row by row to the tasks that add equal rows up, so the driver
    gets a few times WIDTH rows of WIDTH numbers, whatever the number of texts.
    """
    schema = "trusted boolean, half int, place int, sums binary"

    def batch(parts: dict) -> pa.RecordBatch:
        columns = list(zip(*[(*k, v.tobytes()) for k, v in parts.items()], strict=True)) or [()] * 4
        kinds = (pa.bool_(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["trusted", "half", "place", "sums"])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[bool, int], np.ndarray] = {}
        for piece in chunks(batches, "text", CHUNK_BYTES):
            made = features(piece.column("text").cast(pa.binary()).to_pylist())
            kind = np.array(piece.column("trusted").to_pylist(), dtype=bool)
            half = np.array(piece.column("half").to_pylist(), dtype=np.int64)
            for key in {(t, h) for t, h in zip(kind.tolist(), half.tolist(), strict=True)}:
                found = moments(made[(kind == key[0]) & (half == key[1])]).astype(np.int64)
                sums[key] = sums[key] + found if key in sums else found
        yield batch({(*key, i): line for key, matrix in sums.items() for i, line in enumerate(matrix)})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[bool, int, int], np.ndarray] = {}
        for piece in batches:
            for *key, line in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                found = np.frombuffer(line, dtype=np.int64)
                key = tuple(key)
                sums[key] = sums[key] + found if key in sums else found
        yield batch(sums)

    tasks = TASKS * rows.sparkSession.sparkContext.defaultParallelism
    partial = rows.coalesce(tasks).mapInArrow(describe, schema)
    out: dict[tuple[bool, int], np.ndarray] = {}
    for r in partial.repartition("place").mapInArrow(add, schema).toLocalIterator():
        matrix = out.setdefault((r["trusted"], r["half"]), np.zeros((WIDTH + 1, WIDTH + 1), dtype=np.int64))
        matrix[r["place"]] += np.frombuffer(r["sums"], dtype=np.int64)
    return out


def _unit(sums: np.ndarray) -> np.ndarray:
    """Moments of features between 0 and 1."""
    scale = np.append(np.full(WIDTH, 1 / FULL), 1.0)
    return sums * scale[:, None] * scale[None, :]


def _prior(rows: DataFrame, models: dict[int, dict]) -> float:
    """Mean estimate over the halves, each counted with the score learned on the other."""
    sent = rows.sparkSession.sparkContext.broadcast(models)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[bool, int], np.ndarray] = {}
        for piece in chunks(batches, "text", CHUNK_BYTES):
            made = features(piece.column("text").cast(pa.binary()).to_pylist()) / FULL
            kind = np.array(piece.column("trusted").to_pylist(), dtype=bool)
            half = np.array(piece.column("half").to_pylist(), dtype=np.int64)
            for h, model in sent.value.items():
                places = bins_of(linear(made, model))
                for t in (False, True):
                    found = np.bincount(places[(kind == t) & (half == 1 - h)], minlength=BINS)
                    counts[t, 1 - h] = counts.get((t, 1 - h), 0) + found
        lines = [(t, h, i, int(c[i])) for (t, h), c in counts.items() for i in np.flatnonzero(c).tolist()]
        columns = list(zip(*lines, strict=True)) or [()] * 4
        kinds = (pa.bool_(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["trusted", "half", "bin", "n"])

    found = rows.mapInArrow(count, "trusted boolean, half int, bin int, n bigint").groupBy("trusted", "half", "bin").agg(F.sum("n").alias("n"))
    counts = np.zeros((2, 2, BINS), dtype=np.int64)
    for r in found.collect():  # at most 4 * BINS rows
        counts[int(r["trusted"]), r["half"], r["bin"]] = r["n"]
    # positives are unlabelled text as well
    shares = [share_of_positives(counts[1, h], counts[0, h] + counts[1, h]) for h in (0, 1) if counts[1, h].any()]
    return sum(shares) / len(shares) if shares else 0.5


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
          positives: int = POSITIVES) -> dict | None:
    """Model (with its ``prior``) from documents and labels (doc_id, 1 for good); None if there is nothing to learn from."""
    spot = F.xxhash64("doc_id")
    trusted = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")).filter("label = 1").select("doc_id").dropna().distinct()
    n = trusted.count()
    if n > positives:
        # by the hash first, so that no task sorts much more than it keeps
        trusted = trusted.filter(F.pmod(spot, F.lit(1 << 30)) <= int((1 << 30) * positives / n)).orderBy(spot, "doc_id").limit(positives)
    trusted = trusted.withColumn("trusted", F.lit(True))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(trusted), "doc_id", "left")
    rows = rows.select(F.coalesce("trusted", F.lit(False)).alias("trusted"), F.pmod(spot, F.lit(2)).cast("int").alias("half"), "text")
    sums = _summed(rows)
    none = np.zeros((WIDTH + 1, WIDTH + 1), dtype=np.int64)
    part = {h: (sums.get((True, h), none), sums.get((True, h), none) + sums.get((False, h), none)) for h in (0, 1)}
    whole = [_unit(part[0][k] + part[1][k]) for k in (0, 1)]
    if not whole[0][-1, -1]:
        return None
    models = {h: separate(_unit(p), _unit(u)) for h, (p, u) in part.items() if p[-1, -1]}
    prior = _prior(rows, models)
    return {**minimise(*whole, prior), "prior": prior}


def score(docs: DataFrame, model: dict | None, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the probability that a text is of good quality."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != name]
    schema = T.StructType([*docs.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, T.StructField(name, T.DoubleType())])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, text, CHUNK_BYTES):
            made = _scored(piece.column(text).cast(pa.binary()).to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), pa.array(made, pa.float64())], names=[*kept, name])

    return docs.mapInArrow(rate, schema)
