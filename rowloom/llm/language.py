"""Language of a text: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language inside the tasks and adds the counts up in
Spark; the driver receives at most ``buckets`` times the number of languages
figures and turns them into a matrix of log-probabilities, which is broadcast.
Scoring treats a batch as a sparse matrix of counts, documents by buckets, and multiplies it with
that matrix, some 65 536 n-grams at a time: what a slice needs is bounded, however long a text is
and however many languages there are.

Texts are lower-cased; every run of characters that are no letters or marks is
one space. n-grams hold ``orders`` code points and may begin or end with that
space.

Defined results: a text that is null or has no letter gives ``und`` and score 0;
so does every text if nothing could be learned. Ties go to the smaller language
name. Rows without a text or a language teach nothing; repeated rows teach and are scored each. Bytes that are no
valid UTF-8 are no letters. Very long texts are read whole. A null id is an id like any other here; in the query it has no fold, is held out and teaches nothing. An empty table
gives no rows. Extra columns pass through ``predict`` untouched; its two new columns replace columns of those names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.llm.words import chunks, restored

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Bound of the broadcast matrix: BUCKETS * MOST_LANGUAGES numbers of 8 bytes.
MOST_LANGUAGES = 400
CHUNK_BYTES = 1 << 20
UNDETERMINED = "und"
#: n-grams counted at a time, and cells of the matrix (8 bytes each) taken at a time.
SLICE = 1 << 16
CELLS = 1 << 21


def letters() -> np.ndarray:
    """For every code point whether it is a letter (1) or a mark (2), packed by _packed."""
    kinds = {"L": 1, "M": 2}
    return np.array([kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], dtype=np.uint8)


def _points(texts: list[str | None], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cleaned code points of all texts, a space around each; where each text begins; which have a letter."""
    low = [(t or "").lower() for t in texts]
    points = np.frombuffer("".join([f"\n{t}\n" for t in low]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = kinds[points]
    edges = np.concatenate([[0], np.cumsum([len(t) + 2 for t in low])])
    has = np.maximum.reduceat(kind == 1, edges[:-1])
    inside = kind > 0
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # the first character after a word stands for the gap
    keep[edges[:-1]] = True
    points = np.where(inside, points, np.uint32(32))[keep]
    return points, np.concatenate([[0], np.cumsum(np.add.reduceat(keep, edges[:-1], dtype=np.int64))]), has


def _hashed(clean: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each place, as far as it ends inside."""
    n = max(0, clean.size - order + 1)
    value = np.full(n, order, dtype=np.uint32)
    for i in range(order):
        value = (value ^ clean[i : i + n]) * np.uint32(0x85EBCA6B)
        value ^= value >> np.uint32(15)
    return (value & np.uint32(buckets - 1)).astype(np.int32)


def _grams(clean: np.ndarray, edges: np.ndarray, order: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text number and bucket of every n-gram that lies inside its text, ``SLICE`` at a time."""
    for begin in range(0, clean.size - order + 1, SLICE):
        end = min(begin + SLICE, clean.size - order + 1)
        first = int(np.searchsorted(edges, begin, side="right")) - 1
        last = int(np.searchsorted(edges, end, side="left"))
        sizes = np.diff(np.clip(edges[first : last + 1], begin, end))
        text = np.repeat(np.arange(first, last), sizes)
        inside = np.arange(begin, end) + order <= edges[text + 1]
        yield text[inside], _hashed(clean[begin : end + order - 1], order, buckets)[inside]


def _read(column: pa.Array) -> list[str | None]:
    return [None if t is None else t.decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()]


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # buckets x languages
    prior: np.ndarray
    kinds: np.ndarray
    orders: tuple[int, ...]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages or not texts:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        clean, edges, has = _points(texts, self.kinds)
        buckets = self.logs.shape[0]
        total = np.tile(self.prior, (len(texts), 1))
        step = max(1, CELLS // len(self.languages))
        for order in self.orders:
            for text, bucket in _grams(clean, edges, order, buckets):
                cells, n = np.unique(text * buckets + bucket, return_counts=True)
                for i in range(0, cells.size, step):
                    owner, which = np.divmod(cells[i : i + step], buckets)
                    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                    total[owner[starts]] += np.add.reduceat(self.logs[which] * n[i : i + step, None], starts, axis=0)
        best = total.argmax(axis=1)
        top = total[np.arange(len(texts)), best]
        score = 1.0 / np.exp(total - top[:, None]).sum(axis=1)
        return (
            [self.languages[b] if h else UNDETERMINED for b, h in zip(best, has, strict=True)],
            [float(s) if h else 0.0 for s, h in zip(score, has, strict=True)],
        )


def train(docs: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> Model:
    """Learn from all rows of ``docs``; ``buckets`` is a power of two.

    Raises ValueError beyond ``MOST_LANGUAGES`` languages: the matrix would have no bound.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).dropna()
    kinds = letters()
    sent = docs.sparkSession.sparkContext.broadcast(kinds)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for piece in chunks(batches, "text", CHUNK_BYTES):
            langs = np.array(piece.column("lang").to_pylist(), dtype=object)
            every = np.array(_read(piece.column("text")), dtype=object)
            for name in sorted(set(langs)):
                own = list(every[langs == name])
                clean, edges, has = _points(own, sent.value)
                mine = counts.setdefault(name, np.zeros(buckets, dtype=np.int64))
                texts[name] = texts.get(name, 0) + int(has.sum())
                for order in orders:
                    for _, bucket in _grams(clean, edges, order, buckets):
                        mine += np.bincount(bucket, minlength=buckets)
        for name, mine in counts.items():
            used = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * (used.size + 1), pa.string()), pa.array(np.append(used, -1), pa.int32()),
                    pa.array(np.append(mine[used], texts[name]), pa.int64()),
                ],
                names=["lang", "bucket", "n"],
            )

    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])
    found = rows.mapInArrow(count, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = found.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("counts"))
    each = packed.limit(MOST_LANGUAGES + 1).collect()
    if len(each) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: the broadcast matrix would have no bound")
    each = sorted((r for r in each), key=lambda r: r["lang"])
    logs = np.zeros((buckets, len(each)))
    prior = np.zeros(len(each))
    for k, row in enumerate(each):
        which, n = np.array(row["buckets"]), np.array(row["counts"], dtype=np.float64)
        prior[k] = np.log(n[which == -1].sum() + 1)
        column = np.full(buckets, 0.5)
        column[which[which >= 0]] += n[which >= 0]
        logs[:, k] = np.log(column / column.sum())
    return Model([r["lang"] for r in each], logs, prior, kinds, orders)


def predict(docs: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``docs`` with the predicted language and its posterior probability."""
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))
    kept = [c for c in docs.columns if c not in (lang_pred, score)]
    schema = T.StructType([
        *docs.select(*[F.col(f"`{c}`") for c in kept]).schema.fields,
        T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType()),
    ])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = restored(Model, sent.value)
        for piece in chunks(batches, text, CHUNK_BYTES):
            names, scores = known.predict(_read(piece.column(text)))
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(c) for c in kept), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*kept, lang_pred, score],
            )

    return docs.select(*[F.col(f"`{c}`") for c in {**dict.fromkeys(kept), text: None}]).mapInArrow(label, schema)
