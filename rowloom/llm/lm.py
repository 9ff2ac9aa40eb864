"""Language-model scores from a weighted backoff automaton.

The n-grams of the training texts are counted in Spark. Documents are taken in
blocks; a block asks for the counts of the distinct n-grams it holds, keyed by
64-bit hashes and dealt by key to shards, a shard adds up what all blocks have
counted and answers each block. So the whole model, which grows with the
corpus, lies spread over the shards, and each block gets the part that its texts can
reach.

From that part a block builds an automaton. A known n-gram below the highest
order is a state; an arc reads a word, carries the log-probability of the
n-gram it completes and leads to the longest state that the words read end
with; a failure arc costs the backoff weight and leads to the state without the
first word. One pass from left to right over each text carries the state and
adds up the weights.

Smoothing is Bayesian with a Dirichlet prior at each order:
p(w | h) = (c(hw) + mass * p(w | h')) / (c(h) + mass), h' without the first word
of h, and p(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)). An n-gram never seen therefore costs the
failure weight mass / (c(h) + mass) and the lower probability, and all sum to one. A text starts
in the empty state.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a token for the end follows them.

Defined results: a null text is empty and has the end as its only token;
without training texts every token has probability one; repeated rows are scored, and counted,
each; a row for which ``held_out`` is null, as for a fold of a null id, is held out; a very long text is a block of its own,
read whole; an empty table gives no rows; extra columns are ignored, whatever they are called. ``docs`` comes from a scan or a written table: its rows are read
twice and must come in the same order, else the query fails rather than guesses.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.llm.words import chunks, joined_hash, lowered, word_hashes
from rowloom.session import materialize

ORDER = 3
MASS = 100.0
BLOCK_BYTES = 3 << 20
SHARD_BYTES = 16 << 20


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, 0 for the end of each text; where each text begins."""
    gap = np.zeros(256, dtype=bool)
    gap[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    data = lowered(texts, b"\n")
    begin, hashes = word_hashes(data, gap)
    sizes = np.array([len(t or b"") + 1 for t in texts], dtype=np.int64)
    before = np.searchsorted(begin, np.concatenate([[0], np.cumsum(sizes)]))
    found = np.zeros(begin.size + len(texts), dtype=np.uint64)
    found[np.arange(begin.size) + np.repeat(np.arange(len(texts)), np.diff(before))] = hashes
    return found, before + np.arange(len(texts) + 1)


def ngrams(words: np.ndarray, edges: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order up to ``order``: places where an n-gram ends inside its text, and its hashes."""
    inside = np.arange(words.size) - np.repeat(edges[:-1], np.diff(edges))
    places, keys = np.arange(words.size), words
    yield places, keys
    hashed = words
    for k in range(2, order + 1):
        longer = np.zeros_like(words)
        longer[1:] = joined_hash(hashed[:-1], words[1:])
        hashed = longer
        places = np.flatnonzero(inside >= k - 1)
        yield places, hashed[places]


def _planes(numbers: np.ndarray) -> bytes:
    """Ascending numbers as differences, byte by byte, so that high zero bytes lie together."""
    steps = np.diff(numbers, prepend=np.uint64(0)).astype("<u8")
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    steps = np.frombuffer(planes, dtype=np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64)


def _counts(numbers: np.ndarray) -> bytes:
    """Counts with a leading byte for their width, byte by byte."""
    width = next(w for w in (1, 2, 4, 8) if int(numbers.max(initial=0)) < 1 << 8 * w)
    return bytes([width]) + numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _counted(packed: bytes) -> np.ndarray:
    width = packed[0]
    raw = np.frombuffer(packed, dtype=np.uint8, offset=1).reshape(width, -1).T.copy()
    return raw.view(f"<u{width}").ravel().astype(np.int64)


class Automaton:
    """The states, arcs and failure arcs that the texts of one block can reach."""

    def __init__(self, words: np.ndarray, edges: np.ndarray, order: int, counts: list[np.ndarray], n: int, v: int, mass: float):
        """``counts[k]``: training counts of the block's distinct n-grams of order k + 1, by hash."""
        self.edges = edges
        whole = n + 0.5 * (v + 1)
        index, probability, base = [], [], 0
        arcs: dict[int, int] = {}
        weight, target, fail, fail_weight = [], [], [np.zeros(1, dtype=np.int64)], [np.zeros(1)]
        states = [np.zeros(0, dtype=np.int64)]
        width = 0
        n_states = 1
        for k, (places, keys) in enumerate(ngrams(words, edges, order)):
            own, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
            if own.size != counts[k].size:
                raise RuntimeError("the rows came in another order than before: write the input first")
            at = np.full(words.size, -1, dtype=np.int64)
            at[places] = inverse
            index.append(at)
            place = places[first]  # one occurrence stands for all
            seen = counts[k] > 0
            if k == 0:
                width = own.size
                p = (counts[0] + 0.5) / whole
                before = np.zeros(own.size, dtype=np.int64)
            else:
                prefix, suffix = index[k - 1][place - 1], index[k - 1][place]
                p = (counts[k] + mass * probability[k - 1][suffix]) / (counts[k - 1][prefix] + mass)
                before = states[k][prefix]
            probability.append(p)
            # a known n-gram below the highest order becomes a state; longer ones lead to their suffix
            number = np.zeros(own.size, dtype=np.int64)
            if k + 1 < order:
                opens = seen & (words[place] != 0)  # nothing follows an end
                number[opens] = n_states + np.arange(int(opens.sum()))
                n_states += int(opens.sum())
                lower = np.zeros(int(opens.sum()), dtype=np.int64) if k == 0 else states[k][index[k - 1][place[opens]]]
                fail.append(lower)
                fail_weight.append(np.log10(mass / (counts[k][opens] + mass)))
                to = number
            else:
                to = np.zeros(own.size, dtype=np.int64) if k == 0 else states[k][index[k - 1][place]]
            states.append(number)
            last = index[0][place]
            names = before[seen] * width + last[seen]
            arcs.update(zip(names.tolist(), range(base, base + names.size), strict=True))
            base += names.size
            weight.append(np.log10(p[seen]))
            target.append(to[seen])
        self.words, self.width, self.arcs = index[0], width, arcs
        self.weight, self.target = np.concatenate(weight).tolist(), np.concatenate(target).tolist()
        self.fail, self.fail_weight = np.concatenate(fail).tolist(), np.concatenate(fail_weight).tolist()
        self.unknown = math.log10(0.5 / whole)
        known = counts[0][index[0]]
        self.known = np.add.reduceat((known > 0).astype(np.int64), edges[:-1])
        self.base = np.add.reduceat(np.log10((known + 0.5) / whole), edges[:-1])

    def traverse(self, begin: int, end: int) -> float:
        """Log-probability of the tokens from ``begin`` to ``end``, read from left to right."""
        arcs, width, weight, target, fail, fail_weight = self.arcs, self.width, self.weight, self.target, self.fail, self.fail_weight
        state, total = 0, 0.0
        for word in self.words[begin:end].tolist():
            arc = arcs.get(state * width + word)
            while arc is None and state:
                total += fail_weight[state]
                state = fail[state]
                arc = arcs.get(state * width + word)
            if arc is None:
                total += self.unknown
            else:
                total += weight[arc]
                state = target[arc]
        return total

    def scores(self) -> list[float]:
        return [self.traverse(a, b) for a, b in pairwise(self.edges.tolist())]


def _block_id(piece: pa.RecordBatch, texts: list[bytes | None]) -> bytes:
    made = hashlib.blake2b(digest_size=16)
    for part in (repr(piece.column("doc_id").to_pylist()).encode(), *(t if t is not None else b"\xff" for t in texts)):
        made.update(len(part).to_bytes(8, "little"))
        made.update(part)
    return made.digest()


def score(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, mass: float = MASS,
          block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learned from rows not held out."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(held_out, F.lit(True)).alias("held_out"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, size / shard_bytes))))
    shift = np.uint64(64 - bits)

    def shards(keys: np.ndarray) -> np.ndarray:
        return np.zeros(keys.size, dtype=np.int64) if bits == 0 else (keys >> shift).astype(np.int64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, "text", block_bytes):
            texts = piece.column("text").cast(pa.binary()).to_pylist()
            block = _block_id(piece, texts)
            words, edges = tokens(texts)
            learned = np.repeat(~np.array(piece.column("held_out").to_pylist(), dtype=bool), np.diff(edges))
            for k, (places, keys) in enumerate(ngrams(words, edges, order)):
                own, inverse = np.unique(keys, return_inverse=True)
                n = np.bincount(inverse[learned[places]], minlength=own.size)
                shard = shards(own)
                cuts = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [own.size]]) if own.size else np.array([0])
                parts = list(pairwise(cuts.tolist()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block] * len(parts), pa.binary()), pa.array([k] * len(parts), pa.int32()),
                        pa.array([int(shard[a]) for a, _ in parts], pa.int64()),
                        pa.array([_planes(own[a:b]) for a, b in parts], pa.binary()),
                        pa.array([_counts(n[a:b]) for a, b in parts], pa.binary()),
                    ],
                    names=["block", "k", "shard", "keys", "counts"],
                )

    def answer(asked: pa.Table) -> pa.Table:
        keys = [_numbers(x) for x in asked.column("keys").to_pylist()]
        counts = np.concatenate([_counted(x) for x in asked.column("counts").to_pylist()])
        cuts = np.cumsum([0, *(x.size for x in keys)])
        own, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(own.size, dtype=np.int64)
        np.add.at(total, inverse, counts)
        n, rest = total.sum(), [0] * (asked.num_rows - 1)
        return pa.table({
            "block": asked.column("block"), "k": asked.column("k"), "shard": asked.column("shard"),
            "counts": pa.array([_counts(total[inverse[a:b]]) for a, b in pairwise(cuts)], pa.binary()),
            "n": pa.array([int(n), *rest], pa.int64()), "v": pa.array([int((total > 0).sum()), *rest], pa.int64()),
        })

    asked = rows.mapInArrow(ask, "block binary, k int, shard bigint, keys binary, counts binary")
    answers = asked.groupBy("k", "shard").applyInArrow(answer, "block binary, k int, shard bigint, counts binary, n bigint, v bigint")
    answers = materialize(answers, "counts")
    whole = answers.filter("k = 0").agg(F.sum("n"), F.sum("v")).first()
    n, v = whole[0] or 0, whole[1] or 0

    kind = rows.schema["doc_id"].dataType
    listed = T.StructType([
        T.StructField("block", T.BinaryType()), T.StructField("doc_id", T.ArrayType(kind)),
        T.StructField("held_out", T.ArrayType(T.BooleanType())), T.StructField("sizes", T.ArrayType(T.IntegerType())),
        T.StructField("text", T.BinaryType()),
    ])
    held = T.StructType([
        T.StructField("doc_id", kind), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()),
        T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, "text", block_bytes):
            texts = piece.column("text").cast(pa.binary()).to_pylist()
            lists = [pa.array([piece.column(c).to_pylist()], pa.list_(piece.column(c).type)) for c in ("doc_id", "held_out")]
            sizes = [len(t or b"") for t in texts]
            packed = zlib.compress(b"".join(t or b"" for t in texts), 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([_block_id(piece, texts)], pa.binary()), *lists, pa.array([sizes], pa.list_(pa.int32())), pa.array([packed], pa.binary())],
                names=listed.names,
            )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {name: [] for name in held.names}
        found: dict[int, dict[int, bytes]] = {k: {} for k in range(order)}
        for k, shard, counts in zip(*(right.column(c).to_pylist() for c in ("k", "shard", "counts")), strict=True):
            found[k][shard] = counts
        none = [np.zeros(0, dtype=np.int64)]
        counts = [np.concatenate([_counted(found[k][s]) for s in sorted(found[k])] or none) for k in range(order)]
        for row in left.to_pylist():
            whole, ends = zlib.decompress(row["text"]), np.cumsum(row["sizes"]).tolist()
            words, edges = tokens([whole[end - size : end] for size, end in zip(row["sizes"], ends, strict=True)])
            machine = Automaton(words, edges, order, counts, n, v, mass)
            out["doc_id"] += row["doc_id"]
            out["held_out"] += row["held_out"]
            out["n_tokens"] += np.diff(edges).tolist()
            out["n_known"] += machine.known.tolist()
            out["train_tokens"] += [n] * len(row["sizes"])
            out["base_score"] += machine.base.tolist()
            out["score"] += machine.scores()
        types = [left.schema.field("doc_id").type.value_type, pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2]
        return pa.table({name: pa.array(out[name], kind) for name, kind in zip(held.names, types, strict=True)})

    gathered = rows.mapInArrow(gather, listed)
    return gathered.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, held)
