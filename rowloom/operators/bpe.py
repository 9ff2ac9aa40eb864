"""Byte-level BPE over a corpus table: learn, encode, decode, verify, frame.

The vocabulary is the only thing held on the driver; its size is limited by the
``vocab_size`` it was learned with. Texts, pieces and sequences stay in tables.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, takewhile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.functions.arrays import bounded_parts, frame_ids, pad_ids, validity_mask
from rowloom.functions.text import BYTE_LEVEL_PATTERN, _column, pieces
from rowloom.operators.profile import longest_row
from rowloom.session import discard, materialize

# Special tokens in id order.
SPECIAL_TOKENS = ["<s>", "<pad>", "</s>", "<unk>", "<mask>"]
# The bytes that stand for themselves in the published byte
# alphabet; the others take the characters from 256 on, in byte order.
PRINTABLE_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_characters() -> list[str]:
    """The printable character of every byte value."""
    hidden = [b for b in range(256) if b not in PRINTABLE_BYTES]
    return [chr(b) if b in PRINTABLE_BYTES else chr(256 + hidden.index(b)) for b in range(256)]


def token_bytes(token: str) -> bytes:
    """The bytes that a token of byte characters stands for."""
    byte_of = {c: b for b, c in enumerate(byte_characters())}
    return bytes(byte_of[c] for c in token)


@dataclass
class Vocabulary:
    """Token ids and the ranked merges."""

    ids: dict[str, int]
    merges: list[tuple[str, str]] = field(default_factory=list)
    special: list[str] = field(default_factory=lambda: list(SPECIAL_TOKENS))

    @classmethod
    def initial(cls, special: list[str] | None = None) -> Vocabulary:
        """Special tokens, then the byte characters in code-point order."""
        special = SPECIAL_TOKENS if special is None else special
        return cls({t: i for i, t in enumerate([*special, *sorted(byte_characters())])}, [], list(special))

    def byte_ids(self) -> np.ndarray:
        """Id of every byte value."""
        return np.array([self.ids[c] for c in byte_characters()], dtype=np.int32)

    def ranks(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(left id, right id) -> (rank, id of the merged token)."""
        return {
            (self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(self.merges)
        }

    def by_id(self) -> list[str]:
        """Tokens in id order; empty text for ids that no token has."""
        tokens = [""] * (max(self.ids.values()) + 1)
        for token, i in self.ids.items():
            tokens[i] = token
        return tokens


# --- learning --------------------------------------------------------------


def piece_counts(
    df: DataFrame, text: str, pattern: str = BYTE_LEVEL_PATTERN, terminator: str = ""
) -> DataFrame:
    """How often each piece occurs in the corpus: (piece, n).

    ``terminator`` is put behind every line, for lines whose ending was cut off
    by the reader but should be learned from.
    """
    whole = F.concat(F.col(text), F.lit(terminator)) if terminator else F.col(text)
    long = df.select(F.explode(pieces(whole, pattern)).alias("piece"))
    return long.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


def pair_counts(counts: DataFrame) -> DataFrame:
    """Neighbouring characters of the pieces, weighted by piece frequency."""
    pairs = F.transform(
        F.sequence(F.lit(1), F.char_length("piece") - 1),
        lambda i: F.struct(F.substring(F.col("piece"), i, F.lit(1)).alias("l"),
                           F.substring(F.col("piece"), i + 1, F.lit(1)).alias("r")),
    )
    long = counts.filter(F.char_length("piece") > 1).select("n", F.inline(pairs))
    return long.groupBy("l", "r").agg(F.sum("n").alias("n"))


def _edges(values: pa.Array) -> np.ndarray:
    """Where the values of a text or binary array begin and end in its bytes."""
    if not len(values):
        return np.zeros(1, dtype=np.int64)
    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    ends = np.frombuffer(values.buffers()[1], dtype=np.int64 if wide else np.int32)
    return ends[values.offset : values.offset + len(values) + 1]


def _packed(symbols: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Pieces of so many symbols as binary values of four bytes a symbol."""
    ends = pa.py_buffer(np.r_[0, np.cumsum(lengths) * 4].astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, ends, pa.py_buffer(np.ascontiguousarray(symbols, dtype="<i4"))])


def _flat(symbols: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All symbols in one array with -1 behind each piece, and their weights."""
    edges = _edges(symbols) // 4
    lengths = np.diff(edges)
    flat = np.full(lengths.sum() + len(lengths), -1, dtype=np.int32)
    ends = np.cumsum(lengths + 1) - 1
    inside = np.ones(len(flat), dtype=bool)
    inside[ends] = False
    if lengths.any():
        flat[inside] = np.frombuffer(symbols.buffers()[2], dtype="<i4", count=int(edges[-1]))[edges[0] :]
    return flat, np.repeat(weights, lengths + 1)


#: Merges of one round: (left, right, merged), none of which can overlap another.
Round = list[tuple[int, int, int]]


def _apply(flat: np.ndarray, weights: np.ndarray, rounds: list[Round]):
    """Replace the pairs round after round, left to right, never overlapping.

    The merges of a round are looked up together: first by which symbols can
    stand left and right at all, then by the pair.
    """
    for merges in rounds:
        if not len(flat):
            break
        keys = np.array([(left << 32) | right for left, right, _ in merges], dtype=np.int64)
        by_key = np.argsort(keys)
        keys, made = keys[by_key], np.array([m for _, _, m in merges], dtype=np.int32)[by_key]
        size = max(int(flat.max()), *(max(left, right) for left, right, _ in merges)) + 2
        can_left, can_right = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
        can_left[[left for left, _, _ in merges]] = True
        can_right[[right for _, right, _ in merges]] = True
        at = np.flatnonzero(can_left[flat[:-1]] & can_right[flat[1:]])
        pair = (flat[at].astype(np.int64) << 32) | flat[at + 1]
        place = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        hit = keys[place] == pair
        at, place = at[hit], place[hit]
        if len(merges) == 1 and merges[0][0] == merges[0][1] and len(at) > 1:
            starts = np.r_[True, np.diff(at) > 1]
            run_start = at[starts][np.cumsum(starts) - 1]
            at, place = at[(at - run_start) % 2 == 0], place[(at - run_start) % 2 == 0]
        if len(at):
            flat = flat.copy()
            flat[at] = made[place]
            keep = np.ones(len(flat), dtype=bool)
            keep[at + 1] = False
            flat, weights = flat[keep], weights[keep]
    return flat, weights


def _counted(flat: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
    """Weighted pair counts of one batch: the map-side part of the aggregate."""
    inside = (flat[:-1] >= 0) & (flat[1:] >= 0)
    key = (flat[:-1][inside].astype(np.int64) << 32) | flat[1:][inside]
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weights[:-1][inside][order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.array([], dtype=int)
    total = np.add.reduceat(weight, starts) if len(starts) else np.array([], dtype=np.int64)
    key = key[starts]
    return pa.RecordBatch.from_arrays(
        [pa.array((key >> 32).astype(np.int32)), pa.array((key & 0xFFFFFFFF).astype(np.int32)), pa.array(total)],
        names=["l", "r", "n"],
    )


def _count_pairs(state: DataFrame, rounds: list[Round]) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _counted(*_apply(*_flat(batch.column(0), batch.column(1).to_numpy()), rounds))

    partial = state.mapInArrow(count, "l int, r int, n bigint")
    return partial.groupBy("l", "r").agg(F.sum("n").alias("n"))


def _lengths(flat: np.ndarray) -> np.ndarray:
    """Symbols of each piece."""
    return np.diff(np.r_[-1, np.flatnonzero(flat == -1)]) - 1


def _rewrite(state: DataFrame, rounds: list[Round]) -> DataFrame:
    """The pieces after the merges, and what the merges change in the pair counts, in one pass.

    A row is a piece (symbols, weight) or a signed change (l, r, n). Changes come
    from the pieces that hold a merged pair, old pairs negative and new ones
    positive; pieces that have become one symbol can never change again and go.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, weights = _flat(batch.column(0), batch.column(1).to_numpy())
            after, kept_weights = _apply(before, weights, rounds)
            old, new = _lengths(before), _lengths(after)
            touched_old, touched_new = np.repeat(new < old, old + 1), np.repeat(new < old, new + 1)
            change = _counted(
                np.r_[before[touched_old], after[touched_new]], np.r_[-weights[touched_old], kept_weights[touched_new]]
            )
            change = change.filter(pc.not_equal(change.column(2), 0))
            after = after[np.repeat(new > 1, new + 1)]
            left = new[new > 1]
            symbols = _packed(after[after >= 0], left)
            weight = pa.array(batch.column(1).to_numpy()[new > 1])
            none = [pa.nulls(len(left), t) for t in (pa.int32(), pa.int32(), pa.int64())]
            yield pa.RecordBatch.from_arrays([symbols, weight, *none], names=_STATE_NAMES)
            none = [pa.nulls(change.num_rows, t) for t in (pa.binary(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, *change.columns], names=_STATE_NAMES)

    return state.mapInArrow(rewrite, "symbols binary, weight bigint, l int, r int, n bigint")


_STATE_NAMES = ["symbols", "weight", "l", "r", "n"]


def _runs(state: DataFrame, candidates: list[tuple[int, int, int]]) -> DataFrame:
    """(run, n): the maximal runs of symbols whose neighbours are all candidate pairs, and how often they occur."""
    keys = np.sort(np.array([(left << 32) | right for left, right, _ in candidates], dtype=np.int64))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, weights = _flat(batch.column(0), batch.column(1).to_numpy())
            pair = (flat[:-1].astype(np.int64) << 32) | (flat[1:].astype(np.int64) & 0xFFFFFFFF)
            linked = keys[np.minimum(np.searchsorted(keys, pair), len(keys) - 1)] == pair
            edges = np.diff(np.r_[False, linked, False].astype(np.int8))
            begin, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
            sizes = last - begin + 1
            ends = np.cumsum(sizes)
            symbols = flat[np.repeat(begin - (ends - sizes), sizes) + np.arange(sizes.sum())].astype("<i4")
            offsets = pa.py_buffer(np.r_[0, ends * 4].astype(np.int64))
            runs = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, offsets, pa.py_buffer(symbols)])
            counted = pa.table({"run": runs.cast(pa.binary()), "n": weights[begin]}).group_by("run").aggregate([("n", "sum")])
            yield from counted.select(["run", "n_sum"]).rename_columns(["run", "n"]).to_batches()

    return state.mapInArrow(cut, "run binary, n bigint").groupBy("run").agg(F.sum("n").alias("n"))


def _byte_symbols(counts: DataFrame, byte_ids: np.ndarray) -> DataFrame:
    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            used = np.frombuffer(b"".join(texts), dtype=np.uint8)
            out = _packed(byte_ids[used], np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))
            yield pa.RecordBatch.from_arrays([out, batch.column(1)], names=["symbols", "weight"])

    return counts.select("piece", "n").mapInArrow(symbols, "symbols binary, weight bigint")


def _next_merges(
    top: list[tuple[int, int, int]], complete: bool, tokens: list[str], known: dict[str, int]
) -> list[tuple[int, int]]:
    """The pairs at the head of the ranking that can be merged in one round.

    The best pair always merges. Those behind it join only while merging them one
    by one would choose the same pairs: none can overlap an accepted one (it does
    not end with a symbol that one begins with, or begin with one that one ends
    with), none is a self-pair or makes a text that exists, and none ties with a lower pair that can.
    What an accepted merge changes or brings about is at most as frequent as such
    an overlapping pair, and those rank lower, or the scan would have ended at them.
    """
    (first_l, first_r, _), accepted, made = top[0], [top[0][:2]], set()
    text = tokens[first_l] + tokens[first_r]
    if first_l == first_r or text in known:
        return accepted
    lefts, rights = {first_l}, {first_r}
    made.add(text)
    for j in range(1, len(top)):
        left, right, n = top[j]
        text = tokens[left] + tokens[right]
        if right in lefts or left in rights or left == right or text in known or text in made:
            break
        if not complete and top[-1][2] == n:
            break
        ties = list(takewhile(lambda t: t[2] == n, top[j + 1:]))
        if any(t[1] in lefts or t[0] in rights for t in ties):
            break
        accepted.append((left, right))
        lefts.add(left)
        rights.add(right)
        made.add(text)
    return accepted


def _candidates(top: list[tuple[int, int, int]], complete: bool, width: int, least: int) -> tuple[int, int]:
    """How many of the ranked pairs to take, about ``width``, and the count that no other pair exceeds.

    Pairs of one count are taken together. 0 if there is no place to cut: all ranked pairs tie with more behind them.
    """
    if complete and len(top) <= width:
        return len(top), least - 1
    cuts = [k for k in range(1, len(top)) if top[k][2] < top[k - 1][2]]
    if complete:
        cuts.append(len(top))
    if not cuts:
        return 0, 0
    k = max((k for k in cuts if k <= width), default=cuts[0])
    return k, top[k][2] if k < len(top) else least - 1


def _resolve(
    runs: list[tuple[list[int], int]], bound: int, tokens: list[str], known: dict[str, int], limit: int
) -> list[tuple[int, int]]:
    """Merges in their order, for as long as the best pair is more frequent than ``bound``.

    Runs are indexed by the pairs they hold, so that a merge rewrites only runs
    that hold its pair, and the counts change by what those lose and gain. A
    pair that leads out of a run is no candidate, so neither it nor what a
    merge makes of it can exceed the bound: up to there the counts in the runs are those of the corpus.
    A merge that makes a text that exists ends the runs' knowledge, as that text may also stand outside them.
    """
    counts: dict[tuple[int, int], int] = defaultdict(int)
    holders: dict[tuple[int, int], set[int]] = defaultdict(set)
    for i, (run, n) in enumerate(runs):
        for pair in zip(run, run[1:]):
            counts[pair] += n
            holders[pair].add(i)
    waiting = [(-n, pair) for pair, n in counts.items()]
    heapq.heapify(waiting)
    merges: list[tuple[int, int]] = []
    texts = [*tokens]
    made: set[str] = set()
    while waiting and len(merges) < limit:
        negative, pair = heapq.heappop(waiting)
        if counts[pair] != -negative:
            continue
        if -negative <= bound:
            break
        text = texts[pair[0]] + texts[pair[1]]
        exists = text in known or text in made
        if exists and merges:
            break
        merges.append(pair)
        if exists:
            break
        new = len(texts)
        texts.append(text)
        made.add(text)
        changed = set()
        for i in holders.pop(pair):
            run, n = runs[i]
            for other in zip(run, run[1:]):
                counts[other] -= n
                changed.add(other)
            run = _merged(run, pair, new)
            runs[i] = run, n
            for other in zip(run, run[1:]):
                counts[other] += n
                changed.add(other)
                holders[other].add(i)
        for other in changed:
            if counts[other] > 0:
                heapq.heappush(waiting, (-counts[other], other))
    return merges


def _merged(run: list[int], pair: tuple[int, int], new: int) -> list[int]:
    """The run with the pair replaced from left to right."""
    out, i, last = [], 0, len(run) - 1
    while i <= last:
        if i < last and run[i] == pair[0] and run[i + 1] == pair[1]:
            out.append(new)
            i += 2
        else:
            out.append(run[i])
            i += 1
    return out


def _waves(merges: list[tuple[int, int, int]]) -> list[Round]:
    """Rounds with the same result as the merges one by one.

    A merge comes after all earlier ones that it could overlap or whose symbols
    it uses; a pair of equal symbols has a round of its own.
    """
    as_left: dict[int, int] = {}
    as_right: dict[int, int] = {}
    born: dict[int, int] = {}
    waves: dict[int, Round] = defaultdict(list)
    for left, right, made in merges:
        wave = 1 + max(as_right.get(left, 0), as_left.get(right, 0), born.get(left, 0), born.get(right, 0))
        waves[wave].append((left, right, made))
        as_left[left] = max(as_left.get(left, 0), wave)
        as_right[right] = max(as_right.get(right, 0), wave)
        born[made] = max(born.get(made, 0), wave)
    rounds = []
    for wave in sorted(waves):
        rounds += [[m] for m in waves[wave] if m[0] == m[1]]
        others = [m for m in waves[wave] if m[0] != m[1]]
        rounds += [others] if others else []
    return rounds


def learn(
    counts: DataFrame,
    vocab_size: int = 2000,
    min_frequency: int = 2,
    special: list[str] | None = None,
    max_merges: int | None = None,
    ranked: int = 4096,
    most_runs: int = 40_000,
    run_bytes: int = 4 << 20,
) -> Vocabulary:
    """Learn merges from (piece, n): the most frequent pair first, ties by ids.

    Pieces are packed symbols and the pair counts a written table. A step takes its best pairs as
    candidates and cuts the pieces into runs of symbols linked by candidates.
    The distinct runs, at most ``most_runs`` of ``run_bytes`` together, decide on
    the driver all merges down to the count of the best pair that is no candidate. One pass
    then applies them to the pieces and gives the signed changes of the pair
    counts, which are added to their table. How many candidates a step takes
    follows from the runs of the last one; runs beyond the bounds are not
    fetched but cut again with half the candidates, in the end by the best pairs alone.
    The merges are those of learning one by one. Learning ends at ``vocab_size``,
    at ``max_merges``, or when no pair occurs ``min_frequency`` times.
    """
    vocabulary = Vocabulary.initial(special)
    tokens = vocabulary.by_id()
    spark = counts.sparkSession
    spread = counts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = materialize(_byte_symbols(spread, vocabulary.byte_ids()), "pieces")
    pairs = materialize(_count_pairs(pieces, []), "pairs")
    limit = max_merges if max_merges is not None else vocab_size
    width = 64
    while (room := min(vocab_size - len(vocabulary.ids), limit - len(vocabulary.merges))) > 0:
        best = pairs.filter(F.col("n") >= min_frequency).orderBy(F.desc("n"), "l", "r").limit(ranked + 1).collect()
        if not best:
            break
        complete = len(best) <= ranked
        top = [(r["l"], r["r"], r["n"]) for r in best[:ranked]]
        found, width = _decided(_state(pieces), top, complete, width, min_frequency, tokens, vocabulary.ids, room, most_runs, run_bytes)
        merges = []
        for left, right in found[:room]:
            text = tokens[left] + tokens[right]
            if text not in vocabulary.ids:
                vocabulary.ids[text] = len(tokens)
                tokens.append(text)
            vocabulary.merges.append((tokens[left], tokens[right]))
            merges.append((left, right, vocabulary.ids[text]))
        if len(found) < room:
            pieces, pairs = _advanced(pieces, pairs, _waves(merges))
        else:
            break
    discard(pieces)
    discard(pairs)
    return vocabulary


def _decided(
    state: DataFrame, top: list[tuple[int, int, int]], complete: bool, width: int, least: int, tokens: list[str],
    known: dict[str, int], room: int, most_runs: int, run_bytes: int,
) -> tuple[list[tuple[int, int]], int]:
    """The next merges, and how many candidates to try in the next step."""
    last = len(top) + 1
    while True:
        cut, bound = _candidates(top, complete, width, least)
        if not 1 < cut < last:
            return _next_merges(top, complete, tokens, known), max(2, width)
        runs = _runs(state, top[:cut]).persist()
        try:
            n, size = runs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("run")), F.lit(0))).first()
            if n <= most_runs and size <= run_bytes:
                held = [(np.frombuffer(row["run"], dtype="<i4").tolist(), row["n"]) for row in runs.collect()]
                wider = 2 * cut if 4 * n <= most_runs and 4 * size <= run_bytes else cut
                return _resolve(held, bound, tokens, known, room), wider
        finally:
            runs.unpersist()
        last, width = cut, cut // 2


def _state(written: DataFrame) -> DataFrame:
    """The pieces (symbols, weight) of a written table that may hold changes too."""
    return written.filter("symbols IS NOT NULL").select("symbols", "weight")


def _advanced(pieces: DataFrame, pairs: DataFrame, rounds: list[Round]) -> tuple[DataFrame, DataFrame]:
    """The written pieces and pair counts after the merges; those before are deleted."""
    made = materialize(_rewrite(_state(pieces), rounds), "pieces")
    change = made.filter("l IS NOT NULL").select("l", "r", "n")
    summed = pairs.unionByName(change).groupBy("l", "r").agg(F.sum("n").alias("n")).filter("n > 0")
    next_pairs = materialize(summed, "pairs")
    discard(pieces)
    discard(pairs)
    return made, next_pairs


def merges_table(df: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The ranked merges as a table: (rank, left, right)."""
    rows = [(i, a, b) for i, (a, b) in enumerate(vocabulary.merges)]
    return df.sparkSession.createDataFrame(rows, "rank bigint, left string, right string")


# --- encoding and decoding ---------------------------------------------------


def merge_symbols(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge the lowest-ranked neighbouring pair, the leftmost first, until none is left.

    Neighbours are linked and open pairs wait in a heap, so a piece of n bytes
    takes n log n steps, however long it is.
    """
    n = len(symbols)
    waiting = [
        (ranks[pair][0], i, *pair) for i, pair in enumerate(zip(symbols, symbols[1:])) if pair in ranks
    ]
    if not waiting:
        return symbols
    heapq.heapify(waiting)
    symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))

    def offer(i: int, j: int) -> None:
        if 0 <= i and j < n and (symbols[i], symbols[j]) in ranks:
            heapq.heappush(waiting, (ranks[symbols[i], symbols[j]][0], i, symbols[i], symbols[j]))

    while waiting:
        _, i, left, right = heapq.heappop(waiting)
        j = after[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue
        symbols[i], symbols[j], after[i] = ranks[left, right][1], -1, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(before[i], i)
        offer(i, after[i])
    return [s for s in symbols if s >= 0]


#: Bytes of text that are encoded together, and about what a remembered piece takes besides its bytes.
PART_BYTES, PIECE_BYTES = 1 << 21, 256


def _encoder(vocabulary: Vocabulary, spark, remembered_bytes: int = 1 << 25):
    shared = spark.sparkContext.broadcast((vocabulary.byte_ids(), vocabulary.ranks()))

    @F.arrow_udf("array<int>")
    def encode_pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        byte_ids, ranks = shared.value
        memory: dict[str, list[int]] = {}
        held = 0
        for batch in batches:
            for texts in bounded_parts(batch, _text_bytes(batch), PART_BYTES):
                distinct = texts.flatten().dictionary_encode()
                known = distinct.dictionary.to_pylist()
                fresh = [piece for piece in known if piece not in memory]
                data = [piece.encode("utf-8") for piece in fresh]
                symbols = byte_ids[np.frombuffer(b"".join(data), dtype=np.uint8)].tolist()
                at = 0
                for piece, spelled in zip(fresh, data):
                    memory[piece] = merge_symbols(symbols[at : at + len(spelled)], ranks)
                    at += len(spelled)
                # a symbol of a remembered piece is a reference of 8 bytes
                held += 9 * at + PIECE_BYTES * len(fresh)

                coded = [memory[piece] for piece in known]
                sizes = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
                table = np.fromiter(chain.from_iterable(coded), dtype=np.int32, count=sizes.sum())
                starts = np.cumsum(sizes) - sizes
                which = distinct.indices.to_numpy()
                taken = sizes[which]
                ends = np.cumsum(taken)
                ids = table[np.repeat(starts[which] - (ends - taken), taken) + np.arange(taken.sum())]
                lists = texts.offsets.to_numpy() - texts.offsets[0].as_py()
                offsets = np.r_[0, ends][lists].astype(np.int32)
                mask = texts.is_null() if texts.null_count else None
                yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids), mask=mask)
                if held > remembered_bytes:
                    memory, held = {}, 0

    return encode_pieces


def _text_bytes(lists: pa.ListArray) -> np.ndarray:
    """Bytes of the pieces of each row, from where these begin and end."""
    return np.diff(_edges(lists.values)[lists.offsets.to_numpy()])


def encode(
    df: DataFrame, text: str, vocabulary: Vocabulary, out: str = "ids", pattern: str = BYTE_LEVEL_PATTERN
) -> DataFrame:
    """Add the token ids of every text, without special tokens.

    A scan-and-write job: the texts are split on the JVM, and each distinct piece
    of a batch is merged once. Nothing is shuffled, so frequent pieces are cheap
    rather than hot.
    """
    return df.withColumn(out, _encoder(vocabulary, df.sparkSession)(pieces(text, pattern)))


def tokens_of(ids: Column | str, vocabulary: Vocabulary) -> Column:
    """The tokens in their printable form."""
    table = F.split(F.lit("\x00".join(vocabulary.by_id())), "\x00")
    return F.transform(_column(ids), lambda i: F.try_element_at(table, i + 1))


def decode(ids: Column | str, vocabulary: Vocabulary, skip_special: bool = True) -> Column:
    """The text of a sequence; bytes that are no valid UTF-8 become U+FFFD.

    An ordinary column expression over a literal table of token bytes.
    """
    byte_of = {c: b for b, c in enumerate(byte_characters())}

    def spelled(token: str) -> str:
        if token in vocabulary.special:
            return "" if skip_special else token.encode("utf-8").hex()
        return bytes(byte_of[c] for c in token).hex()

    table = F.split(F.lit(",".join(spelled(t) for t in vocabulary.by_id())), ",")
    joined = F.array_join(F.transform(_column(ids), lambda i: F.try_element_at(table, i + 1)), "")
    return F.make_valid_utf8(F.unhex(joined).cast("string"))


def _digests(ids: str, text: Column) -> list[Column]:
    line = F.array_join(F.transform(ids, lambda i: i.cast("string")), " ")
    return [F.sha2(line, 256).alias("ids_digest"), F.sha2(text, 256).alias("text_digest")]


def verify(stored: DataFrame, corpus: DataFrame, text: str, vocabulary: Vocabulary, pos: str = "pos") -> DataFrame:
    """Compare all stored sequences with fresh ones, line by line: (pos, ids_match, text_match).

    Both sides are reduced to digests before they meet, so the join moves a few
    bytes per line. A line without partner matches in nothing.
    """
    fresh = encode(corpus.select(pos, text), text, vocabulary, "_ids").select(pos, *_digests("_ids", F.col(text)))
    kept = stored.select(pos, *_digests("ids", decode("ids", vocabulary))).toDF(pos, "_ids", "_text")
    both = fresh.join(kept, pos, "full")
    return both.select(
        pos,
        F.coalesce(F.col("ids_digest") == F.col("_ids"), F.lit(False)).alias("ids_match"),
        F.coalesce(F.col("text_digest") == F.col("_text"), F.lit(False)).alias("text_match"),
    )


def verify_counts(verified: DataFrame) -> DataFrame:
    """Lines compared and how many of them differ in ids or text."""
    return verified.agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(~F.col("ids_match")).alias("ids_differ"),
        F.count_if(~F.col("text_match")).alias("text_differs"),
    )


def mismatches(
    verified: DataFrame, stored: DataFrame, corpus: DataFrame, text: str, vocabulary: Vocabulary, pos: str = "pos"
) -> DataFrame:
    """The lines that differ, with original text and both sequences decoded, special tokens shown."""
    wrong = verified.filter(~(F.col("ids_match") & F.col("text_match"))).select(pos)
    fresh = encode(corpus.select(pos, text).join(wrong, pos, "left_semi"), text, vocabulary, "_fresh")
    kept = stored.select(pos, F.col("ids").alias("_stored")).join(wrong, pos, "left_semi")
    return fresh.join(kept, pos, "full").select(
        pos,
        text,
        decode("_stored", vocabulary, False).alias("stored_text"),
        decode("_fresh", vocabulary, False).alias("fresh_text"),
    )


def longest_encoded(df: DataFrame, text: str, vocabulary: Vocabulary, pos: str = "pos", shown: int = 15) -> DataFrame:
    """The longest text's length, its token count and its first tokens."""
    row = encode(longest_row(df.select(pos, text), text, pos), text, vocabulary)
    return row.select(
        pos, "length", F.size("ids").alias("n_tokens"),
        F.slice(tokens_of("ids", vocabulary), 1, shown).alias("tokens"),
    )


def frame_batches(
    df: DataFrame, ids: str, pos: str = "pos", batch: int = 1_000, limit: int = 512,
    start: int = 0, end: int = 2, pad: int = 1, dropped: tuple[str, ...] = (),
) -> DataFrame:
    """Model input: framed, cut to ``limit``, padded to the longest of its batch; without ``ids`` and ``dropped``.

    A batch is ``batch`` neighbouring positions, which bounds what one window holds.
    What meets in it are cut sequences; uncut ones and ``dropped`` columns, such
    as the text, do not go there.
    """
    framed = df.withColumn("batch", F.expr(f"`{pos}` div {batch}")).withColumn("_f", frame_ids(ids, limit, start, end))
    width = framed.drop(ids, *dropped).withColumn("_w", F.max(F.size("_f")).over(Window.partitionBy("batch")))
    return width.withColumn("input_ids", pad_ids("_f", F.col("_w"), pad)).withColumn(
        "attention_mask", validity_mask("_f", F.col("_w"))
    ).drop("_f", "_w")
