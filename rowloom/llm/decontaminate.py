"""Benchmark decontamination with suffix arrays of the training texts.

Each chunk of documents becomes a shard: an array of word numbers and the array
of all its suffixes in order. Every suffix of the benchmark is looked up in it by
binary search, one word deeper at a time, which gives the longest verbatim match
and, at the length of a window, all places where the window occurs. Shards never
meet, so nothing is shuffled and a lost executor costs its own tasks only.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z: digits,
letters and everything beyond ASCII. A window is a run of ``window`` words of an
item; an item of fewer words, but not none, is one window.

Equal windows are one window with a list of its items, so a window is looked up and its
places are listed once however many items share it; how far a place matches on is found
by binary search among the benchmark's own suffixes in order.

Words are compared by 64-bit hashes. The benchmark reaches the tasks in blocks of
at most ``block_bytes`` of distinct items, one pass over the documents for each block; an item longer than that is
a block of its own.

Defined results: null or wordless documents have zero words and no hits; null or
wordless items have no windows; an item without item_id marks words but is not
listed; repeated documents, and rows with a null id, give a row each; items that repeat count once; very long texts are
one chunk of their own, read whole; extra columns are ignored, and kept by ``remove``, whatever they are
called; an empty table gives no rows, an empty benchmark no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.words import chunks, joined_hash, lowered, restored, word_hashes

WINDOW = 10
CHUNK_BYTES = 6 << 20
BLOCK_BYTES = 16 << 20
#: Item names that leave a task in one batch, but for the list of one document.
LISTED = 1 << 20


def _gaps() -> np.ndarray:
    """Which byte values separate words."""
    gap = np.zeros(256, dtype=bool)
    for first, last in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
        gap[first : last + 1] = True
    return gap


def numbered(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """All words of the texts as hashes, with a 0 after each text; where each text begins."""
    data = lowered(texts, b"\x00")
    begin, hashes = word_hashes(data, _gaps())
    sizes = np.array([len(t or b"") + 1 for t in texts], dtype=np.int64)
    before = np.searchsorted(begin, np.concatenate([[0], np.cumsum(sizes)]))
    words = np.zeros(begin.size + len(texts), dtype=np.uint64)
    words[np.arange(begin.size) + np.repeat(np.arange(len(texts)), np.diff(before))] = hashes
    return words, before + np.arange(len(texts) + 1)


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Begins of all suffixes of ``ids`` (non-negative), ordered by their first ``depth`` numbers at least.

    The first sort looks at as many numbers as fit into 63 bits. Then only runs
    of equal suffixes are sorted again, by the rank of what follows, which
    doubles the depth each time.
    """
    n = ids.size
    bits = max(1, int(ids.max(initial=0)).bit_length())
    known = max(1, min(63 // bits, depth))
    padded = np.concatenate([ids, np.zeros(known, dtype=np.int64)])
    key = np.zeros(n, dtype=np.int64)
    for i in range(known):
        key = (key << bits) | padded[i : i + n]
    order = np.argsort(key)
    key = key[order]
    fresh = np.concatenate([[True], key[1:] != key[:-1]]) if n else np.zeros(0, dtype=bool)
    rank = np.zeros(n, dtype=np.int64)
    first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank[order] = first
    slots = np.arange(n)
    while known < depth and n:
        alone = fresh & np.concatenate([fresh[1:], [True]])
        slots, fresh = slots[~alone], fresh[~alone]
        if not slots.size:
            break
        at = order[slots]
        after = at + known
        follows = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        group = rank[at]
        shuffled = np.lexsort((follows, group))
        at, group, follows = at[shuffled], group[shuffled], follows[shuffled]
        order[slots] = at
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (follows[1:] != follows[:-1])])
        rank[at] = np.maximum.accumulate(np.where(fresh, slots, 0))
        known *= 2
    return order


def _narrowed(column, low, high, wanted):
    """The part of each [low, high) in which ``column`` of the slot equals ``wanted``."""
    ends = []
    for right in (False, True):
        a, b = low.copy(), high.copy()
        while True:
            open_ = a < b
            if not open_.any():
                break
            middle = (a + b) >> 1
            value = column(np.where(open_, middle, 0))
            further = open_ & ((value <= wanted) if right else (value < wanted))
            a = np.where(further, middle + 1, a)
            b = np.where(open_ & ~further, middle, b)
        ends.append(a)
    return ends[0], ends[1]


class Benchmark:
    """The suffixes of a block of items and their windows."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        items = sorted(set(items), key=str)
        words, edges = numbered([None if t is None else t.encode() for _, t in items])
        self.window = window
        self.names = [name for name, _ in items]
        sizes = np.diff(edges) - 1
        self.longest = int(sizes.max(initial=0))
        owner = np.repeat(np.arange(len(items)), sizes + 1)
        left = np.repeat(edges[1:] - 1, sizes + 1) - np.arange(words.size)
        self.words = words
        self.begin = np.flatnonzero(words != 0)
        self.left = left[self.begin]
        self.owner = owner[self.begin]
        asked = np.minimum(window, sizes[self.owner])
        #: Words of the window that begins at a suffix; 0 where none begins.
        self.asked = np.where(self.left >= asked, asked, 0)
        self._group()
        self._order()

    def _group(self) -> None:
        """Equal windows as one: its first suffix, its words and the items that hold it."""
        starts = np.flatnonzero(self.asked)
        content = np.zeros(starts.size, dtype=np.uint64)
        for i in range(self.window):
            more = self.asked[starts] > i
            content[more] = joined_hash(content[more], self.words[self.begin[starts[more]] + i])
        _, first, group = np.unique(content, return_index=True, return_inverse=True)
        #: The suffix that stands for each window, and the window that each such suffix stands for.
        self.suffix = starts[first]
        self.stands_for = np.full(self.begin.size, -1, dtype=np.int64)
        self.stands_for[self.suffix] = np.arange(first.size)
        owned = np.unique(np.stack([group, self.owner[starts]]), axis=1) if starts.size else np.zeros((2, 0), dtype=np.int64)
        #: Items of window w: holders[edges[w]:edges[w + 1]].
        self.holders, self.edges = owned[1], np.searchsorted(owned[0], np.arange(first.size + 1))

    def _order(self) -> None:
        """All suffixes in order, and for each full window the range of those that begin with it."""
        self.known, ids = np.unique(self.words, return_inverse=True)
        self.ids = ids.astype(np.int64)
        self.order = suffix_array(self.ids, max(1, self.longest))
        self.low, self.high = np.zeros((2, self.suffix.size), dtype=np.int64)
        full = np.flatnonzero(self.asked[self.suffix] == self.window)
        low, high = np.zeros(full.size, dtype=np.int64), np.full(full.size, self.words.size)
        for depth in range(self.window):
            wanted = self.ids[self.begin[self.suffix[full]] + depth]
            low, high = _narrowed(lambda s: self.ids[np.minimum(self.order[s] + depth, self.ids.size - 1)], low, high, wanted)
        self.low[full], self.high[full] = low, high

    def items_of(self, windows: np.ndarray) -> np.ndarray:
        """Numbers of the items that hold one of the windows."""
        return np.unique(np.concatenate([self.holders[self.edges[w] : self.edges[w + 1]] for w in windows.tolist()] or [self.holders[:0]]))

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Longest match of every suffix, and for each occurrence of a window: window, place, words."""
        known, ids = np.unique(words, return_inverse=True)
        ids = ids.astype(np.int64)
        place = np.minimum(np.searchsorted(known, self.words), max(known.size - 1, 0))
        same = (known[place] == self.words) & (self.words != 0) if known.size else np.zeros(self.words.size, bool)
        wanted = np.where(same, place, -1)
        order = suffix_array(ids, max(1, self.longest))
        runs = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=known.size))])
        longest = np.zeros(self.begin.size, dtype=np.int64)
        live = np.flatnonzero(wanted[self.begin] >= 0)
        low, high = runs[wanted[self.begin[live]]], runs[wanted[self.begin[live]] + 1]
        depth, found = 1, []
        while live.size:
            longest[live] = depth
            whole = (self.asked[live] == depth) & (self.stands_for[live] >= 0)
            if whole.any():
                found.append((live[whole], low[whole], high[whole]))
            more = self.left[live] > depth
            live, low, high = live[more], low[more], high[more]
            following = wanted[self.begin[live] + depth]
            low, high = _narrowed(lambda slot: ids[np.minimum(order[slot] + depth, ids.size - 1)], low, high, following)
            some = (low < high) & (following >= 0)
            live, low, high = live[some], low[some], high[some]
            depth += 1
        if not found:
            none = np.zeros(0, dtype=np.int64)
            return longest, none, none, none
        suffix, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
        times = high - low
        slot = np.repeat(high - np.cumsum(times), times) + np.arange(times.sum())
        suffix = np.repeat(suffix, times)
        return longest, self.stands_for[suffix], order[slot], self.asked[suffix]

    def extended(self, words: np.ndarray, window: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Words that each occurrence goes on to match in some item, the window included."""
        size, live = size.copy(), np.flatnonzero(size == self.window)
        low, high = self.low[window[live]], self.high[window[live]]
        while live.size:
            following = words[place[live] + size[live]]
            at = np.minimum(np.searchsorted(self.known, following), self.known.size - 1)
            wanted = np.where((self.known[at] == following) & (following != 0), at, -1)
            depth = size[live]
            low, high = _narrowed(lambda slot: self.ids[np.minimum(self.order[slot] + depth, self.ids.size - 1)], low, high, wanted)
            some = (low < high) & (wanted >= 0)
            live, low, high = live[some], low[some], high[some]
            size[live] += 1
        return size


def findings(texts: list[bytes | None], benchmark: Benchmark) -> list[tuple[int, list[int], np.ndarray, int]]:
    """Per text: words, numbers of the hit words, numbers of the windows, words of the longest match of a window or more."""
    words, edges = numbered(texts)
    _, window, place, size = benchmark.find(words)
    change = np.zeros(words.size + 1, dtype=np.int64)
    np.add.at(change, place, 1)
    np.add.at(change, place + size, -1)
    hit = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    whose = np.searchsorted(edges, hit, side="right") - 1
    inside = hit - edges[whose]
    cuts = np.searchsorted(whose, np.arange(len(texts) + 1))
    pairs = np.unique(np.stack([np.searchsorted(edges, place, side="right") - 1, window]), axis=1)
    parts = np.searchsorted(pairs[0], np.arange(len(texts) + 1))
    reach = np.zeros(len(texts), dtype=np.int64)
    np.maximum.at(reach, np.searchsorted(edges, place, side="right") - 1, benchmark.extended(words, window, place, size))
    return [
        (int(edges[i + 1] - edges[i] - 1), inside[cuts[i] : cuts[i + 1]].tolist(), pairs[1][parts[i] : parts[i + 1]], int(reach[i]))
        for i in range(len(texts))
    ]


def _blocks(benchmark: DataFrame, item_id: str, text: str, window: int, block_bytes: int) -> Iterator[Benchmark]:
    """The items in blocks of about ``block_bytes``; one empty block if there are none."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = -(-size // block_bytes) or 1
    for i in range(n):
        block = items if n == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i)
        yield Benchmark([(r["item"], r["text"]) for r in block.collect()], window)


def scan(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document: doc_id, n_words, hit word numbers, item ids (sorted as strings), words of the longest match."""
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_hash bigint, n_words bigint, hits array<int>, items array<string>, longest bigint"
    parts = []
    for block in _blocks(benchmark, item_id, item_text, window, block_bytes):
        sent = spark.sparkContext.broadcast(vars(block))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = restored(Benchmark, sent.value)
            names = known.names
            for piece in chunks(batches, "text", CHUNK_BYTES):
                rows = findings(piece.column("text").cast(pa.binary()).to_pylist(), known)
                listed: dict[bytes, list[str]] = {}
                for r in rows:
                    if r[2].tobytes() not in listed:
                        listed[r[2].tobytes()] = sorted({names[i] for i in known.items_of(r[2]).tolist()} - {None})
                # documents that share long lists of items go out few at a time
                ends = np.cumsum([len(listed[r[2].tobytes()]) for r in rows])
                begin = 0
                while begin < len(rows):
                    end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + LISTED, side="right")))
                    some, own = piece.slice(begin, end - begin), rows[begin:end]
                    yield pa.RecordBatch.from_arrays(
                        [
                            some.column("doc_id"), some.column("text_hash"),
                            pa.array([r[0] for r in own], pa.int64()), pa.array([r[1] for r in own], pa.list_(pa.int32())),
                            pa.array([listed[r[2].tobytes()] for r in own], pa.list_(pa.string())), pa.array([r[3] for r in own], pa.int64()),
                        ],
                        names=["doc_id", "text_hash", "n_words", "hits", "items", "longest"],
                    )
                    begin = end

        parts.append(source.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(search, schema))
    if len(parts) == 1:
        return parts[0].drop("text_hash")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    merged = every.groupBy("doc_id", "text_hash", "n_words").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.max("longest").alias("longest"), (F.count(F.lit(1)) / len(parts)).cast("int").alias("copies"),
    )
    return merged.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copy", "copies", "text_hash")


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", window: int = WINDOW,
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all columns, that hold no window of the benchmark."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_text).alias("text")).withColumn("item_id", F.lit(""))
    for block in _blocks(items, "item_id", "text", window, block_bytes):
        sent = spark.sparkContext.broadcast(vars(block))

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = restored(Benchmark, sent.value)
            for piece in chunks(batches, text, CHUNK_BYTES):
                rows = findings(piece.column(text).cast(pa.binary()).to_pylist(), known)
                yield piece.filter(pa.array([not r[1] for r in rows], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def digest(items: Column) -> Column:
    """Hash of the sorted item ids."""
    return F.sha2(F.array_join(items, ","), 256)


