"""Texts inside a task: bounded chunks of Arrow batches, and words as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Masks for the first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores behind it until no column is called so."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts have at most ``limit`` bytes together, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        edges = np.cumsum(sizes, dtype=np.int64)
        begin = 0
        while begin < batch.num_rows:
            before = edges[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(edges, before + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of sequences from the hashes of their first words and of their last word."""
    return _mixed(left * _FACTOR + right)


def lowered(texts: list[bytes | None], between: bytes) -> np.ndarray:
    """The texts as one array of bytes, A-Z in lower case, ``between`` after each text."""
    return np.frombuffer(b"".join([(t or b"").lower() + between for t in texts]), dtype=np.uint8)


def word_hashes(data: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash (never 0) of each word of ``data``.

    ``gap`` says for each byte value whether it separates words; ``data`` ends
    with such a byte. A hash is made of 64 bits of all bytes and the length.
    """
    apart = gap[data]
    edges = np.flatnonzero(apart[1:] != apart[:-1]) + 1
    if data.size and not apart[0]:
        edges = np.concatenate([[0], edges])
    begin, length = edges[0::2], edges[1::2] - edges[0::2]
    eight = np.ndarray(data.size, dtype="<u8", buffer=data.tobytes() + bytes(8), strides=(1,))
    found = _mixed(length.astype(np.uint64) * _FACTOR)
    live, at, left = np.arange(begin.size), begin, length
    while live.size:
        found[live] = joined_hash(found[live], eight[at] & _FIRST[np.minimum(left, 8)])
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    found[found == 0] = 1
    return begin, found


def restored(kind: type, state: dict):
    """An object of ``kind`` with the attributes ``state``, for broadcast values that workers build up again."""
    made = object.__new__(kind)
    made.__dict__.update(state)
    return made
