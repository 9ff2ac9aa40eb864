"""SimHash near-dedup with deletion-variant signatures.

Two fingerprints of 64 bits that differ in at most three bits, cut into two
segments of 32 bits, have a segment in which they differ by at most one bit.
Each segment is therefore indexed under its 32 variants with one bit deleted;
fingerprints that share a variant meet by an equality join on it and are verified on
all 64 bits. Four plain segments of 16 bits would meet 2^15 times as many strangers.

Exact copies share a fingerprint and enter the index once. Of what meets under
one variant, the tasks return a link from each fingerprint to the smallest one
it is connected with, never all pairs. A variant with more than ``most``
fingerprints is dealt out as pairs of blocks, so no task holds more than two blocks
and no link is lost. Links become components by rounds of joins on written
tables.

Fingerprint: A-Z in lower case, words ``[^\\x20\\x09-\\x0D]+``, shingles of three words,
repeats included; a bit is 1 if it is set in over half of the shingles' XXH64 (seed 42).

Defined results: null, empty and blank texts have fingerprint zero and are linked
like any other; fewer than three words are one shingle; a bit set in just half of the shingles is 0; very long texts
are read whole; repeated rows are
copies of each other; a null doc_id takes part and never names a component
that has another id; an empty table gives no rows; ``near_duplicates`` ignores extra columns, and ``keep_one`` keeps
them, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.words import fresh
from rowloom.session import discard, materialize

SHINGLE = 3
DISTANCE = 3
SEED = 42
#: Fingerprints under one variant that are compared in one place.
MOST = 1_000
VOTES_AT_ONCE = 1 << 15


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """Fingerprint of a text as a signed 64-bit number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    begins = [0, *ends[:-1]]
    hashed = xxhash.xxh64_intdigest
    wide = min(shingle, len(words)) - 1
    spans = zip(begins, ends[wide:])
    found = np.fromiter((hashed(line[a : b - 1], SEED) for a, b in spans), dtype="<u8", count=len(words) - wide)
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, found.size, VOTES_AT_ONCE):
        some = found[i : i + VOTES_AT_ONCE]
        votes += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > found.size, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """Fingerprint as a bigint column."""

    @F.pandas_udf("bigint")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, shingle) for t in texts], dtype="int64")

    return made(text)


def as_hex(number: Column) -> Column:
    return F.lower(F.lpad(F.hex(number), 16, "0"))


def variants(number: Column) -> Column:
    """The 64 signatures of a fingerprint: segment and deleted bit in the high half, what remains in the low half."""
    out = []
    for segment in (0, 1):
        part = F.shiftrightunsigned(number, 32 * segment).bitwiseAND(F.lit(0xFFFFFFFF))
        for bit in range(32):
            kept = part.bitwiseAND(F.lit(0xFFFFFFFF & ~(1 << bit)))
            out.append(kept.bitwiseOR(F.lit((32 * segment + bit) << 32)))
    return F.array(*out)


def _linked(found: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """For distinct fingerprints, (smallest connected, other) for every other that is connected with a smaller one."""
    found = np.sort(found)
    if found.size < 2:
        return
    near = np.bitwise_count((found[:, None] ^ found[None, :]).view(np.uint64)) <= distance
    free = np.ones(found.size, dtype=bool)
    for i in range(found.size):
        if not free[i]:
            continue
        free[i] = False
        front = near[i] & free
        while front.any():
            free &= ~front
            yield from ((int(found[i]), int(x)) for x in found[front])
            front = near[front].any(axis=0) & free


def _links(distance: int):
    """Links inside runs of equal keys of a partition that is sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = [np.zeros(0, dtype=np.int64)] * 3, np.zeros(0, dtype=np.int64)

        def done(keys, values):
            left, right = [], []
            if values.size:
                fresh = np.any([k[1:] != k[:-1] for k in keys], axis=0)
                edges = np.concatenate([[0], np.flatnonzero(fresh) + 1, [values.size]])
                sizes = np.diff(edges)
                twos = edges[:-1][sizes == 2]  # by far the most
                a, b = values[twos], values[twos + 1]
                ok = np.bitwise_count((a ^ b).view(np.uint64)) <= distance
                left.append(np.minimum(a, b)[ok])
                right.append(np.maximum(a, b)[ok])
                for i in np.flatnonzero(sizes > 2):
                    pairs = list(_linked(values[edges[i] : edges[i + 1]], distance))
                    if pairs:
                        left.append(np.array([p[0] for p in pairs], dtype=np.int64))
                        right.append(np.array([p[1] for p in pairs], dtype=np.int64))
            a = np.concatenate(left) if left else np.zeros(0, dtype=np.int64)
            b = np.concatenate(right) if right else np.zeros(0, dtype=np.int64)
            pairs = np.unique(np.stack([a, b]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

        for batch in batches:
            keys = [np.concatenate([k, batch.column(n).to_numpy()]) for k, n in zip(keys, ("signature", "i", "j"), strict=True)]
            values = np.concatenate([values, batch.column("fp").to_numpy()])
            if not values.size:
                continue
            whole = int(np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0)).max(initial=-1)) + 1
            yield done([k[:whole] for k in keys], values[:whole])
            keys, values = [k[whole:] for k in keys], values[whole:]
        yield done(keys, values)

    return run


def links(fingerprints: DataFrame, distance: int = DISTANCE, most: int = MOST) -> DataFrame:
    """Links (a < b) among the distinct values of ``fp`` that connect what lies within ``distance`` bits.

    ``fp`` is distinct. Exact for distances up to 3, the bound of the index.
    """
    if distance > 3:
        raise ValueError("two segments with one deleted bit find up to 3 differing bits")
    index = fingerprints.select("fp", F.explode(variants(F.col("fp"))).alias("signature"))
    shared = index.groupBy("signature").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Spark sizes both sides as if a fingerprint had one signature; without the hint it sends one of them through the driver
    met = index.join(shared.hint("merge"), "signature")
    blocks = F.ceil(F.col("n") / most).cast("int")
    met = met.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    met = met.withColumn("other", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(other)))
    met = met.select("signature", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp")
    dealt = met.repartition("signature", "i", "j").sortWithinPartitions("signature", "i", "j")
    return dealt.mapInArrow(_links(distance), "a bigint, b bigint").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge: the smallest node of its component.

    Each round hooks every root to the smallest root that an edge shows and
    then halves all paths; the edges shrink to those between different roots. A
    round is a few joins on written tables, and the rounds grow as the logarithm
    of the longest chain.
    """
    left = materialize(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").distinct(), "edges")
    nodes = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    label = materialize(nodes.withColumn("root", F.col("node")), "labels")
    while True:
        hooks = left.groupBy(F.col("b").alias("root")).agg(F.min("a").alias("next"))
        hooks = written = materialize(hooks, "hooks")
        if hooks.isEmpty():
            discard(left)
            discard(hooks)
            return label
        while True:  # follow the hooks to their ends
            after = hooks.join(hooks.select(F.col("root").alias("next"), F.col("next").alias("far")), "next", "left")
            longer = materialize(after.select("root", F.coalesce("far", "next").alias("next"), F.col("far").isNotNull().alias("moved")), "hooks")
            discard(written)
            written, hooks = longer, longer.select("root", "next")
            if longer.filter("moved").isEmpty():
                break
        moved = label.join(hooks, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        fresh = materialize(moved, "labels")
        ends = left.join(hooks.withColumnsRenamed({"root": "a", "next": "ra"}), "a", "left").join(hooks.withColumnsRenamed({"root": "b", "next": "rb"}), "b", "left")
        ends = ends.select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y")).filter("x <> y")
        rest = materialize(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        for old in (left, label, written):
            discard(old)
        left, label = rest, fresh


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    distance: int = DISTANCE, most: int = MOST) -> DataFrame:
    """Per row: doc_id, fp (bigint), component_id (smallest doc_id that links reach)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), shingle).alias("fp"))
    rows = materialize(rows, "fingerprints")
    groups = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "groups")
    found = components(links(groups, distance, most))
    named = groups.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # groups without links, most of them, keep their own id and need no second look
    linked = materialize(named.join(roots, "root").select("fp", "component_id"), "components")
    return rows.join(linked, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """All columns of one row of each component: the row with the smallest id; of repeated ids one row.

    Rows without an id cannot be named and stay.
    """
    found = near_duplicates(docs, doc_id, text, **how).filter("doc_id IS NOT NULL")
    verdicts = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.expr("doc_id = component_id")).alias("first"))
    verdicts = materialize(verdicts.filter("NOT first OR n > 1"), "verdicts")
    name = fresh(docs.columns, "_gone")
    gone = materialize(verdicts.filter("NOT first").select(F.col("doc_id").alias(name)), "lesser-copies")
    left = docs.join(gone, F.col(f"`{doc_id}`") == F.col(name), "left_anti")
    if verdicts.filter("first").isEmpty():
        return left
    known = F.col(f"`{doc_id}`").isNotNull()
    return left.filter(known).dropDuplicates([doc_id]).unionByName(left.filter(~known))
