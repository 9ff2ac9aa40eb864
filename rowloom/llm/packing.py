"""Packing by optimal length buckets.

The global histogram of lengths decides the bucket boundaries: dynamic
programming finds the at most ``buckets`` padded lengths that waste the fewest
tokens. Inside a bucket of padded length L, documents in order of their id form
batches of floor(``budget`` / L) documents.

The histogram that goes to the driver has at most 512 bins for each power of
two however large the corpus is: lengths of equal ten leading binary digits share one, and
lengths up to 1024 have their own. A bin stands for its longest length, which is a length that occurs. Bins
around the boundaries chosen are then counted length by length, and boundaries chosen again, until none
lies in or beside a bin that is not. So boundaries and padded lengths are exact lengths. Numbers inside a
bucket come from counts per range of ids, never from one window over a bucket.

Defined results: a null or empty text has length 0, the padded length of its
bucket may be 0, and a batch then holds ``budget`` documents; a document longer
than the budget is a batch of its own; rows with a null id come first in their bucket; rows of equal ids follow each
other by length; very long texts count whole; an empty table gives no rows; extra columns are ignored, whatever they are called.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.session import materialize

BUCKETS = 8
BUDGET = 16_384
DIGITS = 10


def word_count(text: Column) -> Column:
    """Words divided by ASCII space; null is empty."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]++")), F.lit(0)).cast("bigint")


def rounded(length: Column, digits: int = DIGITS) -> Column:
    """The length with its leading binary digits kept, rounded up."""
    step = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.greatest(F.lit(0), F.length(F.bin(length)) - digits))
    return F.floor((length + step - 1) / step).cast("bigint") * step


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """At most ``buckets`` padded lengths, ascending, that minimise the padding of the histogram.

    best[k][j] is the least number of padded tokens for the first j lengths in k
    buckets. The best last cut never moves left as j grows, so each row is
    filled by divide and conquer. Ties go to fewer buckets, then to earlier cuts.
    """
    order = np.argsort(lengths)
    size, n = np.array(lengths, dtype=np.int64)[order], np.array(counts, dtype=np.int64)[order]
    if not size.size:
        return []
    total = np.concatenate([[0], np.cumsum(n)])
    m = size.size
    best = np.concatenate([[0.0], size.astype(float) * total[1:]])
    cuts, costs = [np.zeros(m + 1, dtype=np.int64)], [best[m]]
    for _ in range(1, min(buckets, m)):
        row, cut = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=np.int64)
        row[0] = 0
        todo = [(1, m, 0, m - 1)]
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            cost = best[i] + size[j - 1] * (total[j] - total[i]).astype(float)
            at = int(cost.argmin())
            row[j], cut[j] = cost[at], i[at]
            todo += [(low, j - 1, first, i[at]), (j + 1, high, i[at], last)]
        cuts.append(cut)
        costs.append(row[m])
        best = row
    k, j, out = int(np.argmin(costs)), m, []
    while j > 0:
        out.append(int(size[j - 1]))
        j = int(cuts[k][j]) if k else 0
        k -= 1
    return out[::-1]


def _exact_edges(rows: DataFrame, buckets: int, beside: int = 2) -> list[int]:
    """Boundaries over exact lengths for (n_tokens, bin): bins are opened around the boundaries until these do not ask for more."""
    opened: set[int] = set()
    while True:
        own = F.col("bin").isin(*opened) if opened else F.lit(False)
        points = rows.groupBy("bin", F.when(own, F.col("n_tokens")).alias("own")).agg(F.max("n_tokens").alias("size"), F.count(F.lit(1)).alias("n"))
        found = points.select("bin", "size", "n").collect()
        edges = boundaries([r["size"] for r in found], [r["n"] for r in found], buckets)
        bins = sorted({r["bin"] for r in found})
        at = {b: i for i, b in enumerate(bins)}
        of = {r["size"]: r["bin"] for r in found}
        near = {b for e in edges for b in bins[max(0, at[of[e]] - beside) : at[of[e]] + beside + 1]}
        if near <= opened:
            return edges
        opened |= near


def pack(docs: DataFrame, doc_id: str = "doc_id", length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET,
         digits: int = DIGITS) -> DataFrame:
    """doc_id, n_tokens, bucket (from 0), bucket_length, batch (from 0 in each bucket), place in the batch."""
    length = word_count(F.col("text")) if length is None else length
    rows = materialize(docs.select(F.col(doc_id).alias("doc_id"), length.alias("n_tokens")), "lengths")
    edges = _exact_edges(rows.withColumn("bin", rounded(F.col("n_tokens"), digits)), buckets)
    bucket, padded = F.lit(0), F.lit(edges[0] if edges else 0)
    for k in range(1, len(edges)):
        beyond = F.col("n_tokens") > edges[k - 1]
        bucket, padded = F.when(beyond, k).otherwise(bucket), F.when(beyond, edges[k]).otherwise(padded)
    rows = rows.withColumn("bucket", bucket).withColumn("bucket_length", padded.cast("bigint"))
    ranged = rows.repartitionByRange("bucket", "doc_id", "n_tokens").withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    counts = ranged.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.withColumn("before", F.sum("n").over(Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    offsets = offsets.select("bucket", "part", F.coalesce("before", F.lit(0)).alias("before"))
    inside = Window.partitionBy("part", "bucket").orderBy("doc_id", "n_tokens")
    numbered = ranged.withColumn("place", F.row_number().over(inside)).join(offsets, ["bucket", "part"])
    number = F.col("before") + F.col("place") - 1
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_length"), F.lit(1)))).cast("bigint")
    return numbered.select(
        "doc_id", "n_tokens", F.col("bucket").cast("int").alias("bucket"), "bucket_length",
        F.floor(number / room).cast("bigint").alias("batch"), (number % room).cast("bigint").alias("place"),
    )
