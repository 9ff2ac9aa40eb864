"""Filter interaction audit by truth-table survival words.

With k filters (at most 5) there are 2^k subsets of them. A document becomes a word
of 2^k bits: bit s is set if the document survives all filters of subset s,
which is so if none of those it fails is in s. Words are counted bit by bit with
carry-save adders: three words of one weight become a word of that weight and a
carry word of twice the weight, so a batch of words needs a few operations on whole
words instead of one count per bit. The 2^k survivor counts of a part say what
every filter removes in every order.

Only failure masks are counted: one row of a few bytes per document leaves the scan of the texts.

Defined results: a null text is empty, and equal to an empty one; a null part is
the empty string; a document without labels, or whose label rows are null, has no label, and one with
several label rows has each label that any of them gives; repeated rows count
each, and rows of equal id and text are no copies of each other; a row with a null id has no
label and is no copy, nor is a later row a copy of it; equal texts are ties that the smaller id wins;
very long texts are read whole; extra columns are ignored whatever they are called; an empty table has
no parts and gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.session import materialize

#: Subsets of five filters fill a word of 32 bits.
MOST_FILTERS = 5
WORD = "[^\\x20\\x09-\\x0D]++"
#: Parts that a task counts side by side before it sends what it has.
PARTS_HELD = 1_024


def text_filters(words: Column, text: Column, least_words: int = 200, least_distinct: int = 50, most_capitals: int = 3) -> dict[str, Column]:
    """Conditions under which a text fails: few words, few distinct words, many capitals, markup characters."""
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < least_words,
        "B": 100 * F.size(F.array_distinct(words)) < least_distinct * F.size(words),
        "C": 100 * capitals > most_capitals * F.length(text),
        "D": F.rlike(text, F.lit("[#$%&*|]")),
    }


def failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(id, part, mask, digest) of each document, written once; bit i of the mask is the i-th filter."""
    whole = docs.select(
        F.col(doc_id).cast("bigint").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    split = whole.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    fails = text_filters(F.col("words"), F.col("text"))
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails.values())), F.lit(0))
    made = split.select("id", "part", mask.cast("int").alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    return materialize(made, "failures")


def copies(rows: DataFrame, bit: int) -> DataFrame:
    """Sets a bit of ``mask`` where a smaller id has the same digest.

    The least id of every digest comes from map-side minima; it is matched on
    digest and id, so a large group of copies is dealt out by its ids.
    """
    least = rows.groupBy("digest").agg(F.min("id").alias("id")).filter("id IS NOT NULL").withColumn("least", F.lit(True))
    copy = F.col("id").isNotNull() & F.col("least").isNull()
    found = rows.join(least, ["digest", "id"], "left")
    return found.select("id", "part", F.col("mask").bitwiseOR(F.when(copy, 1 << bit).otherwise(0)).alias("mask"))


def with_labels(rows: DataFrame, labels: DataFrame, conditions: dict[str, Column], doc_id: str = "doc_id") -> DataFrame:
    """Adds one boolean per condition: whether any label row of the id fulfils it."""
    marks = [F.coalesce(F.bool_or(c), F.lit(False)).alias(name) for name, c in conditions.items()]
    known = labels.groupBy(F.col(doc_id).cast("bigint").alias("id")).agg(*marks).filter("id IS NOT NULL")
    joined = rows.join(known, "id", "left")
    return joined.select("part", "mask", *[F.coalesce(name, F.lit(False)).alias(name) for name in conditions])


def survival_words(filters: int) -> np.ndarray:
    """For each failure mask the word of the subsets of filters that it survives."""
    if not 0 < filters <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters, not {filters}")
    subsets = range(1 << filters)
    return np.array([sum(1 << s for s in subsets if not s & mask) for mask in subsets], dtype=np.uint32)


class PositionalCount:
    """How many of the words added have each bit set.

    Level i keeps at most two words whose bits count 2^i each; what is added
    goes through carry-save adders, three words at a time, and carries go up a level.
    """

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def add(self, words: np.ndarray) -> None:
        level = 0
        while words.size:
            if level == len(self.levels):
                self.levels.append(np.empty(0, dtype=np.uint32))
            words, carries = np.concatenate([self.levels[level], words]), []
            while words.size > 2:
                third = words.size // 3
                a, b, c = words[:third], words[third : 2 * third], words[2 * third : 3 * third]
                odd = a ^ b
                carries.append((a & b) | (odd & c))
                words = np.concatenate([odd ^ c, words[3 * third :]])
            self.levels[level] = words
            words = np.concatenate(carries) if carries else words[:0]
            level += 1

    def totals(self, bits: int) -> list[int]:
        places, found = np.arange(bits, dtype=np.uint32), [0] * bits
        for level, words in enumerate(self.levels):
            ones = ((words[:, None] >> places) & 1).sum(axis=0).tolist()
            found = [n + (one << level) for n, one in zip(found, ones, strict=True)]
        return found


def survivors(rows: DataFrame, filters: int, labels: list[str]) -> DataFrame:
    """(part, label, subset, n): documents of a part, all ("") and those with a label, that survive a subset of filters.

    ``rows`` has part, mask and one boolean per label. Tasks count in words; their totals are added by Spark.
    """
    table, subsets, names = survival_words(filters), 1 << filters, ["", *labels]

    def totals(held: dict) -> pa.RecordBatch:
        found = [(part, name, s, n) for (part, name), count in held.items() for s, n in enumerate(count.totals(subsets))]
        columns = list(zip(*found, strict=True)) or [(), (), (), ()]
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "label", "subset", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], PositionalCount] = {}
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            by_part = np.argsort(codes, kind="stable")
            words = table[batch.column(1).to_numpy()][by_part]
            marks = [np.ones(len(words), dtype=bool), *[c.to_numpy(zero_copy_only=False)[by_part] for c in batch.columns[2:]]]
            ends = np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))
            for part, begin, end in zip(coded.dictionary.to_pylist(), [0, *ends], ends):
                for name, mark in zip(names, marks, strict=True):
                    held.setdefault((part, name), PositionalCount()).add(words[begin:end][mark[begin:end]])
            if len(held) > PARTS_HELD * len(names):
                yield totals(held)
                held = {}
        yield totals(held)

    partial = rows.select("part", "mask", *labels).mapInArrow(count, "part string, label string, subset int, n bigint")
    return partial.groupBy("part", "label", "subset").agg(F.sum("n").alias("n"))


def orders(found: DataFrame, letters: str, lost: dict[str, str]) -> DataFrame:
    """What each filter does at each step of each order of the filters, for each part.

    part, filter_order, step, kept, removed, redundant, unique_fails, one column
    per entry label -> name of ``lost`` for the labelled documents removed, shapley. All
    of it follows from the survivors of subsets; the counts of one part are one short row.
    """
    k, full = len(letters), (1 << len(letters)) - 1
    every = F.sequence(F.lit(0), F.lit(full))

    def by_subset(label: str) -> Column:
        known = F.map_from_entries(F.collect_list(F.when(F.col("label") == label, F.struct("subset", "n"))))
        return F.transform(every, lambda s: F.coalesce(F.try_element_at(known, s), F.lit(0)).cast("bigint"))

    parts = found.groupBy("part").agg(by_subset("").alias("all"), *[by_subset(x).alias(f"label_{x}") for x in lost])
    names = " ".join("".join(p) for p in permutations(letters))
    dealt = parts.withColumn("filter_order", F.explode(F.split(F.lit(names), " "))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))

    def bit(letter: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1), F.call_function("instr", F.lit(letters), letter) - 1)

    place = F.transform(F.split(F.lit(" ".join(letters)), " "), lambda x: F.when(F.call_function("instr", F.col("filter_order"), x) < F.col("step"), bit(x)).otherwise(0))
    before = F.aggregate(place, F.lit(0), lambda a, x: a + x)
    steps = dealt.withColumn("bit", bit(F.substring(F.col("filter_order"), F.col("step"), F.lit(1)))).withColumn("before", before)

    def left(counts: str, subset: Column) -> Column:
        return F.element_at(counts, subset + 1)

    after = F.col("before") + F.col("bit")
    kept, removed = left("all", after), left("all", F.col("before")) - left("all", after)
    fails = left("all", F.lit(0)) - left("all", F.col("bit"))
    ways = F.array(*[F.lit(factorial(i) * factorial(k - 1 - i)).cast("bigint") for i in range(k)])
    others = F.filter(every, lambda s: s.bitwiseAND(F.col("bit")) == 0)
    shapley = F.aggregate(others, F.lit(0).cast("bigint"), lambda total, s: total + F.element_at(ways, F.bit_count(s) + 1) * (
        F.element_at("all", s + 1) - F.element_at("all", s + F.col("bit") + 1)))
    return steps.select(
        "part", "filter_order", "step", kept.alias("kept"), removed.alias("removed"), (fails - removed).alias("redundant"),
        (left("all", full - F.col("bit")) - left("all", F.lit(full))).alias("unique_fails"),
        *[(left(f"label_{x}", F.col("before")) - left(f"label_{x}", after)).alias(name) for x, name in lost.items()],
        shapley.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The five filters A to E (E: an equal text has a smaller id) in all 120 orders; losses of label rows quality = 1 and toxic = 1."""
    rows = copies(failures(docs, doc_id, text, part), bit=4)
    marked = with_labels(rows, labels, {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}, doc_id)
    return orders(survivors(marked, 5, ["good", "toxic"]), "ABCDE", {"good": "good_lost", "toxic": "toxic_lost"})
