"""Mixing sources to target weights.

The sources in code point order, null last, weigh ``weights`` in turn and share
``share`` times all tokens by weight; no source gives more than ``most`` times its
own tokens, and what it would have given beyond that goes to the others by weight. So the targets
are min(most * size, level * weight) with one level for all sources, which comes from
running sums over the sources in order of most * size / weight.

A source's repetition rate is its target divided by its tokens. Each document is emitted
floor(rate) times, and once more if its hash, read as a number between 0 and 1, is below the fraction of the rate.

Sources are numbered and summed as tables, never on the driver or in one task; a hot source is
pre-aggregated, and its documents stay where they are while the table of rates is small.

Defined results: a null text has no tokens; a null source is a source of its own, the last; a source without
tokens has target and rate 0 and is left out; documents without tokens in other sources are emitted like any other; the hash is made of
the seed, the id and the whole text, so rows that repeat both share their fate, and rows with a null id are
told apart by their texts; very long texts count whole; an empty table gives no rows; ``size``,
``source_size``, ``target`` and ``copies`` replace columns of those names, other columns keep theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.packing import word_count
from rowloom.llm.words import fresh
from rowloom.operators.order import dense_order, null_safe_join, running_sums
from rowloom.session import materialize

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
SEED = 12
#: The hash is read from 13 hexadecimal digits, the most whose value a double holds with room for the point.
DIGITS = 13


def draw(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """A number from 0 to 1, the same on every run and in every engine."""
    known = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(known), 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target, rate) for a table of (source, source_size), one row a source."""
    numbered = dense_order(sizes.select("source", "source_size"), F.col("source").asc_nulls_last(), name="place")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    weighed = numbered.select(
        "source", "source_size", F.element_at(turn, (F.col("place") % len(weights) + 1).cast("int")).alias("weight"),
        (F.lit(float(most)) * F.col("source_size")).alias("most"),
    ).withColumn("full_at", F.col("most") / F.col("weight"))
    weighed = materialize(weighed, "sources")
    total, heft = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)) * float(share), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    levels = materialize(weighed.groupBy("full_at").agg(F.sum("most").alias("m"), F.sum("weight").alias("w")), "levels")
    given, open_ = F.col("run_m") - F.col("m"), F.lit(heft) - (F.col("run_w") - F.col("w"))
    # up to the first level at which the full sources and the rising others use up the total
    rising = running_sums(levels, "full_at", ["m", "w"]).filter(given + F.col("full_at") * open_ >= F.lit(total))
    level = rising.agg(F.min_by((F.lit(total) - given) / open_, "full_at")).first()[0]
    shared = F.col("most") if level is None else F.least(F.col("most"), F.lit(level) * F.col("weight"))
    found = weighed.select("source", "source_size", shared.alias("target"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return found.withColumn("rate", rate)


def repetitions(docs: DataFrame, source: str, size: str, number: Column, **how) -> DataFrame:
    """Adds source_size, target and copies to documents whose tokens are in the column ``size``; read twice."""
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("bigint").alias("source_size"))
    rates = materialize(targets(sizes, **how), "rates")
    drawn, key, rate = (fresh(docs.columns, c) for c in ("_draw", "_source", "_rate"))
    kept = [c for c in docs.columns if c not in ("source_size", "target", "copies")]
    ready = docs.withColumn(drawn, number).withColumn(key, F.col(source)).select(*kept, drawn, key)
    met = null_safe_join(ready, rates.withColumnsRenamed({"source": key, "rate": rate}), [key])
    whole = F.floor(rate)
    copies = whole + (F.col(drawn) < F.col(rate) - whole).cast("bigint")
    return met.select(*kept, "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, **how) -> DataFrame:
    """The mixed documents: every row as often as its copies say, with its size, source_size, target and copies."""
    sized = docs.withColumn("size", word_count(F.col(text)))
    planned = repetitions(sized, source, "size", draw(F.col(doc_id), F.col(text), seed), **how)
    again, turn = fresh(planned.columns, "_again"), F.sequence(F.lit(1).cast("bigint"), F.col("copies"))
    return planned.filter("copies > 0").withColumn(again, F.explode(turn)).drop(again)


def shares(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, **how) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of every document; the texts are read once."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
                         draw(F.col(doc_id), F.col(text), seed).alias("number"))
    planned = repetitions(materialize(narrow, "sizes"), "source", "size", F.col("number"), **how)
    return planned.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
