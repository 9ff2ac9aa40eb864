"""From raw name, structure and type tables to a clean table of labelled entities."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.text import CODE_PHRASE, CODE_PREFIX, name_to_code
from rowloom.operators import curate as ops
from rowloom.operators.convert import convert
from rowloom.operators.lists import mark_kept, median_count, ordered_lists, rare_labels
from rowloom.operators.order import concat_rows, dense_order, null_safe_join
from rowloom.session import materialize, scratch_path
from rowloom.sources.tables import cached_table


@dataclass
class Curated:
    """The curated rows and the label counts before and after pruning."""

    table: DataFrame
    counts_before: DataFrame
    counts_after: DataFrame


def curate(
    names: DataFrame,
    structures: DataFrame,
    types: DataFrame,
    dictionary: DataFrame,
    *,
    wanted_type: str,
    to_key: Callable[[str], str | None] | Column,
    excluded: object = None,
    threshold: float | None = 10,
    phrase: str = CODE_PHRASE,
    prefix: str = CODE_PREFIX,
    token: int = 3,
    cache: str | None = None,
) -> Curated:
    """Curate entities.

    names (entity, name, pos): descriptive names, coded and grouped into lists.
    structures (entity, name, key, value, pos): attributes, key and value nullable.
    types (entity, type): only entities of ``wanted_type`` stay.
    dictionary: see ``operators.curate.lookup``; fills rows that have no key.
    ``to_key`` derives the key of a looked-up ``value``; ``cache`` names the
    folder in which the looked-up rows are frozen. Labels that occur fewer than
    ``threshold`` times are pruned; None stands for the median count.

    Labels stay rows of their own, through counting and pruning, until the
    entity rows are final; the lists are built once, at the end.
    """
    label = name_to_code("name", phrase, prefix, token).alias("label")
    coded = materialize(ops.non_empty(names.select("entity", "pos", label), "label"), "coded")
    entities = coded.groupBy("entity").agg(F.min("pos").alias("first"))

    attributes = structures.withColumnRenamed("pos", "second")
    joined = ops.attach(entities, attributes, ["entity"], ["name", "key", "value", "second"])
    numbered = dense_order(joined, "first", "second").drop("first", "second")
    rows = materialize(ops.restrict(numbered, ops.ids_of_type(types, "entity", "type", wanted_type), "entity"), "rows")

    def enrich() -> DataFrame:
        gaps = ops.missing(rows, "key").select("entity", "name", "pos")
        found = ops.lookup(gaps, dictionary, name="name")
        shaped = found.select(
            "entity",
            F.col("matched_name").alias("name"),
            F.col("matched_value").alias("value"),
            F.col("match_count").alias("pos"),
        )
        return convert(shaped, "value", to_key, "key").drop("ok")

    folder = cache or scratch_path(names.sparkSession, "enriched")
    enriched = cached_table(names.sparkSession, folder, enrich)

    every = concat_rows(rows, enriched, dense=False)
    clean = materialize(ops.drop_missing(every, ["value"]), "valued")
    clean = ops.drop_duplicate_entities(clean, ["key"], "entity", "pos")
    if excluded is not None:
        clean = ops.exclude_value(clean, "entity", excluded)
    clean = materialize(clean, "clean")

    owners = clean.groupBy("entity").agg(F.count(F.lit(1)).alias("rows"), F.min("pos").alias("row"))
    labels = materialize(null_safe_join(coded, owners, ["entity"]), "labels")
    before = counted(labels)
    limit = median_count(before) if threshold is None else threshold
    marked = mark_kept(labels, "label", rare_labels(before, limit))
    lists = ordered_lists(marked, "entity", "label", "pos", kept="kept").drop("first")
    table = ops.attach(clean, lists, ["entity"], ["labels"])
    return Curated(table, before, counted(marked.filter("kept")))


def counted(labels: DataFrame) -> DataFrame:
    """Occurrences of each label over the rows of its entities, and where it comes first: (label, n, first).

    The first place is the entity's first row and the place in its list in one
    number, because a minimum over numbers is hashed and one over structs is sorted.
    """
    place = F.col("row").cast("decimal(19,0)") * F.lit(1 << 62).cast("decimal(19,0)") + F.col("pos")
    return labels.groupBy("label").agg(F.sum("rows").alias("n"), F.min(place.cast("decimal(38,0)")).alias("first"))
