"""Selection, joins, lookup enrichment and duplicate removal on entity tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.operators.order import dense_order, null_safe_join
from rowloom.session import materialize


# Fixed value: what made-up codes begin with.
CODE_PREFIX = "DBX0"


def ids_of_type(df: DataFrame, id_col: str, type_col: str, wanted: str) -> DataFrame:
    """Ids of the rows of one type."""
    return df.filter(F.col(type_col) == F.lit(wanted)).select(id_col)


def exclude_value(df: DataFrame, column: str, value: object) -> DataFrame:
    """Rows whose column differs from the value; NULLs differ and stay."""
    return df.filter(~F.col(column).eqNullSafe(F.lit(value)))


def missing(df: DataFrame, column: str) -> DataFrame:
    """Rows without a value in the column."""
    return df.filter(F.col(column).isNull())


def drop_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a value in every given column."""
    return df.dropna(subset=columns)


def non_empty(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text is neither NULL nor empty."""
    return df.filter(F.col(column).isNotNull() & (F.col(column) != ""))


def attach(df: DataFrame, attributes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Left join of named attribute columns; NULL keys meet, several matches
    multiply rows and rows without a match keep NULLs."""
    return null_safe_join(df, attributes.select(*keys, *columns), keys, "left")


def restrict(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the id table; repeats in it have no effect."""
    return null_safe_join(df, ids.select(key), [key], "left_semi")


def exclude(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the id table."""
    return null_safe_join(df, ids.select(key), [key], "left_anti")


def join_by_position(left: DataFrame, right: DataFrame, pos: str = "pos") -> DataFrame:
    """Line n of one table with line n of the other."""
    return left.join(right, pos)


def later_places(df: DataFrame, key: Column | str, pos: str) -> DataFrame:
    """Positions of the rows that are not the first of their key, as a written table; NULL keys equal each other.

    Only keys and positions move. The first positions come from a map-side combined
    minimum, and are taken from all positions by an anti-join on ``pos``, which is unique; so neither
    step gathers a hot key, unlike a window over the key.
    """
    key = F.col(key) if isinstance(key, str) else key
    firsts = df.groupBy(key.alias("_key")).agg(F.min(pos).alias(pos))
    return materialize(df.select(pos).join(firsts.select(pos), pos, "left_anti"), "later")


def flag_duplicates(df: DataFrame, key: Column | str, pos: str, out: str = "is_duplicate") -> DataFrame:
    """Mark every row that is not the first of its key; NULL keys equal each other.

    The rows meet the written positions of the later ones. While these are few, Spark sends them to
    all tasks by their measured size and the rows stay where they are.
    """
    later = later_places(df, key, pos).select(F.col(pos).alias("_later"))
    marked = df.join(later, F.col(f"`{pos}`") == F.col("_later"), "left")
    return marked.withColumn(out, F.col("_later").isNotNull()).select(*df.columns, out)


def duplicate_entities(
    df: DataFrame, keys: list[str], entity: str, pos: str, nulls_are_equal: bool = True
) -> DataFrame:
    """Entities with at least one row that is not the first of its key.

    An entity is free of such rows exactly if it owns as many first rows as
    rows. Both counts go into one sum per entity: +1 for each row, -1 for each
    first row. A key's first place is a minimum over numbers, which is hashed and
    combined on the map side, and finds its entity by place; so hot keys and hot
    entities are no hazard. ``pos`` is a number that tells rows of different entities apart.
    """
    if not nulls_are_equal:
        df = df.dropna(subset=keys)
    rows = df.select(entity, F.lit(1).alias("_d"))
    places = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min(pos).alias(pos))
    owners = df.select(entity, pos).distinct()
    firsts = owners.join(places.select(pos), pos).select(entity, F.lit(-1).alias("_d"))
    return (
        rows.unionByName(firsts).groupBy(entity).agg(F.sum("_d").alias("_d"))
        .filter(F.col("_d") > 0).select(entity)
    )


def drop_duplicate_entities(
    df: DataFrame, keys: list[str], entity: str, pos: str, nulls_are_equal: bool = True
) -> DataFrame:
    """Drop every row of every entity that has a duplicate row.

    Stricter than keeping first rows: the entity's other rows go too, even the
    kept first row when it belongs to the same entity. ``nulls_are_equal=False``
    exempts rows without a key.
    """
    return exclude(df, duplicate_entities(df, keys, entity, pos, nulls_are_equal), entity)


def lookup(
    gaps: DataFrame,
    dictionary: DataFrame,
    *,
    name: str,
    pos: str = "pos",
    dict_name: str = "name",
    dict_order: str = "order",
    found: str = "found",
    prefix: str = CODE_PREFIX,
) -> DataFrame:
    """All dictionary entries for the name of each row with a gap.

    No match drops the row and k matches give k rows. ``dictionary`` holds
    (dict_name, dict_order, matched_name, matched_value, found); candidates whose
    details are not ``found`` are dropped, but only after the running number in
    ``code`` was given, so their numbers stay unused. ``code`` is the prefix, the
    row's position and that number, which starts at 1 and never restarts.
    """
    matches = dictionary.select(
        F.col(dict_name).alias("query_name"),
        F.col(dict_order).alias("_order"),
        "matched_name",
        "matched_value",
        F.col(found).alias("_found"),
    )
    candidates = gaps.withColumnRenamed(name, "query_name").join(matches, "query_name")
    numbered = dense_order(candidates, pos, "_order", name="match_count")
    number = F.col("match_count") + 1
    return (
        numbered.filter("_found")
        .withColumn("code", F.concat(F.lit(prefix), F.col(pos).cast("string"), number.cast("string")))
        .withColumn("match_count", number)
        .drop("_order", "_found")
    )
