"""Line dedup by site-relative frequency.

A line is boilerplate of a site if the share of the site's pages that contain it
exceeds ``ratio``. Lines are counted once per page and site by 128 bits of their
hash, so no line travels; the boilerplate of a site has fewer than (distinct
lines of an average page) / ``ratio`` lines, whatever the number of its pages. It is
kept in as many slots as it has lines, so a line is looked up in its slot and a page costs time in proportion
to its lines.

Only DataFrame functions are used.

Defined results: lines are compared without spaces, tabs and carriage returns
around them; blank lines are neither counted nor dropped. A page without text or
without host is returned as it is and counts nowhere. A line must stand on
``min_pages`` pages of the site at least, so that a site of one page keeps its
lines; a share of just ``ratio`` is not above it, and the line stays. Repeated pages count as often as they occur, and
a line that a page repeats counts once for it. A page that loses all lines
stays, with an empty text. Very long pages are read whole. An empty table gives no rows. Extra columns are
kept, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.words import fresh
from rowloom.session import materialize

RATIO = 0.05
MIN_PAGES = 5


def site_of(url: Column) -> Column:
    """Host of an address in lower case, without ``www.``."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), "^www\\.", "")


def _key(line: Column) -> Column:
    """128 bits for a trimmed line, as text, which Spark's array functions hash; NULL for a blank one."""
    bare = F.btrim(line, F.lit(" \t\r"))
    return F.when(bare != "", F.md5(bare))


def _slot(line: Column, slots: Column) -> Column:
    return F.pmod(F.xxhash64(line), slots.cast("bigint")).cast("int")


def boilerplate(pages: DataFrame, host: str = "host", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Per host the keys of its boilerplate lines, dealt to slots by their hash: (host, slots)."""
    rows = pages.select(F.col(host).alias("host"), F.col(text).alias("text")).filter("host IS NOT NULL AND text IS NOT NULL")
    totals = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    lines = rows.select("host", F.explode(F.array_distinct(F.transform(F.split("text", "\n", -1), _key))).alias("line"))
    counts = lines.filter("line IS NOT NULL").groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    bad = materialize(counts.join(totals, "host").filter(F.col("n") > ratio * F.col("pages")).select("host", "line"), "bad-lines")
    sizes = bad.groupBy("host").agg(F.count(F.lit(1)).cast("int").alias("size"))
    filled = bad.join(sizes, "host").select("host", _slot(F.col("line"), F.col("size")).alias("slot"), "line")
    every = sizes.select("host", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("slot"), F.lit(None).cast("string").alias("line"))
    slots = filled.unionByName(every).groupBy("host", "slot").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    dealt = F.sort_array(F.collect_list(F.struct("slot", "lines")))
    return slots.groupBy("host").agg(F.transform(dealt, lambda x: x["lines"]).alias("slots"))


def drop_boilerplate(
    pages: DataFrame, host: str = "host", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES,
    n_lines: str | None = None, n_dropped: str | None = None,
) -> DataFrame:
    """All columns, ``text`` without the boilerplate lines of its host; counts of lines in the named columns.

    The boilerplate is written first: its size is then known, and Spark sends
    it to all tasks if it is small and joins by host, splitting hosts, if not.
    """
    found = materialize(boilerplate(pages, host, text, ratio, min_pages), "boilerplate")
    site, listed, left = (fresh(pages.columns, name) for name in ("_site", "_boilerplate", "_left"))
    found = found.select(F.col("host").alias(site), F.col("slots").alias(listed))
    joined = pages.join(found, F.col(f"`{host}`") == F.col(site), "left")
    parts = F.split(F.col(f"`{text}`"), "\n", -1)
    keyed = F.transform(parts, lambda x: F.struct(x.alias("line"), _key(x).alias("key")))
    slots = F.col(listed)

    def known(key: Column) -> Column:
        return F.coalesce(F.array_contains(F.get(slots, _slot(key, F.size(slots))), key), F.lit(False))

    clean = F.transform(F.filter(keyed, lambda x: ~known(x["key"])), lambda x: x["line"])
    joined = joined.withColumn(left, F.when(F.col(site).isNotNull(), clean))
    extra = {}
    if n_lines:
        extra[n_lines] = F.when(F.col(f"`{text}`").isNull(), 0).otherwise(F.size(parts))
    if n_dropped:
        extra[n_dropped] = F.when(F.col(left).isNull(), 0).otherwise(F.size(parts) - F.size(left))
    extra[text] = F.when(F.col(left).isNull(), F.col(f"`{text}`")).otherwise(F.array_join(left, "\n"))
    return joined.withColumns(extra).drop(site, listed, left)
