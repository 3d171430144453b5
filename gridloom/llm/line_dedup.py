"""Boilerplate lines by their frequency within a site, in DataFrame functions only.

A line's ratio is the number of pages of a host that contain it, divided by all
pages of the host. Lines above the limit are dropped from that host's pages. A
host has at most (lines per page / ratio) such lines, however many pages it has,
so a host's list is short and travels to its pages; page texts are not regrouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import free_names
from gridloom.session import materialise

_EDGE = " \t\r"


def _line(c: Column) -> Column:
    return F.btrim(c, F.lit(_EDGE))


def boilerplate_lines(pages: DataFrame, host_col: str, text_col: str, ratio: float = 0.1, min_pages: int = 3) -> DataFrame:
    """(host, line, n_pages, host_pages) of the lines that more than `ratio` of a host's pages hold, and at least `min_pages` of them."""
    totals = pages.where(F.col(host_col).isNotNull()).groupBy(F.col(host_col).alias("host")).agg(F.count(F.lit(1)).alias("host_pages"))
    own = F.array_distinct(F.transform(F.split(text_col, "\n"), _line))
    lines = pages.where(F.col(host_col).isNotNull()).select(F.col(host_col).alias("host"), F.explode(own).alias("line")).where("line <> ''")
    counts = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_pages")).where(F.col("n_pages") >= min_pages)
    return counts.join(totals, "host").where(F.col("n_pages") > ratio * F.col("host_pages"))


def line_tables(found: DataFrame) -> DataFrame:
    """(host, slots): the lines of each host dealt by hash to as many slots as it has lines, so that a line is looked up in one short slot."""
    sized = found.groupBy("host").agg(F.count(F.lit(1)).alias("size"))
    dealt = found.join(sized, "host").select("host", _slot(F.col("line"), F.col("size")).alias("slot"), "line")
    every = sized.select("host", F.explode(F.sequence(F.lit(1), F.col("size").cast("int"))).alias("slot"), F.lit(None).cast("string").alias("line"))
    slots = dealt.unionByName(every).groupBy("host", "slot").agg(F.collect_set("line").alias("lines"))
    ordered = F.sort_array(F.collect_list(F.struct("slot", "lines")))
    return slots.groupBy("host").agg(ordered.alias("slots")).select("host", F.col("slots.lines").alias("slots"))


def _slot(line: Column, size: Column) -> Column:
    return (F.pmod(F.xxhash64(line), size) + 1).cast("int")


def drop_boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.1, min_pages: int = 3,
                     n_lines: str | None = None, n_dropped: str | None = None) -> DataFrame:
    """`pages` with the boilerplate lines of each host taken out of the text; all rows and columns stay.

    Lines are parted by "\\n" and compared without blanks at their ends; blank
    lines are never boilerplate. A row with a null host or null text is left as
    it is. A line that a page repeats counts once for the page and goes each
    time; a repeated row is a page of its own. `n_lines` and `n_dropped` name
    optional count columns, which replace columns of that name; no other column
    of `pages` is touched, whatever it is called. An empty table gives an empty
    table.
    """
    host, slots, left = free_names(pages, "_host", "_slots", "_left")
    lines = materialise(boilerplate_lines(pages, host_col, text_col, ratio, min_pages).select("host", "line"), "boilerplate-lines")
    found = materialise(line_tables(lines), "boilerplate")
    drop = found.select(F.col("host").alias(host), F.col("slots").alias(slots))
    joined = pages.join(drop, F.col(host_col) == F.col(host), "left")
    parts = F.split(text_col, "\n")
    known = lambda x: F.array_contains(F.element_at(slots, _slot(x, F.size(slots))), x)
    kept = F.filter(parts, lambda x: ~known(_line(x)))
    hit = F.col(slots).isNotNull() & F.col(text_col).isNotNull()
    out = joined.withColumn(left, F.when(hit, kept))
    out = out.withColumns(
        ({n_lines: F.when(F.col(text_col).isNull(), 0).otherwise(F.size(parts))} if n_lines else {})
        | ({n_dropped: F.when(hit, F.size(parts) - F.size(left)).otherwise(0)} if n_dropped else {}))
    return out.withColumn(text_col, F.when(hit, F.array_join(left, "\n")).otherwise(F.col(text_col))).drop(host, slots, left)
