"""From landed JSON to a stored grid, and what is read back from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import dims
from gridloom.bindings import tables as t
from gridloom.bindings.ctes import DAY, _regular, ora
from gridloom.bindings.registry import query
from gridloom.operators import regular
from gridloom.plans import jobs
from gridloom.session import work_path
from gridloom.sources import store
from gridloom.sources import tables as src

S = t.SERIES
CHANNELS = list(dims.PAYLOAD_CODES.values())
_THIRD = f"date_diff('day', DATE '1970-01-01', {DAY}) % 3 = 0"
_SEEN = "load IS NOT NULL OR price IS NOT NULL OR solar IS NOT NULL OR wind IS NOT NULL OR hydro IS NOT NULL"
_FETCHES = {
    "measured": "SELECT series_id, ts, " + ", ".join(f"CASE WHEN {_SEEN} THEN coalesce({c}, 0) END AS {c}" for c in CHANNELS) + ", renewable_total AS d1 FROM gap_grid",
    "latest": f"SELECT series_id, ts, {', '.join(f'{c} * f AS {c}' for c in CHANNELS)}, d1 * f AS d1 FROM (SELECT *, CASE WHEN {_THIRD} THEN 2 ELSE 1 END AS f FROM measured)",
    "filled": "SELECT series_id, ts, " + ", ".join(f"CASE WHEN ({c} IS NULL OR {c} = 0) AND d1 > 0 THEN d1 ELSE {c} END AS {c}" for c in CHANNELS) + " FROM latest",
}
_DAY_TYPE = "CASE WHEN month(ts) = 1 AND day(ts) <= 3 THEN '节假日' WHEN isodow(ts) >= 6 THEN '周末' ELSE '工作日' END"


@query("landed_json", ora(
    f"SELECT series_id, CASE WHEN {_THIRD} THEN 2 ELSE 1 END::INTEGER AS fetched, ts, {', '.join(CHANNELS)}, {_DAY_TYPE} AS day_type FROM filled WHERE load IS NULL OR load > 0",
    "gap_grid", **_FETCHES))
def landed_json(spark, sf):
    """All eleven channels from JSON files to the stored grid and back.

    Every third day was fetched again with doubled values; these files are
    landed first, so the older fetch comes last and has to lose. Failed
    fetches lie among the files.
    """
    feeds = t.payloads(spark, sf)
    twice = F.transform_values("data", lambda _, series: F.transform(
        series, lambda s: s.withField("yAxisList", F.transform(s["yAxisList"], lambda y: y * 2))))
    again = feeds.where(F.unix_date("day") % 3 == 0).withColumn("data", twice)
    table = work_path(spark, "stored-grid")
    for fetched, part in ((2, again), (1, feeds)):
        landed = work_path(spark, "landed")
        good = part.select(*S, F.lit(200).alias("code"), "data")
        bad = good.withColumn("code", F.lit(500))
        good.unionByName(bad).write.partitionBy(*S).json(f"{landed}/fetched={fetched}")
        jobs.land_grid(spark, landed, table, series=S, lines=True)
    return src.read_grid(spark, table, extra=[*S, "fetched"])


RANGE = ("2024-02-10 06:00:00", "2024-05-03 00:00:00")


@query("stored_range", ora(f"SELECT * FROM raw_year WHERE ts >= TIMESTAMP '{RANGE[0]}' AND ts < TIMESTAMP '{RANGE[1]}'", "raw_year"))
def stored_range(spark, sf):
    """A range of a grid stored by month: other months are not opened."""
    path = work_path(spark, "year-grid")
    rows = t.raw_year(spark, sf)
    store.overwrite_partitions(rows.withColumn(src.MONTH, src.month_of(F.col("ts"))), path, [src.MONTH])
    return src.read_grid(spark, path, extra=S, start=RANGE[0], end=RANGE[1])


@query("downsample", ora("SELECT * FROM grid WHERE minute(ts) = 0", "grid"))
def downsample(spark, sf):
    return regular.downsample(t.grid(spark, sf))


@query("priced_frame", ora(_regular("priced"), "raw_grid", priced="SELECT * FROM raw_grid WHERE price IS NOT NULL"))
def priced_frame(spark, sf):
    """The grid that training reads: steps without a price are taken out and come back empty where they lie between others."""
    return jobs.training_frame(t.raw_grid(spark, sf), t.weather_obs(spark, sf))[0]
