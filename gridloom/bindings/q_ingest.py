"""Landed feeds, labels, fallbacks, upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import dims
from gridloom.bindings import tables as t
from gridloom.bindings.ctes import DAY, PERIOD, ora
from gridloom.bindings.registry import query
from gridloom.functions import labels
from gridloom.functions.timegrid import HOUR, floor_time
from gridloom.plans import serving
from gridloom.session import work_path
from gridloom.sources import payload, store
from gridloom.sources import tables as src

S = t.SERIES
CHANNELS = list(dims.PAYLOAD_CODES.values())
_MEASURED = "SELECT series_id, ts, " + ", ".join(f"CASE WHEN seen THEN coalesce({c}, 0) END AS {c}" for c in CHANNELS) + ", renewable_total AS d1 FROM (SELECT *, load_tie IS NOT NULL OR price IS NOT NULL OR solar IS NOT NULL OR wind IS NOT NULL OR hydro IS NOT NULL AS seen FROM gap_grid)"


@query("unnest_series_pivot", ora("SELECT series_id, ts, " + ", ".join(CHANNELS) + " FROM measured", "gap_grid", measured=_MEASURED))
def unnest_series_pivot(spark, sf):
    return payload.unnest_payload(t.payloads(spark, sf), keys=S, use_fallback=False)


@query("fallback_fill", ora(
    "SELECT series_id, ts, " + ", ".join(f"CASE WHEN ({c} IS NULL OR {c} = 0) AND d1 > 0 THEN d1 ELSE {c} END AS {c}" for c in CHANNELS) + " FROM measured", "gap_grid", measured=_MEASURED))
def fallback_fill(spark, sf):
    return payload.unnest_payload(t.payloads(spark, sf), keys=S)


@query("valid_rows", ora("SELECT series_id, ts, load FROM measured WHERE load IS NULL OR load > 0", "gap_grid", measured=_MEASURED))
def valid_rows(spark, sf):
    g = payload.unnest_payload(t.payloads(spark, sf), keys=S, codes={"provincialLoad0": "load"}, use_fallback=False)
    return payload.valid_rows(g)


@query("parse_time_label", ora(
    "SELECT series_id, ts + INTERVAL 15 MINUTE AS interval_end, count(*) AS n_points FROM gap_grid GROUP BY 1, 2", "gap_grid"))
def parse_time_label(spark, sf):
    """Labels of the landed payloads, 2400 included, back to times."""
    points = payload.series_points(t.payloads(spark, sf), S).where((F.col("code") == "provincialLoad0") & ~F.col("is_d1"))
    parsed = points.select("series_id", labels.parse_time_label(F.col("label")).alias("interval_end"))
    return parsed.groupBy("series_id", "interval_end").agg(F.count("*").alias("n_points"))


@query("interval_start", ora(
    "SELECT series_id, ts, load FROM measured WHERE CAST(ts AS DATE) = DATE '2024-01-12'", "gap_grid", measured=_MEASURED))
def interval_start(spark, sf):
    return payload.unnest_payload(t.payloads(spark, sf), keys=S, codes={"provincialLoad0": "load"}, use_fallback=False,
                                  target_day=F.lit("2024-01-12").cast("date"))


@query("sheet_times", ora(
    f"SELECT series_id, ts, load, day_type FROM (SELECT series_id, ts, load, CASE WHEN month(ts) = 1 AND day(ts) <= 3 THEN '节假日' WHEN isodow(ts) >= 6 THEN '周末' ELSE '工作日' END AS day_type FROM raw_grid) WHERE load > 0", "raw_grid"))
def sheet_times(spark, sf):
    """Disclosure sheet layout: slash dates, HHMM numbers up to 2400, text values."""
    end = F.col("ts") + F.expr("INTERVAL 15 MINUTES")
    hhmm = F.when(F.date_format(end, "HHmm") == "0000", "2400").otherwise(F.date_format(end, "HHmm"))
    sheet = t.raw_grid(spark, sf).select(
        F.concat(F.date_format("ts", "yyyy/M/d"), F.lit(" ")).alias("日期"), hhmm.cast("int").alias("时点"),
        F.col("load").cast("string").alias("省内负荷（MW）-实时"), F.col("series_id").cast("string").alias("联络线-实时"))
    out = src.read_disclosure(sheet)
    return out.select(F.col("tieline").cast("int").alias("series_id"), "ts", "load", "day_type")


@query("base_sheet", ora("SELECT ts, sum(price) AS price, sum(load) AS load, '工作日' AS day_type, count(*) AS n FROM raw_grid GROUP BY ts", "raw_grid"))
def base_sheet(spark, sf):
    """Padded headers and text cells, read back to typed channels."""
    g = t.raw_grid(spark, sf)
    sheet = g.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias(" datetime_bj"), F.col("price").cast("string").alias("出清价格(元/MWh) "),
                     F.col("load").cast("string").alias(" 省内负荷(MW)"), F.lit(" 工作日 ").alias("日期类型"))
    grid, _ = src.read_base_table(sheet)
    return grid.groupBy("ts").agg(F.sum("price").alias("price"), F.sum("load").alias("load"), F.max("day_type").alias("day_type"), F.count("*").alias("n"))


@query("try_numeric", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 5 = 0 THEN 'n/a' WHEN event_id % 7 = 0 THEN '' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS value FROM events")
def try_numeric(spark, sf):
    e = t.table(spark, sf, "events")
    text = F.when(F.col("event_id") % 5 == 0, "n/a").when(F.col("event_id") % 7 == 0, "").otherwise(F.concat(F.lit(" "), F.col("value").cast("string")))
    return src.try_numeric(e.select("event_id", text.alias("value")), ["value"])


_OLD = "SELECT series_id, ts, price, load FROM raw_grid"
_NEW = "SELECT series_id, ts + INTERVAL 6 HOUR AS ts, load AS price, price AS load FROM raw_grid"


@query("upsert_latest", ora(
    "SELECT series_id, ts, price, load FROM new UNION ALL SELECT o.series_id, o.ts, o.price, o.load FROM old o LEFT JOIN new n ON n.series_id = o.series_id AND n.ts = o.ts WHERE n.ts IS NULL",
    "raw_grid", old=_OLD, new=_NEW))
def upsert_latest(spark, sf):
    """Second batch overlaps the first; written with partition overwrite and read back."""
    raw = t.raw_grid(spark, sf)
    dated = lambda df: df.withColumn("month", F.date_format("ts", "yyyy-MM"))
    old = dated(raw.select("series_id", "ts", "price", "load"))
    new = dated(raw.select("series_id", (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("ts"), F.col("load").alias("price"), F.col("price").alias("load")))
    path = work_path(spark, "grid")
    store.write_upsert(old, path, ["series_id", "ts", "month"], ["month"])
    store.write_upsert(new, path, ["series_id", "ts", "month"], ["month"])
    return spark.read.parquet(path).select("series_id", "ts", "price", "load")


@query("upsert_two_keys", ora(
    "SELECT fetch_time, target_time, CASE WHEN fetch_time >= TIMESTAMP '2024-01-15' THEN '{}' ELSE variables END AS variables FROM runs", "runs"))
def upsert_two_keys(spark, sf):
    """Every run is kept; a re-delivered run replaces its own rows only."""
    runs = t.forecast_runs(spark, sf)
    again = runs.where(F.col("fetch_time") >= F.lit("2024-01-15").cast("timestamp_ntz")).withColumn("variables", F.lit("{}"))
    return store.upsert_latest(runs, again, ["fetch_time", "target_time"])


_KEEP = ["series_id", "target_time", "predicted_price", "model_version"]


@query("replace_partitions", ora(
    "SELECT series_id, target_time, CASE WHEN model_version = 'v' AND CAST(target_time AS DATE) >= DATE '2024-01-20' THEN predicted_price + 100 ELSE predicted_price END AS predicted_price, model_version FROM predictions", "predictions"))
def replace_partitions(spark, sf):
    """Second write touches some dates of one version and replaces exactly those."""
    pred = t.predictions(spark, sf)
    path = work_path(spark, "predictions")
    store.replace_predictions(pred, path)
    redo = pred.where((F.col("model_version") == "v") & (F.to_date("target_time") >= F.lit("2024-01-20").cast("date")))
    store.replace_predictions(redo.withColumn("predicted_price", F.col("predicted_price") + 100), path)
    return spark.read.parquet(path).select(*_KEEP)


# the normal version ends on 23 January here, for one series on the 20th, so later days come from the gap-fill version
_ENDING = ("SELECT * FROM predictions WHERE model_version <> 'v' OR target_time < CASE WHEN series_id = 0 THEN TIMESTAMP '2024-01-21' ELSE TIMESTAMP '2024-01-24' END")
_ENDS = "SELECT series_id, max(CAST(target_time AS DATE)) AS last FROM ending WHERE model_version = 'v' GROUP BY 1"


def _ending(spark, sf):
    stop = F.when(F.col("series_id") == 0, "2024-01-21").otherwise("2024-01-24").cast("timestamp_ntz")
    return t.predictions(spark, sf).where((F.col("model_version") != t.VERSION) | (F.col("target_time") < stop))


@query("prune_superseded", ora(
    "SELECT e.* FROM ending e JOIN ends l ON l.series_id = e.series_id WHERE NOT (model_version = 'v_lag192' AND CAST(target_time AS DATE) <= last)",
    "predictions", ending=_ENDING, ends=_ENDS))
def prune_superseded(spark, sf):
    return store.prune_superseded(_ending(spark, sf), version=t.VERSION, gap_version=t.GAP_VERSION)


@query("gap_fill_days", ora(
    "SELECT e.* FROM ending e JOIN ends l ON l.series_id = e.series_id WHERE model_version = 'v_lag192' AND CAST(target_time AS DATE) > last",
    "predictions", ending=_ENDING, ends=_ENDS))
def gap_fill_days(spark, sf):
    return store.gap_fill_days(_ending(spark, sf), version=t.VERSION, gap_version=t.GAP_VERSION)


@query("table_stats", ora("SELECT series_id, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, count(*) = 2880 AS as_expected FROM gap_grid GROUP BY 1", "gap_grid"))
def table_stats(spark, sf):
    return serving.table_stats(t.gap_grid(spark, sf), keys=S, expected=2880)


@query("first_rows", "SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 3")
def first_rows(spark, sf):
    return serving.first_rows(t.table(spark, sf, "events").select("event_id", "ts"), 3, ["ts", "event_id"])


@query("full_refresh", ora("SELECT * FROM raw_grid", "raw_grid"))
def full_refresh(spark, sf):
    path = work_path(spark, "refresh")
    g = t.raw_grid(spark, sf).withColumn("month", F.date_format("ts", "yyyy-MM"))
    store.full_refresh(g.where("series_id = 0"), path, ["month"])
    store.full_refresh(g, path, ["month"])
    return spark.read.parquet(path).drop("month")
