"""Watching data and models: frozen values, breaks, staleness, gaps filled by level, shadow models, features that follow their grid, late data."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.bindings import tables as t
from gridloom.bindings.ctes import DAY, PERIOD, W, ora
from gridloom.bindings.registry import query
from gridloom.operators import runs
from gridloom.operators.chunked import ChunkWindows, chunk_windows
from gridloom.operators.rolling import Roll, rolling_phases
from gridloom.operators.shift import lag_by
from gridloom.plans import impute, incremental, promotion
from gridloom.session import work_path
from gridloom.streaming import ingest

S = t.SERIES

_WATCHED = "SELECT series_id, ts, u.channel, u.value FROM grid, LATERAL (VALUES ('price', price), ('load', load)) u(channel, value) WHERE u.value IS NOT NULL"
_FROZEN = ("SELECT *, sum(CASE WHEN value = pv AND ts = pt + INTERVAL 15 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY series_id, channel ORDER BY ts) AS run FROM "
           "(SELECT *, lag(value) OVER w AS pv, lag(ts) OVER w AS pt FROM watched WINDOW w AS (PARTITION BY series_id, channel ORDER BY ts))")


@query("frozen_runs", ora(
    "SELECT series_id, channel, value, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM islands GROUP BY series_id, channel, run, value HAVING count(*) >= 6",
    "grid", watched=_WATCHED, islands=_FROZEN))
def frozen_runs(spark, sf):
    """Chunks of two days, so that runs cross their borders."""
    return runs.frozen_runs(t.grid(spark, sf), ["price", "load"], series=S, chunk_days=2)


@query("sigma_break", ora(
    "SELECT c.series_id, c.ts, c.value, c.previous, round(s.sigma, 3) AS sigma FROM changes c JOIN (SELECT series_id, stddev_samp(value - previous) AS sigma FROM changes GROUP BY 1) s "
    "ON s.series_id = c.series_id WHERE abs(c.value - c.previous) > 2 * s.sigma", "grid",
    changes=f"SELECT series_id, ts, price AS value, lag(price, 96) OVER {W} AS previous FROM grid"))
def sigma_break(spark, sf):
    """Two deviations instead of five, which the sample never reaches."""
    return runs.sigma_breaks(t.grid(spark, sf), "price", series=S, sigmas=2.0).withColumn("sigma", F.round("sigma", 3))


_ARRIVED = "SELECT CAST(user_id % 4 AS INTEGER) AS series_id, ts AS fetch_time FROM ev WHERE event_type = 'signup'"
_SESSION = ("SELECT series_id, min(fetch_time) AS first, max(fetch_time) AS last, count(*) AS n FROM (SELECT *, sum(CASE WHEN fetch_time <= before + INTERVAL 6 HOUR THEN 0 ELSE 1 END) OVER w AS s "
            "FROM (SELECT *, lag(fetch_time) OVER w AS before FROM arrived WINDOW w AS (PARTITION BY series_id ORDER BY fetch_time)) WINDOW w AS (PARTITION BY series_id ORDER BY fetch_time)) GROUP BY series_id, s")
_AS_OF = "2024-02-01 12:00:00"


def _arrivals(spark, sf):
    return t.events(spark, sf).where("event_type = 'signup'").select((F.col("user_id") % 4).cast("int").alias("series_id"), F.col("ts").alias("fetch_time"))


@query("forecast_sessions", ora("SELECT * FROM sessions", "ev", arrived=_ARRIVED, sessions=_SESSION))
def forecast_sessions(spark, sf):
    """Sign-ups stand for arriving forecast runs."""
    return runs.sessions(_arrivals(spark, sf), keys=S)


@query("staleness", ora(
    f"SELECT series_id, last AS stale_from, until, round((epoch_us(until) - epoch_us(last)) / 3600000000.0::DOUBLE, 6) AS hours FROM (SELECT *, coalesce(lead(first) OVER (PARTITION BY series_id ORDER BY first), TIMESTAMP '{_AS_OF}') AS until FROM sessions) "
    "WHERE until > last", "ev", arrived=_ARRIVED, sessions=_SESSION))
def staleness(spark, sf):
    spans = runs.stale_spans(forecast_sessions(spark, sf), keys=S, as_of=F.lit(_AS_OF).cast("timestamp_ntz"))
    return spans.withColumn("hours", F.round("hours", 6))


_CARRIED = "SELECT series_id, ts, " + ", ".join(f"{c} AS raw_{c}, last_value({c} IGNORE NULLS) OVER w AS {c}" for c in ("price", "load")) + (
    " FROM gap_grid WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
_SEASON = "CASE WHEN month(ts) <= 4 THEN 'dry' WHEN month(ts) <= 6 THEN 'wet' ELSE 'none' END"


def _impute_sql() -> str:
    from gridloom import dims

    kinds = dims.DAY_TYPES
    holiday = " OR ".join(f"(month(ts) = {m} AND day(ts) BETWEEN {a} AND {b})" for m, a, b in dims.HOLIDAYS)
    label = (f"SELECT *, {_SEASON} AS season, CASE WHEN {holiday} THEN '{kinds['holiday']}' WHEN isodow(ts) >= 6 THEN '{kinds['weekend']}' ELSE '{kinds['workday']}' END AS day_type, {PERIOD} AS p FROM carried")
    medians = "SELECT series_id, season, day_type, p, " + ", ".join(f"quantile_cont(raw_{c}, 0.5) AS m_{c}" for c in ("price", "load")) + " FROM labelled GROUP BY 1, 2, 3, 4"
    cols = ", ".join(f"coalesce(l.{c}, m.m_{c}) AS {c}, CAST(CASE WHEN raw_{c} IS NOT NULL THEN 0 WHEN l.{c} IS NOT NULL THEN 1 WHEN m_{c} IS NOT NULL THEN 2 ELSE 3 END AS INTEGER) AS {c}_level" for c in ("price", "load"))
    return ora(f"SELECT l.series_id, l.ts, {cols} FROM labelled l JOIN medians m USING (series_id, season, day_type, p)", "gap_grid", carried=_CARRIED, labelled=label, medians=medians)


@query("hier_impute", _impute_sql())
def hier_impute(spark, sf):
    return impute.hierarchical_fill(t.gap_grid(spark, sf).select("series_id", "ts", "price", "load"), ["price", "load"], series=S)


_SHADOWED = "SELECT series_id, CAST(ts AS DATE) AS day, avg(abs(price - l96)) AS active_mae, avg(abs(price - l192)) AS shadow_mae FROM lagged WHERE l96 IS NOT NULL AND l192 IS NOT NULL GROUP BY 1, 2"
_STREAK = ("SELECT *, sum(CASE WHEN better THEN 1 ELSE 0 END) OVER (PARTITION BY series_id, island ORDER BY day) AS streak FROM (SELECT *, sum(CASE WHEN better AND lag_day = day - INTERVAL 1 DAY THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY day) AS island "
           "FROM (SELECT *, shadow_mae < active_mae AND dayofmonth(day) % 10 <> 5 AS better, lag(day) OVER (PARTITION BY series_id ORDER BY day) AS lag_day FROM shadowed))")
_NEEDED = 2


def _streaks(spark, sf):
    g = lag_by(t.grid(spark, sf).select(*S, "ts", "price"), {"l96": ("price", 96), "l192": ("price", 192)}, series=S).where("l96 IS NOT NULL AND l192 IS NOT NULL")
    scored = g.select(*S, F.col("ts").alias("target_time"), F.col("price").alias("actual"), F.explode(F.create_map(F.lit("now"), F.col("l96"), F.lit("shadow"), F.col("l192"))).alias("model_version", "predicted"))
    scores = promotion.daily_scores(scored, keys=S)
    critical = scores.where(F.dayofmonth("day") % 10 == 5).select(*S, "day")
    return promotion.streaks(scores, keys=S, active="now", shadow="shadow", needed=_NEEDED, critical=critical)


@query("shadow_promotion", ora(
    f"SELECT series_id, day, round(active_mae, 4) AS active_mae, round(shadow_mae, 4) AS shadow_mae, better, CAST(streak AS BIGINT) AS streak, better AND streak = {_NEEDED} AS promoted FROM streaks",
    "lagged", shadowed=_SHADOWED, streaks=_STREAK))
def shadow_promotion(spark, sf):
    """A two-day lag as the shadow of a one-day lag; two days in a row suffice here. Every tenth day is a critical one."""
    return _streaks(spark, sf).withColumns({c: F.round(c, 4) for c in ("active_mae", "shadow_mae")})


@query("shadow_registry", ora(
    "SELECT r.series_id, r.version_name, CASE WHEN p.series_id IS NULL OR p.rolled_back_on IS NOT NULL THEN r.status WHEN r.status = 'active' THEN 'archived' ELSE 'active' END AS status, p.promoted_on, p.rolled_back_on "
    "FROM (SELECT s.series_id, v.* FROM (SELECT DISTINCT series_id FROM lagged) s, (VALUES ('now', 'active'), ('shadow', 'shadow')) v(version_name, status)) r LEFT JOIN "
    "(SELECT f.series_id, f.promoted_on, min(w.day) AS rolled_back_on FROM first_win f LEFT JOIN streaks w ON w.series_id = f.series_id AND w.day > f.promoted_on AND w.day <= f.promoted_on + INTERVAL 3 DAY AND w.shadow_mae > f.mae * 1.2 GROUP BY 1, 2) p "
    "ON p.series_id = r.series_id", "lagged", shadowed=_SHADOWED, streaks=_STREAK,
    first_win=f"SELECT series_id, min(day) AS promoted_on, arg_min(shadow_mae, day) AS mae FROM streaks WHERE better AND streak = {_NEEDED} GROUP BY 1"))
def shadow_registry(spark, sf):
    versions = F.explode(F.array(F.struct(F.lit("now").alias("version_name"), F.lit("active").alias("status")), F.struct(F.lit("shadow").alias("version_name"), F.lit("shadow").alias("status")))).alias("v")
    registry = t.grid(spark, sf).select(*S).distinct().select(*S, versions).select(*S, "v.*")
    promoted = promotion.promotions(_streaks(spark, sf), keys=S)
    changed = promotion.apply_promotions(registry, promoted, keys=S)
    return changed.join(promoted.select(*S, "promoted_on", "rolled_back_on"), S, "left")


_ROLLS = [Roll("price_ma_24h", "price", 96, "mean"), Roll("load_max_720", "load", 720, "max")]


def _local_features(grid):
    """Look-back 721 steps, look-ahead 96."""
    def shifts(w: ChunkWindows):
        return {"price_lag_96": w.lag("price", 96), "price_lag_672": w.lag("price", 672), "y_price": F.lead("price", 96).over(w.time)}

    return chunk_windows(grid, [*rolling_phases(_ROLLS), shifts], series=S, back=721, ahead=96)


@query("incremental_features", ora(
    "SELECT series_id, ts, price, load, CASE WHEN count(price) OVER d >= 48 THEN avg(price) OVER d END AS price_ma_24h, max(load) OVER m AS load_max_720, "
    "lag(price, 96) OVER s AS price_lag_96, lag(price, 672) OVER s AS price_lag_672, lead(price, 96) OVER s AS y_price FROM corrected WINDOW s AS (PARTITION BY series_id ORDER BY ts), "
    "d AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 96 PRECEDING AND 1 PRECEDING), m AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 720 PRECEDING AND 1 PRECEDING)", "grid",
    corrected="SELECT series_id, ts, price, CASE WHEN series_id = 1 AND CAST(ts AS DATE) = DATE '2024-01-09' THEN load + 100000 ELSE load END AS load FROM grid"))
def incremental_features(spark, sf):
    """The grid lands in three parts, a refresh after each, then one past day of one series is corrected."""
    path = work_path(spark, "incremental")
    grid = t.grid(spark, sf).select("series_id", "ts", "price", "load")
    cuts = ["2024-01-01", "2024-01-12", "2024-01-13", "2025-01-01"]
    refresh = lambda: incremental.refresh(spark, f"{path}/grid", f"{path}/features", f"{path}/ledger", _local_features, series=S, back=721, ahead=96)
    for lo, hi in zip(cuts, cuts[1:]):
        incremental.write_grid(grid.where((F.col("ts") >= F.lit(lo).cast("timestamp_ntz")) & (F.col("ts") < F.lit(hi).cast("timestamp_ntz"))), f"{path}/grid")
        refresh()
    wrong = (F.col("series_id") == 1) & (F.to_date("ts") == F.lit("2024-01-09").cast("date"))
    fixed = grid.where(F.date_format("ts", "yyyy-MM") == "2024-01").withColumns({"load": F.when(wrong, F.col("load") + 100000).otherwise(F.col("load")), "month": F.date_format("ts", "yyyy-MM")})
    incremental.overwrite_partitions(fixed, f"{path}/grid", ["month"])
    refresh()
    return spark.read.parquet(f"{path}/features").drop("day")


# -- late data over several micro-batches ------------------------------------------------------------------------------

_CUT1, _CUT2 = "2024-01-11", "2024-01-21"
#: Which file a row lands in: by its time, but every 50th row comes with the last file and every 50th with the next one.
_FILE = f"CASE WHEN event_id % 50 = 0 THEN 3 ELSE least(3, (CASE WHEN ts < TIMESTAMP '{_CUT1}' THEN 1 WHEN ts < TIMESTAMP '{_CUT2}' THEN 2 ELSE 3 END) + CASE WHEN event_id % 50 = 1 THEN 1 ELSE 0 END) END"
_LANDED = f"SELECT *, {_FILE} AS f FROM ev"


def _marks(late: str) -> str:
    """The watermark that each row is held against.

    A micro-batch takes that of the batch before it: nothing was seen before the
    second file's one yet, while the third file comes after the restart and meets
    what the first two have shown, less the allowed lateness.
    """
    return f"SELECT *, CASE f WHEN 3 THEN (SELECT date_trunc('millisecond', max(ts)) FROM landed WHERE f < 3) - INTERVAL {late} ELSE TIMESTAMP '1970-01-01' END AS wm FROM landed"


def _land(spark, sf, path, which, more=None):
    cut = lambda c: F.lit(c).cast("timestamp_ntz")
    own = F.when(F.col("ts") < cut(_CUT1), 1).when(F.col("ts") < cut(_CUT2), 2).otherwise(3)
    e = t.table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    number = F.when(F.col("event_id") % 50 == 0, 3).otherwise(F.least(F.lit(3), own + (F.col("event_id") % 50 == 1).cast("int")))
    for k in which:
        part = e.where(number == k)
        (part.unionByName(more(e)) if more and k == 3 else part).coalesce(1).write.mode("append").parquet(f"{path}/landed")
    return e.schema


def _in_three(spark, sf, path, start, more=None):
    """Files one by one; the stream is stopped after two of them and started again from its checkpoint."""
    schema = _land(spark, sf, path, (1, 2))
    run = lambda: start(ingest.read_landing(spark, f"{path}/landed", schema, files_per_batch=1)).awaitTermination()
    run()
    _land(spark, sf, path, (3,), more)
    run()


_BIN = "time_bucket(INTERVAL 15 MINUTE, ts)"


@query("stream_late_bins", ora(
    f"SELECT CAST(user_id % 4 AS INTEGER) AS series_id, {_BIN} AS ts, count(*) AS n, sum(cents) AS cents FROM marked WHERE {_BIN} + INTERVAL 15 MINUTE > wm GROUP BY 1, 2", "ev", landed=_LANDED, marked=_marks("1 DAY")))
def stream_late_bins(spark, sf):
    path = work_path(spark, "late")

    def start(landed):
        keyed = landed.withColumn("series_id", (F.col("user_id") % 4).cast("int"))
        return ingest.start_changelog(ingest.bins(keyed, {"n": F.count("*"), "cents": F.sum(F.round(F.col("value") * 100))}, keys=S), f"{path}/data", f"{path}/state")

    _in_three(spark, sf, path, start)
    ingest.compact_changelog(spark, f"{path}/data", ["series_id", "ts"])
    return ingest.read_changelog(spark, f"{path}/data", ["series_id", "ts"])


@query("stream_late_dedup", ora("SELECT event_id, ts, event_type FROM marked WHERE ts > wm", "ev", landed=_LANDED, marked=_marks("1 DAY")))
def stream_late_dedup(spark, sf):
    """The last file brings a part of the newest rows a second time."""
    path = work_path(spark, "late")
    again = lambda e: e.where((F.col("ts") >= F.lit("2024-01-25").cast("timestamp_ntz")) & (F.col("event_id") % 50 > 1))
    _in_three(spark, sf, path, lambda landed: ingest.start_append(ingest.deduplicated(landed, ["event_id"]), f"{path}/data", f"{path}/state"), again)
    return spark.read.parquet(f"{path}/data").select("event_id", "ts", "event_type")


@query("stream_late_completeness", ora(
    f"SELECT CAST(user_id % 4 AS INTEGER) AS series_id, {DAY} AS day, count(DISTINCT {PERIOD}) AS present, 96 - count(DISTINCT {PERIOD}) AS missing, round(count(DISTINCT {PERIOD}) / 96.0::DOUBLE * 100, 2) AS completeness_pct "
    f"FROM marked WHERE CAST({DAY} AS TIMESTAMP) + INTERVAL 1 DAY > wm GROUP BY 1, 2", "ev", landed=_LANDED, marked=_marks("2 DAY")))
def stream_late_completeness(spark, sf):
    path = work_path(spark, "late")
    start = lambda landed: ingest.start_changelog(ingest.day_completeness(landed.withColumn("series_id", (F.col("user_id") % 4).cast("int")), keys=S), f"{path}/data", f"{path}/state")
    _in_three(spark, sf, path, start)
    return ingest.read_changelog(spark, f"{path}/data", ["series_id", "day"])


@query("stream_versions", "SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN -value WHEN event_id % 3 = 1 THEN value * 2 ELSE value END AS value, CASE WHEN event_id % 3 = 0 THEN 2 WHEN event_id % 3 = 1 THEN 1 ELSE 0 END AS version FROM events")
def stream_versions(spark, sf):
    """First the newest version of every third row, then the older ones of all, then a middle one of others: an old version that arrives last loses."""
    path = work_path(spark, "versions")
    e = t.table(spark, sf, "events").select("event_id", "ts", "value", F.date_format("ts", "yyyy-MM").alias("month"))
    first = e.where(F.col("event_id") % 3 == 0).withColumns({"value": -F.col("value"), "version": F.lit(2)})
    middle = e.where(F.col("event_id") % 3 < 2).withColumns({"value": F.col("value") * 2, "version": F.lit(1)})
    for part in (first, e.withColumn("version", F.lit(0)), middle):
        part.coalesce(1).write.mode("append").parquet(f"{path}/landed")
        landed = ingest.read_landing(spark, f"{path}/landed", first.schema, files_per_batch=1)
        ingest.start_upsert(landed, f"{path}/data", f"{path}/state", keys=["event_id", "month"], partition_by=["month"], order=F.col("version"), versioned=True).awaitTermination()
    return spark.read.parquet(f"{path}/data").select("event_id", "ts", "value", "version")


@query("stream_sessions", ora("SELECT * FROM sessions", "ev", arrived=_ARRIVED, sessions=_SESSION))
def stream_sessions(spark, sf):
    """Sessions over three files in order; a last row far ahead moves the watermark past all of them and is left out."""
    path = work_path(spark, "sessions")
    rows = _arrivals(spark, sf)
    cut = lambda c: F.lit(c).cast("timestamp_ntz")
    end = rows.agg(F.max("fetch_time").alias("fetch_time")).select(F.lit(-1).alias("series_id"), (F.col("fetch_time") + F.expr("INTERVAL 30 DAYS")).alias("fetch_time"))
    parts = [rows.where(F.col("fetch_time") < cut(_CUT1)), rows.where((F.col("fetch_time") >= cut(_CUT1)) & (F.col("fetch_time") < cut(_CUT2))), rows.where(F.col("fetch_time") >= cut(_CUT2)), end]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{path}/landed")
        landed = ingest.read_landing(spark, f"{path}/landed", rows.schema, files_per_batch=1)
        found = ingest.arrival_sessions(landed, keys=S, gap="6 hours")
        ingest.start_append(found, f"{path}/data", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/data").where("series_id >= 0")
