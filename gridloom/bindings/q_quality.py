"""Quality checks and serving queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import dims
from gridloom.bindings import tables as t
from gridloom.bindings.ctes import DAY, PERIOD, W, ora, period_of
from gridloom.bindings.registry import query
from gridloom.plans import quality, serving

S = t.SERIES
# limits that fit the sample values (whole cents), so that every rule fires somewhere
RANGES = {"price": (100.0, 6000.0), "load": (200.0, 8000.0), "solar": (0.0, 5000.0), "wind": (0.0, 10000.0), "tieline": (-90.0, 0.0)}
LIMITS = {"price": 2000.0, "load": 3000.0, "solar": 2500.0}
_RANGE_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{c}', {lo}::DOUBLE, {hi}::DOUBLE)" for c, (lo, hi) in RANGES.items()) + ") v(channel, lo, hi)"
_LIMIT_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{c}', {x}::DOUBLE)" for c, x in LIMITS.items()) + ") v(channel, lim)"
_COMPLETE = f"SELECT series_id, {DAY} AS day, count(DISTINCT {PERIOD}) AS present, 96 - count(DISTINCT {PERIOD}) AS missing, round(count(DISTINCT {PERIOD}) / 96.0::DOUBLE * 100, 2) AS completeness_pct FROM raw_grid GROUP BY 1, 2"
_LONG = "SELECT series_id, ts, CAST(ts AS DATE) AS day, u.channel, u.value FROM raw_grid, LATERAL (VALUES " + ", ".join(f"('{c}', {c})" for c in {**RANGES, **LIMITS}) + ") u(channel, value)"
_RANGED = "SELECT l.series_id, l.day, l.channel, count(CASE WHEN value < lo OR value > hi THEN 1 END) AS outliers, round(min(value), 2) AS min_value, round(max(value), 2) AS max_value FROM long l JOIN lims r ON r.channel = l.channel GROUP BY 1, 2, 3"
_STEPS = (f"SELECT series_id, day, channel, abs(value - lag(value) OVER w) AS jump, lag({PERIOD}) OVER w AS p0 FROM long WHERE value IS NOT NULL AND channel IN ('price', 'load', 'solar') "
          "WINDOW w AS (PARTITION BY series_id, day, channel ORDER BY ts)")
_JUMPED = ("SELECT s.series_id, s.day, s.channel, count(CASE WHEN jump > lim THEN 1 END) AS jumps, round(max(CASE WHEN jump > lim THEN jump END), 1) AS max_jump, "
           "CAST(arg_min(CASE WHEN jump > lim THEN p0 END, CASE WHEN jump > lim THEN -jump * 1000 + p0 END) AS INTEGER) AS max_jump_from FROM steps s JOIN jl ON jl.channel = s.channel WHERE jump IS NOT NULL GROUP BY 1, 2, 3")
_HOURS = "SELECT DISTINCT ts FROM wx_long"
_RATE = "SELECT k.day, k.key, round((h.n - k.n) / CAST(h.n AS DOUBLE), 4) AS missing_rate FROM (SELECT CAST(ts AS DATE) AS day, key, count(value) AS n FROM wx_long GROUP BY 1, 2) k JOIN (SELECT CAST(ts AS DATE) AS day, count(DISTINCT ts) AS n FROM wx_long GROUP BY 1) h ON h.day = k.day"


@query("completeness", ora(_COMPLETE.replace('raw_grid', 'raw_fine'), "raw_fine"))
def completeness(spark, sf):
    return quality.completeness(t.raw_fine(spark, sf), series=S)


@query("missing_slots", ora(
    "SELECT series_id, day, count(*) AS n_missing, array_to_string(list(p ORDER BY p)[1:10], ',') AS missing_slots FROM (SELECT d.series_id, d.day, CAST(p.p AS INTEGER) AS p FROM (SELECT DISTINCT series_id, CAST(ts AS DATE) AS day FROM raw_fine) d, "
    f"range(96) p(p) WHERE NOT EXISTS (SELECT 1 FROM raw_fine g WHERE g.series_id = d.series_id AND CAST(g.ts AS DATE) = d.day AND {period_of('g.ts')} = p.p)) GROUP BY 1, 2", "raw_fine"))
def missing_slots(spark, sf):
    out = quality.missing_slots(t.raw_fine(spark, sf), series=S)
    text = F.array_join(F.col("missing_slots").cast("array<string>"), ",")
    return out.where("n_missing > 0").withColumn("missing_slots", text)


@query("absent_periods", ora(
    f"SELECT d.series_id, d.day, CAST(p.p AS INTEGER) AS period FROM (SELECT DISTINCT series_id, CAST(ts AS DATE) AS day FROM raw_fine) d, range(96) p(p) EXCEPT SELECT series_id, CAST(ts AS DATE), {PERIOD} FROM raw_fine", "raw_fine"))
def absent_periods(spark, sf):
    return quality.absent_periods(t.raw_fine(spark, sf), series=S)


@query("range_check", ora(_RANGED.replace("SELECT l", "SELECT l", 1), "raw_grid", long=_LONG, lims=_RANGE_SQL))
def range_check(spark, sf):
    return quality.range_check(t.raw_grid(spark, sf), series=S, ranges=RANGES)


@query("jump_check", ora(_JUMPED, "raw_grid", long=_LONG, steps=_STEPS, jl=_LIMIT_SQL))
def jump_check(spark, sf):
    return quality.jump_check(t.raw_grid(spark, sf), series=S, limits=LIMITS)


@query("key_missing_rate", ora(_RATE, "wx_long"))
def key_missing_rate(spark, sf):
    return quality.key_missing_rate(t.weather_obs(spark, sf))


@query("quality_status", ora(
    "SELECT c.series_id, c.day, CASE WHEN c.completeness_pct < 40 THEN 'critical' WHEN r.pl > 3 THEN 'warning' WHEN j.pj > 5 THEN 'warning' WHEN w.core_missing > 0.5 THEN 'warning' WHEN c.completeness_pct < 95 THEN 'warning' ELSE 'ok' END AS status_40, "
    "CASE WHEN c.completeness_pct < 90 THEN 'critical' WHEN r.pl > 3 THEN 'warning' WHEN j.pj > 5 THEN 'warning' WHEN w.core_missing > 0.5 THEN 'warning' WHEN c.completeness_pct < 95 THEN 'warning' ELSE 'ok' END AS status, "
    "c.present, c.completeness_pct, r.anomaly_count, coalesce(j.pj, 0) AS price_jumps, w.core_missing, w.worst_key FROM comp c "
    "LEFT JOIN (SELECT series_id, day, CAST(sum(outliers) AS BIGINT) AS anomaly_count, max(CASE WHEN channel IN ('price', 'load') THEN outliers END) AS pl FROM ranged GROUP BY 1, 2) r ON r.series_id = c.series_id AND r.day = c.day "
    "LEFT JOIN (SELECT series_id, day, max(CASE WHEN channel = 'price' THEN jumps END) AS pj FROM jumped GROUP BY 1, 2) j ON j.series_id = c.series_id AND j.day = c.day "
    "LEFT JOIN (SELECT day, max(missing_rate) AS core_missing, max(CASE WHEN missing_rate = m THEN key END) AS worst_key FROM (SELECT *, max(missing_rate) OVER (PARTITION BY day) AS m FROM rate "
    "WHERE regexp_matches(key, '^(temp|rad|precip|cloud)_')) GROUP BY 1) w ON w.day = c.day",
    "raw_grid", "wx_long", comp=_COMPLETE, long=_LONG, lims=_RANGE_SQL, ranged=_RANGED, steps=_STEPS, jl=_LIMIT_SQL, jumped=_JUMPED, rate=_RATE))
def quality_status(spark, sf):
    """The sample's days are far from complete; a second status column with a lower bar shows the other rules."""
    rep = quality.quality_status(t.raw_grid(spark, sf), t.weather_obs(spark, sf), series=S, ranges=RANGES, limits=LIMITS)
    ranged = quality.range_check(t.raw_grid(spark, sf), series=S, ranges=RANGES).where(F.col("channel").isin("price", "load"))
    worst = ranged.groupBy("series_id", "day").agg(F.max("outliers").alias("_pl"))
    joined = rep.join(worst, ["series_id", "day"], "left")
    lifted = F.when(F.col("completeness_pct") >= 40, F.greatest("completeness_pct", F.lit(90.0))).otherwise(F.col("completeness_pct"))
    return joined.withColumn("status_40", quality.status_of(lifted, F.col("_pl"), F.col("price_jumps"), F.col("core_missing"))).drop("_pl")


@query("quality_log", ora(
    "SELECT series_id, day AS check_date, CASE WHEN completeness_pct < 90 THEN 'critical' WHEN completeness_pct < 95 THEN 'warning' ELSE 'ok' END AS status, completeness_pct, "
    "'{\"present\":' || present || ',\"price_jumps\":0}' AS details FROM comp", "raw_grid", comp=_COMPLETE))
def quality_log(spark, sf):
    """Append-only log of a run without range, jump or weather findings."""
    from gridloom.session import work_path
    from gridloom.sources.store import append_log

    wide = {c: (-1e12, 1e12) for c in RANGES}
    report = quality.quality_status(t.raw_grid(spark, sf), series=S, ranges=wide, limits={c: 1e12 for c in LIMITS})
    path = work_path(spark, "quality_log")
    append_log(quality.quality_log(report), path)
    return spark.read.parquet(path).drop("anomaly_count")


_V = [t.VERSION, t.GAP_VERSION]
PREFERRED = "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY series_id, target_time ORDER BY CASE WHEN model_version = 'v' THEN 0 ELSE 1 END) AS rn FROM predictions) WHERE rn = 1"
_FULL = "SELECT series_id, CAST(target_time AS DATE) AS day, count(DISTINCT target_time) AS n_times FROM predictions GROUP BY 1, 2 HAVING count(DISTINCT target_time) >= 96"


@query("prefer_version", ora(PREFERRED, "predictions"))
def prefer_version(spark, sf):
    return serving.prefer_version(t.predictions(spark, sf), _V, keys=["series_id", "target_time"])


@query("complete_days", ora(_FULL, "predictions"))
def complete_days(spark, sf):
    return serving.complete_days(t.predictions(spark, sf), _V, keys=S)


@query("latest_complete_day", ora("SELECT series_id, max(day) AS day FROM full_days GROUP BY 1", "predictions", full_days=_FULL))
def latest_complete_day(spark, sf):
    return serving.latest_complete_day(t.predictions(spark, sf), _V, keys=S)


_SEGQ = "CASE WHEN p <= 35 OR p >= 88 THEN 'base' WHEN p <= 67 THEN 'valley' ELSE 'peak' END"
CURVE = (f"SELECT series_id, CAST(target_time AS DATE) AS day, p AS period, strftime(target_time, '%H:%M') AS time, round_even(predicted_price, 1) AS price, {_SEGQ} AS segment, model_version "
          f"FROM (SELECT *, {period_of('target_time')} AS p FROM pref)")


@query("day_curve", ora("SELECT c.* FROM curve c JOIN full_days f ON f.series_id = c.series_id AND f.day = c.day", "predictions", pref=PREFERRED, full_days=_FULL, curve=CURVE))
def day_curve(spark, sf):
    """The curves of all complete days; a serving call passes the one latest day instead."""
    pred = t.predictions(spark, sf)
    return serving.day_curve(pred, serving.complete_days(pred, _V, keys=S), _V, keys=S)


@query("day_summary", ora(
    f"SELECT series_id, day, round_even(avg(price), 1) AS avg_price, max(price) AS peak_price, CAST(min(CASE WHEN price = hi THEN p END) AS INTEGER) AS peak_period, min(price) AS valley_price, "
    f"CAST(min(CASE WHEN price = lo THEN p END) AS INTEGER) AS valley_period FROM (SELECT series_id, {DAY} AS day, {PERIOD} AS p, price, max(price) OVER d AS hi, min(price) OVER d AS lo FROM grid "
    f"WINDOW d AS (PARTITION BY series_id, {DAY})) GROUP BY 1, 2", "grid"))
def day_summary(spark, sf):
    from gridloom.functions.calendar import period

    g = t.grid(spark, sf).select("series_id", F.to_date("ts").alias("day"), period(F.col("ts")).alias("period"), "price")
    return serving.day_summary(g, keys=S)


@query("history_compare", ora(
    f"SELECT s.series_id, CAST(s.ts AS DATE) AS day, {period_of('s.ts')} AS period, round_even(a.price, 1) AS actual, round_even(p.predicted_price, 1) AS predicted FROM "
    "(SELECT series_id, unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-02-03 23:45:00', INTERVAL 15 MINUTE)) AS ts FROM (SELECT DISTINCT series_id FROM raw_grid)) s "
    "LEFT JOIN raw_grid a ON a.series_id = s.series_id AND a.ts = s.ts LEFT JOIN pref p ON p.series_id = s.series_id AND p.target_time = s.ts", "raw_grid", "predictions", pref=PREFERRED))
def history_compare(spark, sf):
    return serving.history_compare(t.raw_grid(spark, sf), t.predictions(spark, sf), F.lit("2024-01-05").cast("date"), F.lit("2024-02-03").cast("date"), _V, keys=S)


@query("history_arrays", ora(
    f"SELECT series_id, day, string_agg(coalesce(CAST(actual AS VARCHAR), 'null'), ',' ORDER BY period) AS actual, string_agg(coalesce(CAST(predicted AS VARCHAR), 'null'), ',' ORDER BY period) AS predicted FROM (SELECT s.series_id, CAST(s.ts AS DATE) AS day, {period_of('s.ts')} AS period, round_even(a.price, 1) AS actual, round_even(p.predicted_price, 1) AS predicted FROM "
    "(SELECT series_id, unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-02-03 23:45:00', INTERVAL 15 MINUTE)) AS ts FROM (SELECT DISTINCT series_id FROM raw_grid)) s "
    "LEFT JOIN raw_grid a ON a.series_id = s.series_id AND a.ts = s.ts LEFT JOIN pref p ON p.series_id = s.series_id AND p.target_time = s.ts) GROUP BY 1, 2", "raw_grid", "predictions", pref=PREFERRED))
def history_arrays(spark, sf):
    out = serving.history_arrays(history_compare(spark, sf), keys=S)
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",", "null") for c in ("actual", "predicted")})
