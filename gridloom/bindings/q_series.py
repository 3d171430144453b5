"""Regularising, filling, shifting and rolling."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import dims
from gridloom.bindings import tables as t
from gridloom.bindings.ctes import W, ora
from gridloom.bindings.registry import query
from gridloom.functions.timegrid import HOUR, shift_minutes
from gridloom.operators import daily, regular, rolling, shift
from gridloom.operators.rolling import Roll
from gridloom.operators.spatial import unpack_map
from gridloom.sources.tables import scan_range

S = t.SERIES
CH = dims.CHANNELS


@query("scan_range", "SELECT event_id, ts, user_id, event_type, value FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-17 00:00:00'")
def scan_range_(spark, sf):
    e = t.table(spark, sf, "events")
    return scan_range(e, "2024-01-10 00:00:00", "2024-01-17 00:00:00").select("event_id", "ts", "user_id", "event_type", "value")


@query("bin_15m", ora("SELECT * FROM raw_grid", "raw_grid"))
def bin_15m(spark, sf):
    return t.raw_grid(spark, sf)


@query("regularize", ora("SELECT * FROM gap_grid", "gap_grid"))
def regularize(spark, sf):
    return t.gap_grid(spark, sf)


@query("ffill", ora("SELECT * FROM grid", "grid"))
def ffill(spark, sf):
    return regular.ffill(t.gap_grid(spark, sf), CH, series=S)


@query("densify", ora("SELECT * FROM grid", "grid"))
def densify(spark, sf):
    return t.grid(spark, sf)


@query("ffill_limit", ora(
    "SELECT series_id, ts, " + ", ".join(f"last_value({c} IGNORE NULLS) OVER w{k} AS {c}" for c, k in (("price", 3), ("load", 3), ("solar", 4)))
    + " FROM gap_grid WINDOW w3 AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), "
      "w4 AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)", "gap_grid"))
def ffill_limit(spark, sf):
    g = t.gap_grid(spark, sf).select("series_id", "ts", "price", "load", "solar")
    return regular.ffill(regular.ffill(g, ["price", "load"], series=S, limit=3), ["solar"], series=S, limit=4)


_KEYS = ["temp_cd_center", "precip_ya_main", "rad_ls_main"]
_WIDE = ", ".join(f"max(CASE WHEN key = '{k}' THEN value END) AS {k}" for k in _KEYS)


@query("upsample_hourly", ora(
    "SELECT g.series_id, g.ts, " + ", ".join(f"(SELECT 1) * f.{k} AS {k}" for k in _KEYS) + " FROM gap_grid g LEFT JOIN f ON f.ts = g.ts", "gap_grid", "wx_long",
    wide=f"SELECT ts, {_WIDE} FROM wx_long GROUP BY ts",
    fine="SELECT u.ts, w.* EXCLUDE (ts) FROM (SELECT unnest(generate_series((SELECT min(ts) FROM wide), (SELECT max(ts) + INTERVAL 45 MINUTE FROM wide), INTERVAL 15 MINUTE)) AS ts) u LEFT JOIN wide w ON w.ts = u.ts",
    f="SELECT ts, " + ", ".join(f"last_value({k} IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {k}" for k in _KEYS) + " FROM fine"))
def upsample_hourly(spark, sf):
    """Weather keys on the quarter-hour grid; no limit, as the unlimited fill follows the limited one."""
    g = t.gap_grid(spark, sf).select("series_id", "ts")
    return regular.upsample(g, unpack_map(t.weather_obs(spark, sf), keys=_KEYS), _KEYS)


@query("grid_weather_join", ora(
    "SELECT g.series_id, g.ts, g.price, " + ", ".join(f"w.{k}" for k in _KEYS) + " FROM raw_grid g LEFT JOIN wide w ON w.ts = g.ts", "raw_grid", "wx_long",
    wide=f"SELECT ts, {_WIDE} FROM wx_long GROUP BY ts"))
def grid_weather_join(spark, sf):
    g = t.raw_grid(spark, sf).select("series_id", "ts", "price")
    return g.join(unpack_map(t.weather_obs(spark, sf), keys=_KEYS), "ts", "left").select("series_id", "ts", "price", *_KEYS)


@query("forward_extend", ora(
    "SELECT series_id, ts, price, load, month(ts) BETWEEN 1 AND 4 AS dry, CAST(json_extract(w.variables, '$.temp_cd_center') AS DOUBLE) AS temp FROM "
    "(SELECT series_id, ts, price, load FROM gap_grid UNION ALL SELECT series_id, unnest(generate_series(max(ts) + INTERVAL 15 MINUTE, max(ts) + INTERVAL 2880 MINUTE, INTERVAL 15 MINUTE)), NULL, NULL "
    "FROM gap_grid GROUP BY series_id) g LEFT JOIN (SELECT ts AS hour, variables FROM weather) w ON w.hour = date_trunc('hour', g.ts)", "gap_grid", "weather"))
def forward_extend(spark, sf):
    g = regular.forward_extend(t.gap_grid(spark, sf).select("series_id", "ts", "price", "load"), 192, series=S)
    w = unpack_map(t.weather(spark, sf), keys=["temp_cd_center"]).select(F.col("ts").alias("_hour"), F.col("temp_cd_center").alias("temp"))
    joined = g.withColumn("_hour", regular.step_time(regular.step_index(F.col("ts"), HOUR), HOUR)).join(w, "_hour", "left")
    return joined.select("series_id", "ts", "price", "load", F.month("ts").between(1, 4).alias("dry"), "temp")


@query("obs_over_forecast", ora(
    "SELECT w.ts, CASE WHEN o.ts IS NOT NULL THEN 'obs' ELSE 'forecast' END AS source, w.variables FROM weather w LEFT JOIN wx_obs o ON o.ts = w.ts", "weather", "wx_obs"))
def obs_over_forecast(spark, sf):
    return regular.obs_over_forecast(t.weather_obs(spark, sf), t.forecast_runs(spark, sf), as_of=F.lit(t.FAR_FUTURE).cast("timestamp_ntz"))


@query("forecast_asof", ora(
    "SELECT target_time, fetch_time, variables FROM (SELECT *, row_number() OVER (PARTITION BY target_time ORDER BY fetch_time DESC) AS rn FROM runs "
    "WHERE fetch_time <= TIMESTAMP '2024-01-20 12:00:00') WHERE rn = 1", "runs"))
def forecast_asof(spark, sf):
    return regular.latest_run(t.forecast_runs(spark, sf), as_of=F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"), key=["target_time"])


LAGS = {f"{c}_lag_{k}": (c, k) for c, k in (
    ("price", 1), ("wind", 4), ("price", 96), ("solar", 192), ("wind", 193), ("load", 196), ("load", 200), ("hydro", 288), ("price", 672))}


@query("lags", ora(
    "SELECT series_id, ts, " + ", ".join(f"lag({c}, {k}) OVER w AS {n}" for n, (c, k) in LAGS.items())
    + ", lag(wind, 192) OVER w - lag(wind, 196) OVER w AS wind_ramp_1h, lag(wind, 192) OVER w - lag(wind, 200) OVER w AS wind_ramp_2h "
      f"FROM grid WINDOW w AS {W}", "grid"))
def lags(spark, sf):
    g = t.grid(spark, sf).select("series_id", "ts", "price", "solar", "wind", "hydro", "load")
    ramp = {"_w192": ("wind", 192), "_w196": ("wind", 196), "_w200": ("wind", 200)}
    names = {**LAGS, **{n[1:]: v for n, v in ramp.items()}}
    out = shift.lag_by(g, names, series=S)
    return out.select("series_id", "ts", *LAGS, (F.col("w192") - F.col("w196")).alias("wind_ramp_1h"), (F.col("w192") - F.col("w200")).alias("wind_ramp_2h"))


@query("lag_join", ora(f"SELECT series_id, ts, price, lag(price, 96) OVER w AS p96, lag(price, 672) OVER w AS p672, lag(load, 4) OVER w AS l4 FROM gap_grid WINDOW w AS {W}", "gap_grid"))
def lag_join(spark, sf):
    g = t.raw_grid(spark, sf).select("series_id", "ts", "price", "load")
    spine = t.gap_grid(spark, sf).select("series_id", "ts", "price", "load")
    # the shifted side has gaps, an equi-join on the step does not mind
    out = shift.lag_by(spine, {"p96": ("price", 96), "p672": ("price", 672), "l4": ("load", 4)}, series=S, method="join")
    return out.select("series_id", "ts", "price", "p96", "p672", "l4")


@query("lead_join", ora(
    f"SELECT g.series_id, g.ts, lead(g.price, 96) OVER (PARTITION BY g.series_id ORDER BY g.ts) AS y_price, month(g.ts + INTERVAL 24 HOUR) AS month_pp, "
    "CAST(json_extract(w.variables, '$.temp_cd_center') AS DOUBLE) AS temp_pp FROM grid g LEFT JOIN weather w ON w.ts = date_trunc('hour', g.ts + INTERVAL 24 HOUR)", "grid", "weather"))
def lead_join(spark, sf):
    """Day-ahead values: the target from the grid, weather and calendar from the target time itself."""
    g = shift.lead_by(t.grid(spark, sf).select("series_id", "ts", "price"), {"y_price": ("price", 96)}, series=S)
    target = shift_minutes(F.col("ts"), 1440)
    w = unpack_map(t.weather(spark, sf), keys=["temp_cd_center"]).select(F.col("ts").alias("_hour"), F.col("temp_cd_center").alias("temp_pp"))
    joined = g.withColumn("_hour", regular.step_time(regular.step_index(target, HOUR), HOUR)).join(w, "_hour", "left")
    return joined.select("series_id", "ts", "y_price", F.month(target).alias("month_pp"), "temp_pp")


@query("diffs", ora(
    "SELECT series_id, ts, price - lag(price, 96) OVER w AS diff_1d, price - lag(price, 288) OVER w AS chg_3d, price - lag(price, 672) OVER w AS chg_7d, "
    "price - 2 * lag(price, 96) OVER w + lag(price, 192) OVER w AS accel, coalesce(solar - lag(solar, 1) OVER w, 0) AS ramp "
    f"FROM grid WINDOW w AS {W}", "grid"))
def diffs(spark, sf):
    g = t.grid(spark, sf).select("series_id", "ts", "price", "solar")
    return shift.diffs(g, {
        "diff_1d": shift.change("price", 96), "chg_3d": shift.change("price", 288), "chg_7d": shift.change("price", 672),
        "accel": shift.acceleration("price", 96), "ramp": shift.ramp("solar"),
    }, series=S, back=672).select("series_id", "ts", "diff_1d", "chg_3d", "chg_7d", "accel", "ramp")


def _frame(w: int, lag: int = 1) -> str:
    end = "CURRENT ROW" if lag == 0 else f"{lag} PRECEDING"
    return f"(PARTITION BY series_id ORDER BY ts ROWS BETWEEN {w + lag - 1} PRECEDING AND {end})"


ROLLS = [
    Roll("price_ma_24h", "price", 96, "mean"), Roll("price_ma_7d", "price", 672, "mean"), Roll("solar_ma_720", "solar", 720, "mean"),
    Roll("price_vol_24h", "price", 96, "std"), Roll("wind_turb", "wind", 4, "std", lag=0),
]


def _roll_sql(r: Roll) -> str:
    f = _frame(r.rows, r.lag)
    fn = {"mean": "avg", "std": "stddev_samp", "max": "max", "sum": "sum", "min": "min"}[r.fn]
    value = f"{fn}({r.column}) OVER {f}"
    if r.fn == "std":
        value = f"round({value}, 3)"
    value = f"CASE WHEN count({r.column}) OVER {f} >= {r.needed} THEN {value} END"
    return (f"coalesce({value}, {r.column})" if r.fill_first else value) + f" AS {r.name}"


@query("rolling_mean_std", ora("SELECT series_id, ts, " + ", ".join(_roll_sql(r) for r in ROLLS) + " FROM gap_grid", "gap_grid"))
def rolling_mean_std(spark, sf):
    g = t.gap_grid(spark, sf).select("series_id", "ts", "price", "solar", "wind")
    out = rolling.rolling(g, ROLLS, series=S)
    return out.select("series_id", "ts", *[(F.round(r.name, 3) if r.fn == "std" else F.col(r.name)).alias(r.name) for r in ROLLS])


PEAKS = [Roll("price_max_720", "price", 720, "max", fill_first=True), Roll("load_max_96", "load", 96, "max"), Roll("load_min_96", "load", 96, "min"),
         Roll("solar_sum_96", "solar", 96, "sum", lag=0)]


@query("rolling_max", ora("SELECT series_id, ts, " + ", ".join(_roll_sql(r) for r in PEAKS) + " FROM gap_grid", "gap_grid"))
def rolling_max(spark, sf):
    g = t.gap_grid(spark, sf).select("series_id", "ts", "price", "load", "solar")
    return rolling.rolling(g, PEAKS, series=S).select("series_id", "ts", *[r.name for r in PEAKS])


@query("hourly_rolling_sum", ora(
    "SELECT g.series_id, g.ts, h.rain_24h, h.rain_72h, h.rain_15d FROM gap_grid g LEFT JOIN h ON h.ts = date_trunc('hour', g.ts)", "gap_grid", "wx_long",
    rain="SELECT ts, CAST(sum(CASE WHEN key LIKE 'precip_%' THEN value END) AS DOUBLE) AS rain FROM wx_long GROUP BY ts",
    full_h="SELECT u.ts, r.rain FROM (SELECT unnest(generate_series((SELECT min(ts) FROM rain), (SELECT max(ts) FROM rain), INTERVAL 1 HOUR)) AS ts) u LEFT JOIN rain r ON r.ts = u.ts",
    h="SELECT ts, " + ", ".join(f"round(sum(rain) OVER (ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 6) AS {name}"
                               for name, n in (("rain_24h", 24), ("rain_72h", 72), ("rain_15d", 360))) + " FROM full_h"))
def hourly_rolling_sum(spark, sf):
    long = t.weather_long(spark, sf)
    rain = long.groupBy("ts").agg(F.sum(F.when(F.col("key").startswith("precip_"), F.col("value"))).alias("rain"))
    hourly = regular.regularize(rain, series=[], minutes=HOUR)
    g = t.gap_grid(spark, sf).select("series_id", "ts")
    out = rolling.hourly_rolling_sum(g, hourly, {"rain_24h": ("rain", 24), "rain_72h": ("rain", 72), "rain_15d": ("rain", 360)}, series=[])
    return out.select("series_id", "ts", *[F.round(c, 6).alias(c) for c in ("rain_24h", "rain_72h", "rain_15d")])


def _offset_sql(c: str) -> str:
    f = "(PARTITION BY series_id ORDER BY ts ROWS BETWEEN 200 PRECEDING AND 192 PRECEDING)"
    inner = "(PARTITION BY series_id ORDER BY ts ROWS BETWEEN 199 PRECEDING AND 192 PRECEDING)"
    full = lambda e: f"CASE WHEN count({c}) OVER {f} = 9 THEN {e} END"
    at = lambda k: f"lag({c}, {k}) OVER w"
    return ", ".join([
        full(f"avg({c}) OVER {f}") + f" AS {c}_mean", full(f"round(stddev_pop({c}) OVER {f}, 4)") + f" AS {c}_std", f"{at(192)} - {at(200)} AS {c}_trend",
        full(f"max({c}) OVER {f} - min({c}) OVER {f}") + f" AS {c}_range", full(f"max(step_{c}) OVER {inner}") + f" AS {c}_max_step",
        f"{at(192)} - 2 * {at(196)} + {at(200)} AS {c}_accel"])


@query("offset_window_stats", ora(
    "SELECT series_id, ts, " + ", ".join(_offset_sql(c) for c in ("wind", "load")) +
    f" FROM (SELECT series_id, ts, wind, load, abs(wind - lag(wind) OVER w) AS step_wind, abs(load - lag(load) OVER w) AS step_load FROM grid WINDOW w AS {W}) WINDOW w AS {W}", "grid"))
def offset_window_stats(spark, sf):
    g = t.grid(spark, sf).select("series_id", "ts", "wind", "load")
    out = rolling.offset_window_stats(g, ["wind", "load"], series=S)
    return out.drop("wind", "load").withColumns({c: F.round(c, 4) for c in ("wind_std", "load_std")})


_LAGGED = ["price", "load", "solar"]


@query("grid_lag", ora(
    "SELECT series_id, ts, " + ", ".join(f"lag({c}, 192) OVER w AS {c}, {c} AS {c}_orig" for c in _LAGGED) + f" FROM gap_grid WINDOW w AS {W}", "gap_grid"))
def grid_lag(spark, sf):
    g = t.gap_grid(spark, sf).select("series_id", "ts", *_LAGGED)
    return shift.grid_lag(g, _LAGGED, 192, series=S)


@query("last_day", ora("SELECT g.* FROM gap_grid g JOIN (SELECT series_id, max(ts) AS e FROM gap_grid GROUP BY 1) m ON m.series_id = g.series_id WHERE g.ts > m.e - INTERVAL 24 HOUR", "gap_grid"))
def last_day(spark, sf):
    return daily.last_day(t.gap_grid(spark, sf), series=S)
