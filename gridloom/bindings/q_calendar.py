"""Scalar expressions: calendar, seasons, segments, weather and market formulas."""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import functions as F

from gridloom import dims
from gridloom.bindings import tables as t
from gridloom.bindings.ctes import PERIOD, ora
from gridloom.bindings.feature_sql import steady
from gridloom.bindings.registry import query, steady_col
from gridloom.functions import calendar, derived
from gridloom.operators.spatial import unpack_map
from gridloom.plans import training
from gridloom.sources.tables import fill_constant
from gridloom.functions.timegrid import col

FESTIVAL_2024 = date(2024, 2, 10)
_flag = lambda cond: f"CASE WHEN {cond} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
TAU = repr(2 * math.pi)
SLOT_SQL = ", ".join(f"{_flag(f'p >= {lo} AND p < {hi}')} AS \"slot_{n}\"" for n, lo, hi in dims.SLOTS)


@query("calendar_features", ora(
    f"SELECT *, {steady(f'sin({TAU} * p / 96)', 8)} AS period_sin, {steady(f'cos({TAU} * p / 96)', 8)} AS period_cos, "
    f"{steady(f'sin({TAU} * month / 12)', 8)} AS month_sin, {steady(f'cos({TAU} * month / 12)', 8)} AS month_cos, "
    f"{_flag('month BETWEEN 1 AND 4')} AS is_dry_season, {_flag('month BETWEEN 5 AND 6')} AS is_flood, {_flag('month >= 7')} AS is_main_flood, "
    f"{_flag('dow >= 5')} AS is_weekend, {SLOT_SQL} FROM (SELECT series_id, ts, {PERIOD} AS p, hour(ts) AS hour, month(ts) AS month, "
    "isodow(ts) - 1 AS dow FROM raw_year)", "raw_year"))
def calendar_features(spark, sf):
    g = t.raw_year(spark, sf).select("series_id", "ts")
    ts = F.col("ts")
    base = g.withColumns({"p": calendar.period(ts), "hour": F.hour(ts), "month": F.month(ts), "dow": F.weekday(ts)})
    ps, pc = calendar.cyclic(F.col("p"), 96)
    ms, mc = calendar.cyclic(F.col("month"), 12)
    return base.withColumns({
        **{n: steady_col(e, 8) for n, e in (("period_sin", ps), ("period_cos", pc), ("month_sin", ms), ("month_cos", mc))},
        **calendar.season_flags(ts), "is_weekend": calendar.flag(calendar.is_weekend(ts)),
        **{f"slot_{n}": e for n, e in calendar.slot_flags(F.col("p")).items()},
    })


_HOLIDAY = " OR ".join(f"(month(ts) = {m} AND day(ts) BETWEEN {a} AND {b})" for m, a, b in dims.HOLIDAYS)


@query("day_type", ora(
    f"SELECT series_id, CAST(ts AS DATE) AS day, CASE WHEN {_HOLIDAY} THEN '节假日' WHEN isodow(ts) >= 6 THEN '周末' ELSE '工作日' END AS day_type, "
    "count(*) AS n_rows FROM raw_year GROUP BY ALL", "raw_year"))
def day_type(spark, sf):
    g = t.raw_year(spark, sf)
    return g.groupBy("series_id", F.to_date("ts").alias("day"), calendar.day_type(F.col("ts")).alias("day_type")).agg(F.count("*").alias("n_rows"))


@query("season_route", ora(
    "SELECT series_id, month(ts) AS month, CASE WHEN month(ts) BETWEEN 1 AND 4 THEN 'dry' WHEN month(ts) BETWEEN 5 AND 6 THEN 'wet' END AS trained, "
    "CASE WHEN month(ts) BETWEEN 1 AND 4 THEN 'dry' WHEN month(ts) BETWEEN 5 AND 9 THEN 'wet' END AS served, count(*) AS n_rows "
    "FROM raw_year GROUP BY ALL", "raw_year"))
def season_route(spark, sf):
    ts = F.col("ts")
    return t.raw_year(spark, sf).groupBy(
        "series_id", F.month(ts).alias("month"), calendar.season(ts).alias("trained"), calendar.serving_season(ts).alias("served"),
    ).agg(F.count("*").alias("n_rows"))


_SEG = "CASE WHEN p <= 35 OR p >= 88 THEN 'base' WHEN p <= 67 THEN 'valley' ELSE 'peak' END"


@query("segment_of", ora(
    f"SELECT series_id, p AS period, {_SEG} AS segment, lpad(CAST(p // 4 AS VARCHAR), 2, '0') || ':' || lpad(CAST(p % 4 * 15 AS VARCHAR), 2, '0') AS time, "
    f"count(price) AS n_prices, CAST(sum(price) AS DOUBLE) AS total FROM (SELECT *, {PERIOD} AS p FROM gap_grid) GROUP BY ALL", "gap_grid"))
def segment_of(spark, sf):
    p = calendar.period(F.col("ts"))
    return t.gap_grid(spark, sf).groupBy(
        "series_id", p.alias("period"), calendar.segment_of(p).alias("segment"), calendar.period_to_time(p).alias("time"),
    ).agg(F.count("price").alias("n_prices"), F.sum("price").alias("total"))


@query("segment_masks", ora(
    f"SELECT series_id, ts, p BETWEEN 32 AND 71 AS valley_train, p BETWEEN 36 AND 67 AS valley_infer, p BETWEEN 64 AND 91 AS peak_train, "
    f"p BETWEEN 68 AND 87 AS peak_infer, (p <= 31 OR p >= 92) AS base_train, (p <= 35 OR p >= 88) AS base_infer "
    f"FROM (SELECT series_id, ts, {PERIOD} AS p FROM raw_grid)", "raw_grid"))
def segment_masks(spark, sf):
    return t.raw_grid(spark, sf).select("series_id", "ts", *[
        e.alias(n) for n, e in calendar.segment_masks(calendar.period(F.col("ts"))).items()])


@query("blend_weights", ora(
    "SELECT series_id, ts, p AS period, wv AS w_valley, wp AS w_peak, 1.0 - wv - wp AS w_base FROM (SELECT series_id, ts, p, "
    "CAST(CASE WHEN p < 32 THEN 0 WHEN p < 36 THEN (p - 32) / 4.0 WHEN p < 64 THEN 1 WHEN p < 68 THEN 1 - (p - 64) / 4.0 ELSE 0 END AS DOUBLE) AS wv, "
    "CAST(CASE WHEN p < 64 THEN 0 WHEN p < 68 THEN (p - 64) / 4.0 WHEN p < 84 THEN 1 WHEN p < 88 THEN 1 - (p - 84) / 4.0 ELSE 0 END AS DOUBLE) AS wp "
    f"FROM (SELECT series_id, ts, {PERIOD} AS p FROM raw_grid))", "raw_grid"))
def blend_weights(spark, sf):
    p = calendar.period(F.col("ts"))
    return t.raw_grid(spark, sf).select("series_id", "ts", p.alias("period"), *[e.alias(n) for n, e in calendar.blend_weights(p).items()])


_WX = ["temp_cd_center", "rh_cd_center", "rad_ls_main", "cloud_ls_main", "wind_ls_main", "precip_ya_main"]
_PICK = ", ".join(f"max(CASE WHEN key = '{k}' THEN value END) AS {k}" for k in _WX)


@query("weather_derived", ora(
    "SELECT ts, CASE WHEN t IS NOT NULL THEN round(greatest(t - 18, 0), 6) END AS cdd, CASE WHEN t IS NOT NULL THEN round(greatest(18 - t, 0), 6) END AS hdd, "
    "round(1.07::DOUBLE * t + 0.2::DOUBLE * rh - 2.7::DOUBLE, 6) AS apparent, round(w * w * w, 6) AS wind_cubic, "
    f"CASE WHEN cl IS NOT NULL THEN round(rad * greatest(1 - cl / 100, 0), 6) END AS rad_eff, {_flag('rad > 10')} AS is_daytime, {_flag('w > 3 AND w < 25')} AS is_generating, "
    "round(pr * pr, 6) AS rain_sq, round(sqrt(pr + 0.01::DOUBLE), 6) AS rain_sqrt FROM (SELECT ts, temp_cd_center AS t, rh_cd_center AS rh, rad_ls_main AS rad, "
    f"cloud_ls_main AS cl, wind_ls_main AS w, precip_ya_main AS pr FROM (SELECT ts, {_PICK} FROM wx_long GROUP BY ts))", "wx_long"))
def weather_derived(spark, sf):
    w = unpack_map(t.weather_obs(spark, sf), keys=_WX)
    r = lambda e: F.round(e, 6)
    temp, rh, rad, cloud, wind, rain = (F.col(k) for k in _WX)
    return w.select(
        "ts", r(derived.cooling_degrees(temp)).alias("cdd"), r(derived.heating_degrees(temp)).alias("hdd"),
        r(derived.apparent_temperature(temp, rh)).alias("apparent"), r(derived.cubic(wind)).alias("wind_cubic"),
        r(derived.effective_radiation(rad, cloud)).alias("rad_eff"), derived.is_daytime(rad).alias("is_daytime"),
        derived.is_generating(wind).alias("is_generating"), r(derived.rain_squared(rain)).alias("rain_sq"), r(derived.rain_root(rain)).alias("rain_sqrt"))


@query("supply_demand", ora(
    "SELECT series_id, ts, load - solar - wind - hydro AS net_load, round(solar + wind + hydro * 0.3::DOUBLE - load + 6000, 4) AS surplus, "
    "solar + wind + hydro AS renew_total, round(coalesce(solar / (load + 1), 0), 9) AS solar_pen, round(coalesce(hydro / (load + 1), 0), 9) AS hydro_pen, "
    "round(coalesce(wind / (load + 1), 0), 9) AS wind_pen, round(coalesce((solar + wind + hydro) / (load + 1), 0), 9) AS penetration, "
    "round(coalesce(bidspace / (load + 1), 0), 9) AS bidspace_ratio, round(coalesce(nonmarket / (load + 1), 0), 9) AS nonmarket_ratio FROM grid", "grid"))
def supply_demand(spark, sf):
    g = t.grid(spark, sf)
    s, w, h, l = (F.col(c) for c in ("solar", "wind", "hydro", "load"))
    share = lambda x: F.round(F.coalesce(derived.share(x, l), F.lit(0.0)), 9)
    return g.select(
        "series_id", "ts", derived.net_load(l, s, w, h).alias("net_load"), F.round(derived.surplus(l, s, w, h), 4).alias("surplus"),
        derived.renewable(s, w, h).alias("renew_total"), share(s).alias("solar_pen"), share(h).alias("hydro_pen"), share(w).alias("wind_pen"),
        share(derived.renewable(s, w, h)).alias("penetration"), share(F.col("bidspace")).alias("bidspace_ratio"),
        share(F.col("nonmarket")).alias("nonmarket_ratio"))


@query("event_distance", ora(
    "SELECT series_id, day, d AS days_from, abs(d) <= 10 AS near, d = -1 AS day_before, d = 1 AS day_after, n_rows FROM (SELECT series_id, CAST(ts AS DATE) AS day, "
    "date_diff('day', DATE '2024-02-10', CAST(ts AS DATE)) AS d, count(*) AS n_rows FROM raw_year GROUP BY ALL)", "raw_year"))
def event_distance(spark, sf):
    ts = F.col("ts")
    days = t.raw_year(spark, sf).groupBy("series_id", F.to_date(ts).alias("day")).agg(F.count("*").alias("n_rows"))
    at = F.col("day")
    gone = calendar.days_from(at, FESTIVAL_2024)
    return days.select("series_id", "day", gone.alias("days_from"), calendar.near_event(at, FESTIVAL_2024).alias("near"),
                       (gone == -1).alias("day_before"), (gone == 1).alias("day_after"), "n_rows")


@query("fill_constant", ora(
    "SELECT series_id, ts, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in dims.CHANNELS) + " FROM gap_grid", "gap_grid"))
def fill_constant_(spark, sf):
    return fill_constant(t.gap_grid(spark, sf), dims.CHANNELS)


@query("stage2_inputs", ora(
    f"SELECT series_id, ts, {steady('s * c', 5)} AS int_solar_period, s * v AS int_solar_valley, l * k AS int_load_peak, s * l AS int_solar_load, "
    f"(s + w) * v AS int_renew_valley, {steady('l * c', 5)} AS int_load_period FROM (SELECT series_id, ts, solar AS s, wind AS w, load AS l, "
    f"cos({TAU} * {PERIOD} / 96) AS c, {_flag(f'{PERIOD} BETWEEN 36 AND 67')} AS v, {_flag(f'{PERIOD} BETWEEN 68 AND 87')} AS k FROM grid)", "grid"))
def stage2_inputs(spark, sf):
    """The six products, with the measured channels standing in for stage-1 outputs."""
    g = t.grid(spark, sf).select("series_id", "ts", calendar.period(F.col("ts")).alias("period"),
                                 *[F.col(c).alias(f"oof_{c}") for c in training.TARGETS])
    out = training.interactions(g)
    rounded = {"int_solar_period", "int_load_period"}
    return out.select("series_id", "ts", *[(steady_col(col(c), 5) if c in rounded else col(c)).alias(c) for c in training.INTERACTIONS])
