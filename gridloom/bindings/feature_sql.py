"""The feature frame and the export table as SQL, for comparison only.

Written with direct window frames and per-row formulas, no chunks, no running
totals, so that it shares nothing with the plan it checks.
"""

from __future__ import annotations

import math

from gridloom import dims
from gridloom.bindings.ctes import PERIOD, ora

TAU = repr(2 * math.pi)
KEYS = dims.weather_keys()
PAIRS = [(v, c) for v, s in dims.REGION_WEIGHTS.items() for c in s] + [("temp", "liangshan")]
FESTIVAL = "DATE '2024-01-12'"


def steady(x: str, digits: int) -> str:
    """Rounded with a small offset, so that exact halves are not on the edge."""
    return f"round({x} + {2.71 * 10 ** -(digits + 2)!r}::DOUBLE, {digits})"


def _mean(v: str, c: str) -> str:
    cols = [f"{v}_{n}" for n in dims.CLUSTERS[c]]
    total = "(0.0::DOUBLE + " + " + ".join(f"coalesce({x}, 0)" for x in cols) + ")"
    count = "(" + " + ".join(f"({x} IS NOT NULL)::INT" for x in cols) + ")"
    return f"{total} / nullif({count}, 0)::DOUBLE"


def _fused(v: str) -> str:
    return " + ".join(f"{v}_{c} * {w}::DOUBLE" for c, w in dims.REGION_WEIGHTS[v].items())


def _hourly(src: str) -> dict[str, str]:
    wide = ", ".join(f"CAST(json_extract(variables, '$.{k}') AS DOUBLE) AS {k}" for k in KEYS)
    fill = ", ".join(f"last_value({k} IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {k}" for k in KEYS)
    return {
        "wx_wide": f"SELECT ts, {wide} FROM {src}",
        "wx_full": "SELECT u.ts, w.* EXCLUDE (ts) FROM (SELECT unnest(generate_series((SELECT min(ts) FROM wx_wide), (SELECT max(ts) FROM wx_wide), INTERVAL 1 HOUR)) AS ts) u LEFT JOIN wx_wide w ON w.ts = u.ts",
        "wx_fill": f"SELECT ts, {fill} FROM wx_full",
    }


def _weather_views() -> dict[str, str]:
    rolls = {"rain_24h": 24, "rain_72h": 72, "rain_15d": 360}
    sums = ", ".join(f"sum(precip_avg) OVER (ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS {k}" for k, n in rolls.items())
    return {
        **_hourly("weather"),
        "wx_mean": "SELECT ts, " + ", ".join(f"{_mean(v, c)} AS {v}_{c}" for v, c in PAIRS) + " FROM wx_fill",
        "wx_fuse": "SELECT *, " + ", ".join(f"{_fused(v)} AS {v}_avg" for v in dims.REGION_WEIGHTS) + " FROM wx_mean",
        "wx_der": ("SELECT *, CASE WHEN temp_avg IS NOT NULL THEN greatest(temp_avg - 18, 0) END AS cdd_avg, "
                   "CASE WHEN cloud_avg IS NOT NULL THEN rad_avg * greatest(1 - cloud_avg / 100, 0) END AS rad_eff, "
                   "temp_avg * 1.07::DOUBLE + rh_avg * 0.2::DOUBLE - 2.7::DOUBLE AS apparent_temp, wind_avg * wind_avg * wind_avg AS wind_cubic, "
                   "CASE WHEN rad_avg > 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_daytime, precip_avg * precip_avg AS precip_sq, sqrt(precip_avg + 0.01::DOUBLE) AS precip_sqrt, "
                   f"{sums}, cloud_liangshan - lag(cloud_liangshan, 24) OVER (ORDER BY ts) AS cloud_chg_24h, temp_liangshan - lag(temp_liangshan, 24) OVER (ORDER BY ts) AS temp_chg_24h, "
                   "max(temp_chengdu) OVER (PARTITION BY CAST(ts AS DATE)) - min(temp_chengdu) OVER (PARTITION BY CAST(ts AS DATE)) AS temp_diurnal_range FROM wx_fuse"),
    }


CORE = ["solar", "wind", "hydro", "load", "price", "bidspace", "nonmarket"]
AHEAD = ["temp_avg", "rad_avg", "rad_eff", "cloud_avg", "precip_avg", "cdd_avg", "apparent_temp", "wind_cubic", "wind_avg", "is_daytime",
         "precip_yaan", "precip_panzhihua", "precip_liangshan", "precip_sq", "precip_sqrt", "rain_24h", "rain_72h"]
NOW = ["temp_avg", "rad_avg", "cloud_avg", "wind_avg", "apparent_temp", "wind_cubic", "is_daytime", "rain_72h", "rain_15d", "cloud_chg_24h",
       "temp_chg_24h", "temp_diurnal_range", "temp_chengdu"]


def _lag(c: str, k: int) -> str:
    return f"lag({c}, {k}) OVER w"


def _roll(fn: str, c: str, rows: int) -> str:
    f = f"OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({c}) {f} >= {rows // 2} THEN {fn}({c}) {f} END"


def _peak(c: str) -> str:
    return f"coalesce(max({c}) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 720 PRECEDING AND 1 PRECEDING), {c})"


def _part(fn: str, c: str, cond: str, n: int) -> str:
    d = "OVER (PARTITION BY series_id, CAST(ts AS DATE))"
    return f"CASE WHEN count(CASE WHEN {cond} THEN {c} END) {d} = {n} THEN {fn}(CASE WHEN {cond} THEN {c} END) {d} END"


def _slot(c: str, p: int) -> str:
    return f"max(CASE WHEN p = {p} THEN {c} END) OVER (PARTITION BY series_id, CAST(ts AS DATE))"


def _day_cols() -> dict[str, str]:
    out = {}
    for c in ("solar", "hydro", "wind", "load"):
        out[f"m_mean_{c}"] = _part("avg", c, "p <= 34", 35)
        out[f"m_last_{c}"] = _slot(c, 34)
        out[f"m_ramp_{c}"] = f"{_slot(c, 34)} - {_slot(c, 24)}"
        out[f"m_std_{c}"] = _part("stddev_pop", c, "p <= 34", 35)
        hi = lambda a, b: _part("max", c, f"p BETWEEN {a} AND {b}", b - a + 1)
        out[f"c_peak_{c}"] = _part("max", c, "p >= 0", 96)
        out[f"c_low_{c}"] = _part("min", c, "p >= 0", 96)
        out[f"c_mean_{c}"] = _part("avg", c, "p >= 0", 96)
        out[f"c_std_{c}"] = _part("stddev_pop", c, "p >= 0", 96)
        out[f"c_total_{c}"] = _part("sum", c, "p >= 0", 96)
        day = "OVER (PARTITION BY series_id, CAST(ts AS DATE))"
        out[f"c_dur_{c}"] = f"CASE WHEN count({c}) {day} = 96 THEN count(CASE WHEN {c} > 100 THEN 1 END) {day} END"
        out[f"c_night_{c}"] = _part("avg", c, "(p < 20 OR p >= 88)", 28)
        out[f"c_daytime_{c}"] = _part("avg", c, "p BETWEEN 28 AND 75", 48)
        out[f"c_up_{c}"] = f"{hi(28, 75)} - {_slot(c, 28)}"
        out[f"c_mor_{c}"], out[f"c_eve_{c}"] = hi(20, 35), hi(68, 87)
        out[f"c_val_{c}"] = _part("min", c, "p BETWEEN 40 AND 67", 28)
    return out


def _features() -> dict[str, tuple[str, int | None]]:
    """Name to (expression, digits to round to or None where both engines agree exactly)."""
    f: dict[str, tuple[str, int | None]] = {}

    def put(name: str, expr: str, digits: int | None = None) -> None:
        f[name] = (expr, digits)

    flag = lambda cond: f"CASE WHEN {cond} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    for k in (96, 192, 288, 672):
        put(f"A_price_lag_{k}", _lag("price", k))
    put("A_price_chg_3d", f"price - {_lag('price', 288)}")
    put("A_price_chg_7d", f"price - {_lag('price', 672)}")
    put("A_price_vol_24h", _roll("stddev_samp", "price", 96), 3)
    put("A_price_ma_24h", _roll("avg", "price", 96))
    put("A_price_ma_7d", _roll("avg", "price", 672))
    put("A_price_accel", f"price - 2 * {_lag('price', 96)} + {_lag('price', 192)}")
    put("A_price_diff_1d", f"price - {_lag('price', 96)}")
    put("A_price_max_30d", _peak("price"))
    for x in ("solar", "wind", "hydro", "load"):
        put(f"B_{x}[t]", x)
    for x, k in (("solar", 96), ("solar", 672), ("wind", 4), ("wind", 96), ("wind", 672), ("hydro", 96), ("hydro", 672), ("load", 96), ("load", 672)):
        put(f"B_{x}_lag_{k}", _lag(x, k))
    put("B_hydro_ma_7d", _roll("avg", "hydro", 672))
    put("C_net_load[t]", "net_load")
    put("C_surplus[t]", "surplus", 3)
    for n, x in (("solar_pen", "solar"), ("hydro_pen", "hydro"), ("wind_pen", "wind"), ("penetration", "renew")):
        put(f"C_{n}[t]", f"{x} / (load + 1)", 8)
    put("C_net_load_lag_96", _lag("net_load", 96))
    put("C_surplus_lag_96", _lag("surplus", 96), 3)
    put("C_surplus_scaled", "surplus / (load + 1)", 6)
    put("C_renew_total[t]", "renew")
    for n, x in (("temp_avg", "temp_avg"), ("rad_avg", "rad_avg"), ("rad_eff", "rad_eff"), ("cloud_avg", "cloud_avg"), ("rain_24h_avg", "rain_24h"),
                 ("rain_h_avg", "precip_avg"), ("cdd_avg", "cdd_avg"), ("apparent_temp", "apparent_temp"), ("wind_cubic", "wind_cubic")):
        put(f"D_{n}_pp", f"{x}_pp", 3)
    for x in ("temp_avg", "rad_avg", "cloud_avg", "apparent_temp", "wind_cubic"):
        put(f"D_{x}_now", x, 3)
    put("D_is_daytime", "is_daytime")
    put("D_is_daytime_pp", "is_daytime_pp")
    put("D_ghi_ramp_15min", "coalesce(rad_avg - lag(rad_avg, 1) OVER w, 0)", 4)
    put("D_is_generating_pp", flag("wind_avg_pp > 3 AND wind_avg_pp < 25"))
    put("D_wind_turbulence_1h", "CASE WHEN count(wind_avg) OVER w4 >= 2 THEN stddev_samp(wind_avg) OVER w4 END", 4)
    put("D_precip_15d_sum", "rain_15d", 4)
    for n, x in (("yaan", "yaan"), ("pzh", "panzhihua"), ("ls", "liangshan")):
        put(f"D_precip_{n}_pp", f"precip_{x}_pp", 4)
    put("D_precip_avg_sq_pp", "precip_sq_pp", 3)
    put("D_precip_avg_sqrt_pp", "precip_sqrt_pp", 4)
    put("E_bidspace[t]", "bidspace")
    put("E_bidspace_ratio", "bidspace / (load + 1)", 8)
    put("E_nonmarket[t]", "nonmarket")
    put("E_nonmarket_ratio", "nonmarket / (load + 1)", 8)
    tt = "(ts + INTERVAL 24 HOUR)"
    for n, fn, x, cyc in (("period_sin", "sin", "p", 96), ("period_cos", "cos", "p", 96), ("month_sin", "sin", f"month({tt})", 12), ("month_cos", "cos", f"month({tt})", 12)):
        put(f"F_{n}_pp", f"{fn}({TAU} * {x} / {cyc})", 8)
    hol = " OR ".join(f"(month({tt}) = {m} AND day({tt}) BETWEEN {a} AND {b})" for m, a, b in dims.HOLIDAYS)
    put("F_is_holiday_pp", flag(hol))
    put("F_is_weekend_pp", flag(f"isodow({tt}) >= 6"))
    put("F_is_dry_season_pp", flag(f"month({tt}) BETWEEN 1 AND 4"))
    put("F_is_flood_pp", flag(f"month({tt}) BETWEEN 5 AND 6"))
    for n, a, b in dims.SLOTS:
        put(f"F_slot_{n}_pp", flag(f"p >= {a} AND p < {b}"))
    for x, lo, hi in (("load", 0.1, 0.9), ("price", 0.05, 0.95), ("solar", 0.1, 0.9), ("wind", 0.1, 0.9)):
        put(f"G_extreme_{x}", f"CASE WHEN n_month > 100 AND {x} > quantile_cont({x}, {hi}) OVER m THEN 1.0::DOUBLE WHEN n_month > 100 AND {x} < quantile_cont({x}, {lo}) OVER m THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END")
    put("G_high_load_low_solar", flag("load > quantile_cont(load, 0.7) OVER s AND solar < quantile_cont(solar, 0.3) OVER s"))
    put("G_high_temp_low_wind", flag("temp_chengdu > 25 AND wind < quantile_cont(wind, 0.3) OVER s"))
    put("H_load_max_30d", _peak("load"))
    for x in ("solar", "wind", "hydro"):
        put(f"H_{x}_ma_30d", _roll("avg", x, 720))
    put("I_sim7d", _lag("price", 672))
    put("J_rad_pp_x_period_cos", f"rad_avg_pp * cos({TAU} * p / 96)", 4)
    put("J_rain72h_x_flood", f"rain_72h_pp * {flag(f'month({tt}) BETWEEN 5 AND 6')}", 4)
    put("J_cloud_chg_x_temp_chg", "cloud_chg_24h * temp_chg_24h", 3)
    put("J_rain24h_x_hydro", "rain_24h_pp * hydro", 1)
    put("J_precip_yaan_x_flood", f"precip_yaan_pp * {flag(f'month({tt}) BETWEEN 5 AND 6')}", 4)
    put("J_precip_15d_x_hydro", "rain_15d * hydro", 1)
    put("K_solar_lag_4", _lag("solar", 4))
    put("K_solar_lag_192", _lag("solar", 192))
    put("K_solar_ma_24h", _roll("avg", "solar", 96))
    put("K_solar_ma_7d", _roll("avg", "solar", 672))
    put("K_solar_diff_1d", f"solar - {_lag('solar', 96)}")
    put("K_hydro_lag_4", _lag("hydro", 4))
    put("K_hydro_ma_24h", _roll("avg", "hydro", 96))
    put("K_hydro_diff_1d", f"hydro - {_lag('hydro', 96)}")
    put("K_hydro_diff_7d", f"hydro - {_lag('hydro', 672)}")
    put("K_hydro_vol_24h", _roll("stddev_samp", "hydro", 96), 3)
    put("K_wind_ma_24h", _roll("avg", "wind", 96))
    put("K_wind_ma_7d", _roll("avg", "wind", 672))
    put("K_wind_vol_24h", _roll("stddev_samp", "wind", 96), 3)
    put("K_wind_diff_1d", f"wind - {_lag('wind', 96)}")
    put("K_cloud_chg_24h", "cloud_chg_24h", 4)
    put("K_temp_chg_24h", "temp_chg_24h", 4)
    put("K_temp_diurnal_range", "temp_diurnal_range", 4)
    put("K_rain_72h_acc[t]", "rain_72h", 4)
    put("K_rain_72h_acc_pp", "rain_72h_pp", 4)
    for op in ("mean", "last", "ramp", "std"):
        for x in ("solar", "hydro", "wind", "load"):
            put(f"L_morning_{op}_{x}", f"m_{op}_{x}", 3 if op == "std" else None)
    put("M_days_from_sf", f"date_diff('day', {FESTIVAL}, CAST(ts AS DATE))")
    put("M_is_sf_window", flag(f"abs(date_diff('day', {FESTIVAL}, CAST(ts AS DATE))) <= 10"))
    y = lambda e: f"lag({e}, 96) OVER w"
    for n, e, d in (("solar_peak", "c_peak_solar", None), ("solar_ramp_up", "c_up_solar", None), ("solar_day_std", "c_std_solar", 3), ("solar_duration", "c_dur_solar", None),
                    ("solar_day_mean", "c_mean_solar", None), ("solar_day_total", "c_total_solar", None), ("hydro_range", "c_peak_hydro - c_low_hydro", None),
                    ("hydro_day_mean", "c_mean_hydro", None), ("hydro_night_mean", "c_night_hydro", None), ("hydro_daytime_mean", "c_daytime_hydro", None),
                    ("wind_range", "c_peak_wind - c_low_wind", None), ("wind_day_mean", "c_mean_wind", None), ("wind_night_mean", "c_night_wind", None),
                    ("load_morning_peak", "c_mor_load", None), ("load_evening_peak", "c_eve_load", None), ("load_valley", "c_val_load", None),
                    ("load_peak_ratio", "CASE WHEN c_mor_load > 0 THEN c_eve_load / (c_mor_load + 1) WHEN c_eve_load IS NOT NULL AND c_mor_load IS NOT NULL THEN 0 END", 8),
                    ("load_day_mean", "c_mean_load", None)):
        put(f"N_d2_{n}", y(e), d)
    ramp = lambda x, k: f"{_lag(x, 192)} - {_lag(x, k)}"
    for x, ks, hours in (("wind", (192, 193, 196), (1, 2)), ("hydro", (192, 193, 196, 288), (1,)), ("load", (192, 193, 196, 200), (1, 2))):
        for k in ks:
            put(f"O_{x}_lag_{k}", _lag(x, k))
        for h in hours:
            put(f"O_{x}_d2_ramp_{h}h", ramp(x, 192 + 4 * h))
    for x in ("wind", "hydro", "load"):
        full = lambda e: f"CASE WHEN count({x}) OVER p9 = 9 THEN {e} END"
        put(f"P_{x}_d2_w2h_mean", full(f"avg({x}) OVER p9"))
        put(f"P_{x}_d2_w2h_std", full(f"stddev_pop({x}) OVER p9"), 3)
        put(f"P_{x}_d2_w2h_trend", ramp(x, 200))
        put(f"P_{x}_d2_w2h_range", full(f"max({x}) OVER p9 - min({x}) OVER p9"))
        put(f"P_{x}_d2_w2h_max_step", full(f"max(step_{x}) OVER p8"))
        put(f"P_{x}_d2_w2h_accel", f"{_lag(x, 192)} - 2 * {_lag(x, 196)} + {_lag(x, 200)}")
    return f


FEATURES = _features()
FEATURE_NAMES = list(FEATURES)
DIGITS = {n: d for n, (_, d) in FEATURES.items()}


def feature_views(lag_steps: int) -> dict[str, str]:
    """Common tables ending in `feats`; needs the views `grid` and `weather`."""
    w = "WINDOW w AS (PARTITION BY series_id ORDER BY ts)"
    shift = (lambda c: f"lag({c}, {lag_steps}) OVER w AS {c}") if lag_steps else (lambda c: c)
    frames = ("w AS (PARTITION BY series_id ORDER BY ts), w4 AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), "
              "p9 AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 200 PRECEDING AND 192 PRECEDING), p8 AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 199 PRECEDING AND 192 PRECEDING), "
              "m AS (PARTITION BY series_id, month(ts)), s AS (PARTITION BY series_id)")
    cols = ", ".join(
        f'coalesce({steady(e, d) if d is not None else f"CAST({e} AS DOUBLE)"}, {steady("0", d) if d is not None else "0"}) AS "{n}"' for n, (e, d) in FEATURES.items())
    return {
        **_weather_views(),
        "g0": f"SELECT series_id, ts, {', '.join(shift(c) for c in CORE)} FROM grid {w}",
        "g1": (f"SELECT *, {PERIOD} AS p, load - solar - wind - hydro AS net_load, solar + wind + hydro * 0.3::DOUBLE - load + 6000 AS surplus, solar + wind + hydro AS renew, "
               f"count(*) OVER (PARTITION BY series_id, month(ts)) AS n_month, " + ", ".join(f"abs({x} - lag({x}) OVER w) AS step_{x}" for x in ("wind", "hydro", "load")) + f" FROM g0 {w}"),
        "g2": "SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in _day_cols().items()) + " FROM g1",
        "g3": ("SELECT g.*, " + ", ".join(f"n.{c}" for c in NOW) + ", " + ", ".join(f"a.{c} AS {c}_pp" for c in AHEAD) +
               " FROM g2 g LEFT JOIN wx_der n ON n.ts = date_trunc('hour', g.ts) LEFT JOIN wx_der a ON a.ts = date_trunc('hour', g.ts) + INTERVAL 24 HOUR"),
        "feats": f"SELECT series_id, ts, {cols} FROM g3 WINDOW {frames}",
    }


def _base_table() -> str:
    label = lambda c, v: f"{dims.CLUSTER_LABELS[c]}_{dims.VARIABLE_LABELS[v]}"
    mean = lambda c, v: f"{_mean(v, c)}" + (" / 100" if v == "cloud" else "")
    clusters = ", ".join(f'{mean(c, v)} AS "{label(c, v)}"' for c in dims.CLUSTER_LABELS for v in dims.VARIABLES)
    rain = ", ".join("(" + " + ".join(f"coalesce({_mean('precip', c)}, 0)" for c in cs) + f') AS "r {b}"' for b, cs in dims.BASIN_CLUSTERS.items())
    temps = {r: label(c, "temp") for r, c in dims.TEMPERATURE_REGIONS.items()}
    derived = [f'sum("r {b}") OVER (ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS "{b}_24h降水(mm)"' for b in dims.BASIN_CLUSTERS]
    derived += [f'"{x}" - lag("{x}", 24) OVER (ORDER BY ts) AS "{r}_气温24h变(℃)"' for r, x in temps.items()]
    for r, x in temps.items():
        derived.append(f'CASE WHEN "{x}" IS NOT NULL THEN greatest(18 - "{x}", 0) END AS "{r}_HDD"')
        derived.append(f'CASE WHEN "{x}" IS NOT NULL THEN greatest("{x}" - 18, 0) END AS "{r}_CDD"')
    floats = [label(c, v) for c in dims.CLUSTER_LABELS for v in dims.VARIABLES] + [f"{b}_24h降水(mm)" for b in dims.BASIN_CLUSTERS]
    floats += [f"{r}_气温24h变(℃)" for r in temps] + [f"{r}_{k}" for r in temps for k in ("HDD", "CDD")]
    out = ", ".join(f'{steady(chr(34) + c + chr(34), 5)} AS "{c}"' for c in floats)
    as_int = lambda cond: f"CASE WHEN {cond} THEN 1 ELSE 0 END"
    hol = " OR ".join(f"(month(g.ts) = {m} AND day(g.ts) BETWEEN {a} AND {b})" for m, a, b in dims.HOLIDAYS)
    gone = f"date_diff('day', {FESTIVAL}, CAST(g.ts AS DATE))"
    p = PERIOD.replace("(ts)", "(g.ts)")
    body = (
        "SELECT g.series_id, strftime(g.ts, '%Y-%m-%d') AS \"日期\", strftime(g.ts, '%H:%M') || '-' || strftime(g.ts + INTERVAL 15 MINUTE, '%H:%M') AS \"时段\", '正式运行' AS \"运行阶段\", "
        f"CASE WHEN {hol} THEN '节假日' WHEN isodow(g.ts) >= 6 THEN '周末' ELSE '工作日' END AS \"日期类型\", renewable_total AS \"新能源总出力(MW)\", hydro AS \"水电(MW)\", wind AS \"风电(MW)\", solar AS \"光伏(MW)\", "
        "load AS \"省内负荷(MW)\", price AS \"出清价格(元/MWh)\", 'cluster means of 19 weather nodes' AS \"数据来源\", CAST(NULL AS DOUBLE) AS \"离群标记\", strftime(g.ts, '%Y-%m-%d %H:%M:%S') AS \"datetime_bj\", "
        f"{as_int('month(g.ts) BETWEEN 1 AND 4')} AS \"枯水期\", {as_int('month(g.ts) >= 5')} AS \"汛期\", {as_int('month(g.ts) >= 7')} AS \"主汛期\", {as_int(gone + ' = -1')} AS \"节前1天\", {as_int(gone + ' = 1')} AS \"节后1天\", "
        f"{as_int(p + ' BETWEEN 20 AND 35')} AS \"早高峰\", {as_int(p + ' BETWEEN 68 AND 87')} AS \"晚高峰\", {as_int(p + ' BETWEEN 48 AND 67')} AS \"午间谷段\", {out}, 1 AS \"气象数据\", "
        "bidspace AS \"竞价空间(MW)\", reserve AS \"系统备用(MW)\", nonmarket AS \"非市场机组(MW)\", tieline AS \"联络线(MW)\", load_tie AS \"负荷联络线(MW)\" FROM gap_grid g LEFT JOIN bt2 b ON b.ts = date_trunc('hour', g.ts)")
    return ora(body, "gap_grid", "wx_obs", **_hourly("wx_obs"), bt1=f"SELECT ts, {clusters}, {rain} FROM wx_fill", bt2="SELECT *, " + ", ".join(derived) + " FROM bt1")


BASE_TABLE_SQL = _base_table()
