"""The feature frame: groups A to P, 185 columns, and the selection rules.

Shape of the job: weather is prepared on its hourly table, quantile cut-offs on
small group tables; both are joined to the still narrow grid, which is then
shuffled once by (series, time chunk) for every lag, rolling and day feature.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom import dims
from gridloom.functions import calendar, derived
from gridloom.functions.timegrid import HOUR, QUARTER, col, shift_minutes, step_index
from gridloom.operators import quantiles, regular
from gridloom.operators.chunked import ChunkWindows, chunk_windows
from gridloom.operators.daily import curve_stats, morning_stats
from gridloom.operators.rolling import Roll, offset_window_phases, rolling_phases
from gridloom.operators.shift import grid_lag
from gridloom.operators.spatial import cluster_mean_expr, fused_expr, unpack_map
from gridloom.session import materialise

H = 96
DAY_HOURS = 24
GRID_INPUTS = ["solar", "wind", "hydro", "load", "price", "bidspace", "nonmarket"]
WEATHER_CLUSTERS = [(v, c) for v, shares in dims.REGION_WEIGHTS.items() for c in shares] + [("temp", "liangshan")]


def dense_weather(weather: DataFrame, keys: Sequence[str], *, ts: str = "ts", value: str = "variables") -> DataFrame:
    """Map rows to one row per hour and one filled column per key."""
    wide = unpack_map(weather.select(ts, value), value, keys)
    return regular.densify(wide, series=[], ts=ts, minutes=HOUR)


WEATHER_AHEAD = [
    "temp_avg", "rad_avg", "rad_eff", "cloud_avg", "precip_avg", "cdd_avg", "apparent_temp", "wind_cubic", "wind_avg", "is_daytime",
    "precip_yaan", "precip_panzhihua", "precip_liangshan", "precip_sq", "precip_sqrt", "rain_24h", "rain_72h",
]
WEATHER_NOW = [
    "temp_avg", "rad_avg", "cloud_avg", "wind_avg", "apparent_temp", "wind_cubic", "is_daytime", "rain_72h", "rain_15d",
    "cloud_chg_24h", "temp_chg_24h", "temp_diurnal_range", "temp_chengdu",
]


def weather_hours(weather: DataFrame, *, ts: str = "ts", keys: Sequence[str] | None = None, zero_missing: bool = False) -> DataFrame:
    """One row per hour: fused weather, rain sums, changes."""
    used = {f"{v}_{n}" for v, c in WEATHER_CLUSTERS for n in dims.CLUSTERS[c]}
    keys = [k for k in (keys if keys is not None else dims.weather_keys()) if k in used]
    hourly = dense_weather(weather, keys, ts=ts)
    means = {f"{v}_{c}": cluster_mean_expr(v, c, keys, zero_missing) for v, c in WEATHER_CLUSTERS}
    base = hourly.select(ts, *[e.alias(n) for n, e in means.items()])
    by_pair = {(v, c): col(f"{v}_{c}") for v, c in WEATHER_CLUSTERS}
    base = base.withColumns({f"{v}_avg": fused_expr(v, by_pair) for v in dims.REGION_WEIGHTS})
    base = base.withColumns({
        "cdd_avg": derived.cooling_degrees(F.col("temp_avg")),
        "rad_eff": derived.effective_radiation(F.col("rad_avg"), F.col("cloud_avg")),
        "apparent_temp": derived.apparent_temperature(F.col("temp_avg"), F.col("rh_avg")),
        "wind_cubic": derived.cubic(F.col("wind_avg")),
        "is_daytime": derived.is_daytime(F.col("rad_avg")),
        "precip_sq": derived.rain_squared(F.col("precip_avg")),
        "precip_sqrt": derived.rain_root(F.col("precip_avg")),
    })
    sums = rolling_phases([Roll(n, "precip_avg", hours, "sum", lag=0, min_rows=1)
                           for n, hours in (("rain_24h", 24), ("rain_72h", 72), ("rain_15d", 360))])

    def changes(w: ChunkWindows) -> dict[str, Column]:
        day_ago = lambda c: col(c) - F.lag(col(c), DAY_HOURS).over(w.time)
        return {
            "cloud_chg_24h": day_ago("cloud_liangshan"),
            "temp_chg_24h": day_ago("temp_liangshan"),
            "temp_diurnal_range": F.max("temp_chengdu").over(w.day) - F.min("temp_chengdu").over(w.day),
        }

    return chunk_windows(base, [*sums, changes], series=[], ts=ts, back=361, minutes=HOUR, chunk_days=224).select(
        step_index(col(ts), HOUR).alias("_hour"), *[col(c) for c in dict.fromkeys([*WEATHER_NOW, *WEATHER_AHEAD])])


def with_day_ahead(hours: DataFrame) -> DataFrame:
    """Per hour the values of that hour and, as `*_pp`, of the hour one day later."""
    later = hours.select((F.col("_hour") - DAY_HOURS).alias("_hour"), *[col(c).alias(f"{c}_pp") for c in WEATHER_AHEAD])
    return hours.select("_hour", *WEATHER_NOW).join(later, "_hour", "full")


def _stack(grid: DataFrame, series: Sequence[str], ts: str) -> DataFrame:
    """Cut-offs of the flag features: per (series, month) and per series, both bounded by the calendar."""
    monthly = quantiles.month_quantiles(
        grid, {"load": (0.1, 0.9), "price": (0.05, 0.95), "solar": (0.1, 0.9), "wind": (0.1, 0.9)}, series=series, ts=ts)
    overall = grid.groupBy(*series).agg(
        F.percentile("load", F.lit(0.7)).alias("cut_load"), F.percentile("solar", F.lit(0.3)).alias("cut_solar"),
        F.percentile("wind", F.lit(0.3)).alias("cut_wind"))
    cuts = monthly.join(overall, list(series), "left") if series else monthly.crossJoin(F.broadcast(overall))  # a row per series and month
    return quantiles.join_few(grid.withColumn("_month", F.month(col(ts))), cuts, [*series, "_month"], how="left", spread=[ts]).drop("_month")


def _windows(rolls: Sequence[Roll]) -> list:
    lags = {
        "price": [H, 192, 288, 672], "solar": [4, H, 192, 672], "wind": [4, H, 192, 193, 196, 200, 672],
        "hydro": [4, H, 192, 193, 196, 288, 672], "load": [H, 192, 193, 196, 200, 672],
        "net_load": [H], "surplus": [H],
    }
    curves = {
        "solar": ["peak", "ramp_up", "std", "duration", "mean", "total"],
        "hydro": ["range", "mean", "night_mean", "daytime_mean"],
        "wind": ["range", "mean", "night_mean"],
        "load": ["morning_peak", "evening_peak", "valley", "peak_ratio", "mean"],
    }

    def shifts(w: ChunkWindows) -> dict[str, Column]:
        out = {f"{c}~{k}": F.lag(col(c), k).over(w.time) for c, ks in lags.items() for k in ks}
        out["rad_ramp"] = F.coalesce(col("rad_avg") - F.lag("rad_avg", 1).over(w.time), F.lit(0.0))
        last4 = w.rows(-3, 0)
        out["wind_turbulence"] = F.when(F.count("wind_avg").over(last4) >= 2, F.stddev_samp("wind_avg").over(last4))
        return out

    def days(w: ChunkWindows) -> dict[str, Column]:
        p, over = calendar.period(col("ts")), lambda a: a.over(w.day)
        out: dict[str, Column] = {}
        for c in ("solar", "hydro", "wind", "load"):
            out.update({f"morning_{op}_{c}": e for op, e in morning_stats(col(c), p, over).items()})
            out.update({f"day_{op}_{c}": e for op, e in curve_stats(col(c), p, over, curves[c]).items()})
        return out

    def yesterday(w: ChunkWindows) -> dict[str, Column]:
        return {f"d2_{c}_{op}": F.lag(col(f"day_{op}_{c}"), H).over(w.time) for c, ops in curves.items() for op in ops}

    # day windows first: everything after them shares the time order
    return [days, *rolling_phases(rolls), *offset_window_phases(["wind", "hydro", "load"], 192, 200), shifts, yesterday]


ROLLS = [
    Roll("price_vol_24h", "price", 96, "std"), Roll("price_ma_24h", "price", 96, "mean"),
    Roll("price_ma_7d", "price", 672, "mean"), Roll("price_max_720", "price", 720, "max", fill_first=True),
    Roll("hydro_ma_24h", "hydro", 96, "mean"), Roll("hydro_ma_7d", "hydro", 672, "mean"),
    Roll("hydro_ma_720", "hydro", 720, "mean"), Roll("hydro_vol_24h", "hydro", 96, "std"),
    Roll("solar_ma_24h", "solar", 96, "mean"), Roll("solar_ma_7d", "solar", 672, "mean"), Roll("solar_ma_720", "solar", 720, "mean"),
    Roll("wind_ma_24h", "wind", 96, "mean"), Roll("wind_ma_7d", "wind", 672, "mean"), Roll("wind_ma_720", "wind", 720, "mean"),
    Roll("wind_vol_24h", "wind", 96, "std"), Roll("load_max_720", "load", 720, "max", fill_first=True),
]


def feature_exprs(ts: Column, festival: date) -> dict[str, Column]:
    """Feature name to expression over the prepared columns, in the order of the groups."""
    c = col
    lag = lambda name, k: col(f"{name}~{k}")
    load1 = lambda x: derived.share(col(x), col("load"))
    target = shift_minutes(ts, H * QUARTER)
    pp = calendar.period(target)
    p_sin, p_cos = calendar.cyclic(pp, 96)
    m_sin, m_cos = calendar.cyclic(F.month(target), 12)
    seasons = calendar.season_flags(target)
    flood = seasons["is_flood"]
    f: dict[str, Column] = {}

    def group(letter: str, **items: Column) -> None:
        f.update({f"{letter}_{n}": e for n, e in items.items()})

    group("A", **{f"price_lag_{k}": lag("price", k) for k in (96, 192, 288, 672)},
          price_chg_3d=c("price") - lag("price", 288), price_chg_7d=c("price") - lag("price", 672),
          price_vol_24h=c("price_vol_24h"), price_ma_24h=c("price_ma_24h"), price_ma_7d=c("price_ma_7d"),
          price_accel=c("price") - lag("price", 96) * 2 + lag("price", 192),
          price_diff_1d=c("price") - lag("price", 96), price_max_30d=c("price_max_720"))
    group("B", **{f"{x}[t]": c(x) for x in ("solar", "wind", "hydro", "load")},
          solar_lag_96=lag("solar", 96), solar_lag_672=lag("solar", 672), wind_lag_4=lag("wind", 4),
          wind_lag_96=lag("wind", 96), wind_lag_672=lag("wind", 672), hydro_lag_96=lag("hydro", 96),
          hydro_lag_672=lag("hydro", 672), load_lag_96=lag("load", 96), load_lag_672=lag("load", 672),
          hydro_ma_7d=c("hydro_ma_7d"))
    group("C", **{"net_load[t]": c("net_load"), "surplus[t]": c("surplus"), "solar_pen[t]": load1("solar"),
                  "hydro_pen[t]": load1("hydro"), "wind_pen[t]": load1("wind"), "penetration[t]": load1("renew_total")},
          net_load_lag_96=lag("net_load", 96), surplus_lag_96=lag("surplus", 96), surplus_scaled=load1("surplus"),
          **{"renew_total[t]": c("renew_total")})
    group("D", temp_avg_pp=c("temp_avg_pp"), rad_avg_pp=c("rad_avg_pp"), rad_eff_pp=c("rad_eff_pp"),
          cloud_avg_pp=c("cloud_avg_pp"), rain_24h_avg_pp=c("rain_24h_pp"), rain_h_avg_pp=c("precip_avg_pp"),
          cdd_avg_pp=c("cdd_avg_pp"), apparent_temp_pp=c("apparent_temp_pp"), wind_cubic_pp=c("wind_cubic_pp"),
          temp_avg_now=c("temp_avg"), rad_avg_now=c("rad_avg"), cloud_avg_now=c("cloud_avg"),
          apparent_temp_now=c("apparent_temp"), wind_cubic_now=c("wind_cubic"),
          is_daytime=c("is_daytime"), is_daytime_pp=c("is_daytime_pp"), ghi_ramp_15min=c("rad_ramp"),
          is_generating_pp=derived.is_generating(c("wind_avg_pp")), wind_turbulence_1h=c("wind_turbulence"),
          precip_15d_sum=c("rain_15d"), precip_yaan_pp=c("precip_yaan_pp"), precip_pzh_pp=c("precip_panzhihua_pp"),
          precip_ls_pp=c("precip_liangshan_pp"), precip_avg_sq_pp=c("precip_sq_pp"), precip_avg_sqrt_pp=c("precip_sqrt_pp"))
    group("E", **{"bidspace[t]": c("bidspace"), "bidspace_ratio": load1("bidspace"),
                  "nonmarket[t]": c("nonmarket"), "nonmarket_ratio": load1("nonmarket")})
    group("F", period_sin_pp=p_sin, period_cos_pp=p_cos, month_sin_pp=m_sin, month_cos_pp=m_cos,
          is_holiday_pp=calendar.flag(calendar.is_holiday(target)), is_weekend_pp=calendar.flag(calendar.is_weekend(target)),
          is_dry_season_pp=seasons["is_dry_season"], is_flood_pp=flood,
          **{f"slot_{n}_pp": e for n, e in calendar.slot_flags(pp).items()})
    side = lambda x: quantiles.side_of(c(x), c(f"_lo_{x}"), c(f"_hi_{x}"))
    group("G", extreme_load=side("load"), extreme_price=side("price"), extreme_solar=side("solar"), extreme_wind=side("wind"),
          high_load_low_solar=calendar.flag((c("load") > c("cut_load")) & (c("solar") < c("cut_solar"))),
          high_temp_low_wind=calendar.flag((c("temp_chengdu") > 25) & (c("wind") < c("cut_wind"))))
    group("H", load_max_30d=c("load_max_720"), solar_ma_30d=c("solar_ma_720"), wind_ma_30d=c("wind_ma_720"),
          hydro_ma_30d=c("hydro_ma_720"))
    group("I", sim7d=lag("price", 672))
    group("J", rad_pp_x_period_cos=c("rad_avg_pp") * p_cos, rain72h_x_flood=c("rain_72h_pp") * flood,
          cloud_chg_x_temp_chg=c("cloud_chg_24h") * c("temp_chg_24h"), rain24h_x_hydro=c("rain_24h_pp") * c("hydro"),
          precip_yaan_x_flood=c("precip_yaan_pp") * flood, precip_15d_x_hydro=c("rain_15d") * c("hydro"))
    group("K", solar_lag_4=lag("solar", 4), solar_lag_192=lag("solar", 192), solar_ma_24h=c("solar_ma_24h"),
          solar_ma_7d=c("solar_ma_7d"), solar_diff_1d=c("solar") - lag("solar", 96), hydro_lag_4=lag("hydro", 4),
          hydro_ma_24h=c("hydro_ma_24h"), hydro_diff_1d=c("hydro") - lag("hydro", 96),
          hydro_diff_7d=c("hydro") - lag("hydro", 672), hydro_vol_24h=c("hydro_vol_24h"), wind_ma_24h=c("wind_ma_24h"),
          wind_ma_7d=c("wind_ma_7d"), wind_vol_24h=c("wind_vol_24h"), wind_diff_1d=c("wind") - lag("wind", 96),
          cloud_chg_24h=c("cloud_chg_24h"), temp_chg_24h=c("temp_chg_24h"), temp_diurnal_range=c("temp_diurnal_range"),
          **{"rain_72h_acc[t]": c("rain_72h")}, rain_72h_acc_pp=c("rain_72h_pp"))
    group("L", **{f"morning_{op}_{x}": c(f"morning_{op}_{x}") for op in ("mean", "last", "ramp", "std")
                  for x in ("solar", "hydro", "wind", "load")})
    group("M", days_from_sf=calendar.days_from(ts, festival), is_sf_window=calendar.flag(calendar.near_event(ts, festival)))
    d2 = lambda x, op: c(f"d2_{x}_{op}")
    group("N", d2_solar_peak=d2("solar", "peak"), d2_solar_ramp_up=d2("solar", "ramp_up"), d2_solar_day_std=d2("solar", "std"),
          d2_solar_duration=d2("solar", "duration"), d2_solar_day_mean=d2("solar", "mean"), d2_solar_day_total=d2("solar", "total"),
          d2_hydro_range=d2("hydro", "range"), d2_hydro_day_mean=d2("hydro", "mean"), d2_hydro_night_mean=d2("hydro", "night_mean"),
          d2_hydro_daytime_mean=d2("hydro", "daytime_mean"), d2_wind_range=d2("wind", "range"), d2_wind_day_mean=d2("wind", "mean"),
          d2_wind_night_mean=d2("wind", "night_mean"), d2_load_morning_peak=d2("load", "morning_peak"),
          d2_load_evening_peak=d2("load", "evening_peak"), d2_load_valley=d2("load", "valley"),
          d2_load_peak_ratio=d2("load", "peak_ratio"), d2_load_day_mean=d2("load", "mean"))
    step = lambda x, k: {f"{x}_lag_{k}": lag(x, k)}
    ramp = lambda x, hours: {f"{x}_d2_ramp_{hours}h": lag(x, 192) - lag(x, 192 + 4 * hours)}
    group("O", **step("wind", 192), **step("wind", 193), **step("wind", 196), **ramp("wind", 1), **ramp("wind", 2),
          **step("hydro", 192), **step("hydro", 193), **step("hydro", 196), **step("hydro", 288), **ramp("hydro", 1),
          **step("load", 192), **step("load", 193), **step("load", 196), **step("load", 200), **ramp("load", 1), **ramp("load", 2))
    group("P", **{f"{x}_d2_w2h_{s}": c(f"{x}_{s}") for x in ("wind", "hydro", "load")
                  for s in ("mean", "std", "trend", "range", "max_step", "accel")})
    return f


def feature_names() -> list[str]:
    """The 185 column names, read off the expressions (needs a live session)."""
    return list(feature_exprs(F.col("ts"), dims.SPRING_FESTIVAL))


def build_features(grid: DataFrame, weather: DataFrame, *, series: Sequence[str] = ("series_id",), lag_steps: int = 0,
                   festival: date = dims.SPRING_FESTIVAL, weather_keys: Sequence[str] | None = None,
                   zero_missing: bool = False, fill: bool = True) -> DataFrame:
    """Feature frame of a regular grid.

    `grid`: series columns, `ts` and the channels, one row per step. `weather`:
    `ts`, `variables`; it should reach one day past the grid, so that the rows to
    be served have their day-ahead values. `lag_steps` = 192 gives the variant for
    grid data published two days late. Keys, `ts`, `period`, `season`, targets and
    the 185 features are returned.
    """
    series = list(series)
    targets = ["solar", "hydro", "wind", "load", "price"]
    shifted = grid_lag(grid, GRID_INPUTS, lag_steps, series=series)
    s, w, h, l = F.col("solar"), F.col("wind"), F.col("hydro"), F.col("load")
    narrow = _stack(shifted, series, "ts").withColumns({
        "net_load": derived.net_load(l, s, w, h), "surplus": derived.surplus(l, s, w, h),
        "renew_total": derived.renewable(s, w, h),
    })
    # a few hundred bytes per hour, read twice; written once, which also tells the joins its size
    hourly = with_day_ahead(materialise(weather_hours(weather, keys=weather_keys, zero_missing=zero_missing), "weather"))
    joined = narrow.withColumn("_hour", step_index(F.col("ts"), HOUR)).join(hourly, "_hour", "left").drop("_hour")
    # helper columns of this plan start with "_" too, so keep them through the window pass
    outlook = lambda win: {f"y_{t}": F.lead(f"{t}_orig", H).over(win.time) for t in targets}
    lags = lambda win: {"price_lag96": F.lag("price_orig", H).over(win.time), "price_lag192": F.lag("price_orig", 192).over(win.time),
                        "price_lag672": F.lag("price_orig", 672).over(win.time)}
    wide = chunk_windows(joined, [*_windows(ROLLS), outlook, lags], series=series, back=721, ahead=H, keep_temp=True)
    exprs = feature_exprs(F.col("ts"), festival)
    value = (lambda e: F.coalesce(e.cast("double"), F.lit(0.0))) if fill else (lambda e: e.cast("double"))
    return wide.select(
        *series, "ts", calendar.period(F.col("ts")).alias("period"), calendar.season(F.col("ts")).alias("season"),
        *[F.col(f"y_{t}") for t in targets], (F.col("y_price") - F.col("price_orig")).alias("y_price_resid"),
        F.col("price_orig").alias("price"), "price_lag96", "price_lag192", "price_lag672",
        *[value(e).alias(n) for n, e in exprs.items()],
    )


# --- selection rules ---------------------------------------------------------
# fixed values: names of the features later stages may see
SAFE_PRICE = ["A_price_lag_96", "A_price_lag_192", "A_price_lag_288", "A_price_lag_672",
              "A_price_ma_24h", "A_price_ma_7d", "A_price_vol_24h", "A_price_max_30d"]
SAFE_LAGGED = ["B_solar_lag_96", "B_solar_lag_672", "B_wind_lag_96", "B_wind_lag_672",
               "B_hydro_lag_96", "B_hydro_lag_672", "B_load_lag_96", "B_load_lag_672"]
SAFE_OTHER = ["C_net_load_lag_96", "C_surplus_lag_96", "J_rad_pp_x_period_cos", "J_rain72h_x_flood"]
SAFE_GROUPS = ["F", "G", "H", "I", "L", "M"]


def safe_columns(columns: Sequence[str]) -> list[str]:
    """Columns known at forecast time that the price models may use."""
    named = {*SAFE_PRICE, *SAFE_LAGGED, *SAFE_OTHER}
    def keep(n: str) -> bool:
        letter = n[:1] if n[1:2] == "_" else ""
        return n in named or letter in SAFE_GROUPS or (letter == "D" and n.endswith("_pp"))
    return [n for n in columns if keep(n)]


TOPIC_WORDS = {
    # fixed values: substrings that tie a feature to a target
    "solar": ["solar", "rad", "period_cos", "is_daytime", "ghi_ramp"],
    "hydro": ["hydro", "rain", "flood", "precip_15d"],
    "wind": ["wind", "cloud_chg", "temp_chg", "diurnal", "is_generating", "turbulence"],
    "load": ["load", "sf", "temp_avg_pp", "cdd", "apparent_temp"],
}


def topic_columns(columns: Sequence[str], topic: str) -> list[str]:
    """Feature columns whose name (after the group letter) contains a word of the topic."""
    return [n for n in columns if n[1:2] == "_" and any(word in n[2:] for word in TOPIC_WORDS[topic])]


def select_by_rule(df: DataFrame, *, keep: Sequence[str]) -> DataFrame:
    return df.select(*[col(k) for k in keep], *[col(n) for n in safe_columns(df.columns)])


# fixed values: inputs of the first-stage models
STAGE1_FEATURES = {
    "solar": [
        "D_rad_avg_pp", "D_rad_eff_pp", "D_temp_avg_pp", "D_cloud_avg_pp", "D_cdd_avg_pp", "D_rain_h_avg_pp", "D_rain_24h_avg_pp",
        "F_period_sin_pp", "F_period_cos_pp", "F_month_sin_pp", "F_month_cos_pp", "F_is_holiday_pp", "F_is_weekend_pp",
        "F_is_dry_season_pp", "F_is_flood_pp", "F_slot_午谷_pp", "F_slot_上午_pp", "F_slot_深夜_pp",
        "B_solar_lag_96", "B_solar_lag_672", "K_solar_lag_192",
        "L_morning_mean_solar", "L_morning_last_solar", "L_morning_ramp_solar", "L_morning_std_solar",
        "N_d2_solar_peak", "N_d2_solar_ramp_up", "N_d2_solar_day_std", "N_d2_solar_duration", "N_d2_solar_day_mean",
        "N_d2_solar_day_total", "K_solar_ma_7d", "J_rad_pp_x_period_cos", "D_is_daytime", "D_is_daytime_pp", "D_ghi_ramp_15min",
    ],
    "hydro": [
        "B_hydro_lag_96", "B_hydro_lag_672", "B_hydro_ma_7d", "D_temp_avg_pp", "D_rain_24h_avg_pp", "D_rain_h_avg_pp",
        "D_cdd_avg_pp", "K_rain_72h_acc_pp", "D_precip_15d_sum", "D_precip_yaan_pp", "D_precip_pzh_pp", "D_precip_ls_pp",
        "D_precip_avg_sq_pp", "D_precip_avg_sqrt_pp", "L_morning_mean_hydro", "L_morning_last_hydro", "L_morning_ramp_hydro",
        "L_morning_std_hydro", "N_d2_hydro_range", "N_d2_hydro_day_mean", "N_d2_hydro_night_mean", "N_d2_hydro_daytime_mean",
        "F_period_sin_pp", "F_period_cos_pp", "F_month_sin_pp", "F_month_cos_pp", "F_is_dry_season_pp", "F_is_flood_pp",
        "F_slot_晚峰_pp", "F_slot_午谷_pp", "J_rain72h_x_flood", "J_rain24h_x_hydro", "J_precip_yaan_x_flood",
        "J_precip_15d_x_hydro", "O_hydro_lag_192", "O_hydro_lag_193", "O_hydro_lag_196", "O_hydro_lag_288",
        "O_hydro_d2_ramp_1h", "P_hydro_d2_w2h_mean", "P_hydro_d2_w2h_std", "P_hydro_d2_w2h_trend", "P_hydro_d2_w2h_range",
        "P_hydro_d2_w2h_max_step", "P_hydro_d2_w2h_accel",
    ],
    "wind": [
        "B_wind_lag_96", "B_wind_lag_672", "K_wind_ma_7d", "D_wind_cubic_pp", "D_wind_cubic_now", "D_cloud_avg_pp",
        "D_temp_avg_pp", "D_is_generating_pp", "D_wind_turbulence_1h", "L_morning_mean_wind", "L_morning_last_wind",
        "L_morning_ramp_wind", "L_morning_std_wind", "N_d2_wind_range", "N_d2_wind_day_mean", "N_d2_wind_night_mean",
        "F_period_cos_pp", "F_period_sin_pp", "F_month_sin_pp", "F_month_cos_pp", "K_temp_diurnal_range",
        "O_wind_lag_192", "O_wind_lag_193", "O_wind_lag_196", "O_wind_d2_ramp_1h", "O_wind_d2_ramp_2h",
        "P_wind_d2_w2h_mean", "P_wind_d2_w2h_std", "P_wind_d2_w2h_trend", "P_wind_d2_w2h_range", "P_wind_d2_w2h_max_step",
        "P_wind_d2_w2h_accel",
    ],
    "load": [
        "B_load_lag_96", "B_load_lag_672", "B_hydro_ma_7d", "D_temp_avg_pp", "D_cdd_avg_pp", "D_apparent_temp_pp",
        "D_apparent_temp_now", "L_morning_mean_load", "L_morning_last_load", "L_morning_ramp_load", "L_morning_std_load",
        "N_d2_load_morning_peak", "N_d2_load_evening_peak", "N_d2_load_valley", "N_d2_load_peak_ratio", "N_d2_load_day_mean",
        "M_days_from_sf", "M_is_sf_window", "F_period_sin_pp", "F_period_cos_pp", "F_month_sin_pp", "F_month_cos_pp",
        "F_is_holiday_pp", "F_is_weekend_pp", "F_is_dry_season_pp", "O_load_lag_192", "O_load_lag_193", "O_load_lag_196",
        "O_load_lag_200", "O_load_d2_ramp_1h", "O_load_d2_ramp_2h", "P_load_d2_w2h_mean", "P_load_d2_w2h_std",
        "P_load_d2_w2h_trend", "P_load_d2_w2h_range", "P_load_d2_w2h_max_step", "P_load_d2_w2h_accel",
    ],
}
