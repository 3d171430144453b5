"""The tidy one-row-per-step export: 82 columns."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom import dims
from gridloom.functions import calendar, derived
from gridloom.functions.calendar import flag
from gridloom.functions.timegrid import HOUR, col, shift_minutes, step_index
from gridloom.operators.chunked import ChunkWindows, chunk_windows
from gridloom.operators.rolling import Roll, rolling_phases
from gridloom.operators.spatial import cluster_mean_expr
from gridloom.plans.features import dense_weather


def weather_block(weather: DataFrame, keys: Sequence[str], *, zero_missing: bool = False) -> DataFrame:
    """Hourly cluster means, basin rain, temperature change and degree days."""
    hourly = dense_weather(weather, keys)
    mean = lambda v, c: cluster_mean_expr(v, c, keys, zero_missing)
    scale = {"cloud": 100.0}
    label = lambda c, v: f"{dims.CLUSTER_LABELS[c]}_{dims.VARIABLE_LABELS[v]}"
    base = hourly.select(
        "ts",
        *[(mean(v, c) / scale.get(v, 1.0)).alias(label(c, v)) for c in dims.CLUSTER_LABELS for v in dims.VARIABLES],
        *[sum((F.coalesce(mean("precip", c), F.lit(0.0)) for c in cs), F.lit(0.0)).alias(f"_rain_{b}")
          for b, cs in dims.BASIN_CLUSTERS.items()],
    )
    base = base.withColumnsRenamed({f"_rain_{b}": f"rain {b}" for b in dims.BASIN_CLUSTERS})
    temps = {r: label(c, "temp") for r, c in dims.TEMPERATURE_REGIONS.items()}
    rain = rolling_phases([Roll(f"{b}_24h降水(mm)", f"rain {b}", 24, "sum", lag=0, min_rows=1) for b in dims.BASIN_CLUSTERS])

    def derive(w: ChunkWindows) -> dict:
        out = {f"{r}_气温24h变(℃)": col(t) - F.lag(col(t), 24).over(w.time) for r, t in temps.items()}
        for r, t in temps.items():
            out[f"{r}_HDD"] = derived.heating_degrees(col(t))
            out[f"{r}_CDD"] = derived.cooling_degrees(col(t))
        return out

    return chunk_windows(base, [*rain, derive], series=[], back=25, minutes=HOUR, chunk_days=224)


def base_table(grid: DataFrame, weather: DataFrame, *, series: Sequence[str] = (), festival: date = dims.SPRING_FESTIVAL,
               keys: Sequence[str] | None = None, zero_missing: bool = False) -> DataFrame:
    """13 base, 8 time, 42 cluster, 14 derived and 5 market columns per step (plus the series keys)."""
    keys = list(keys) if keys is not None else dims.weather_keys()
    hourly = weather_block(weather, keys, zero_missing=zero_missing)
    hourly = hourly.withColumn("_hour", step_index(F.col("ts"), HOUR)).drop("ts")
    joined = grid.withColumn("_hour", step_index(F.col("ts"), HOUR)).join(hourly, "_hour", "left")
    ts, p = F.col("ts"), calendar.period(F.col("ts"))
    as_int = lambda cond: flag(cond).cast("int")
    clock = lambda t: F.date_format(t, "HH:mm")
    month, gone = F.month(ts), calendar.days_from(ts, festival)
    day_kind = F.col("day_type") if "day_type" in grid.columns else calendar.day_type(ts)
    cluster_cols = [f"{dims.CLUSTER_LABELS[c]}_{dims.VARIABLE_LABELS[v]}" for c in dims.CLUSTER_LABELS for v in dims.VARIABLES]
    derived_cols = [*[f"{b}_24h降水(mm)" for b in dims.BASIN_CLUSTERS], *[f"{r}_气温24h变(℃)" for r in dims.TEMPERATURE_REGIONS],
                    *[f"{r}_{k}" for r in dims.TEMPERATURE_REGIONS for k in ("HDD", "CDD")]]
    return joined.select(
        *series,
        F.date_format(ts, "yyyy-MM-dd").alias("日期"),
        F.concat(clock(ts), F.lit("-"), clock(shift_minutes(ts, 15))).alias("时段"),
        F.lit("正式运行").alias("运行阶段"),
        day_kind.alias("日期类型"),
        F.col("renewable_total").alias("新能源总出力(MW)"), F.col("hydro").alias("水电(MW)"), F.col("wind").alias("风电(MW)"),
        F.col("solar").alias("光伏(MW)"), F.col("load").alias("省内负荷(MW)"), F.col("price").alias("出清价格(元/MWh)"),
        F.lit("cluster means of 19 weather nodes").alias("数据来源"),
        F.lit(None).cast("double").alias("离群标记"),
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("datetime_bj"),
        as_int(month.between(1, 4)).alias("枯水期"), as_int(month >= 5).alias("汛期"), as_int(month >= 7).alias("主汛期"),
        as_int(gone == -1).alias("节前1天"), as_int(gone == 1).alias("节后1天"),
        as_int(p.between(20, 35)).alias("早高峰"), as_int(p.between(68, 87)).alias("晚高峰"), as_int(p.between(48, 67)).alias("午间谷段"),
        *[col(c) for c in cluster_cols],
        *[col(c) for c in derived_cols],
        F.lit(1).alias("气象数据"),
        F.col("bidspace").alias("竞价空间(MW)"), F.col("reserve").alias("系统备用(MW)"), F.col("nonmarket").alias("非市场机组(MW)"),
        F.col("tieline").alias("联络线(MW)"), F.col("load_tie").alias("负荷联络线(MW)"),
    )
