"""Serving queries over measured and predicted tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import calendar
from gridloom.functions.timegrid import col, step_index, step_time
from gridloom.operators.regular import spine
from gridloom.session import materialise
from gridloom.sources.store import latest_per_key, read_predictions


def prefer_version(pred: DataFrame, versions: Sequence[str], *, keys: Sequence[str] = ("target_time",)) -> DataFrame:
    """One row per target time, of the first listed version that has it."""
    rank = F.lit(None).cast("int")
    for i, v in reversed(list(enumerate(versions))):
        rank = F.when(col("model_version") == v, F.lit(-i)).otherwise(rank)
    wanted = pred.where(col("model_version").isin(list(versions)))
    return latest_per_key(wanted, keys, rank)


def _target_day(pred: DataFrame) -> Column:
    """The partition column of a stored table, else the date of the target time."""
    return F.col("target_date") if "target_date" in pred.columns else F.to_date("target_time")


def complete_days(pred: DataFrame, versions: Sequence[str], *, keys: Sequence[str] = (), expected: int = 96) -> DataFrame:
    """Days with at least `expected` distinct target times."""
    wanted = pred.where(col("model_version").isin(list(versions)))
    # two aggregations: duplicates of a time collapse before the count
    times = wanted.select(*keys, _target_day(wanted).alias("day"), "target_time").distinct()
    return (
        times.groupBy(*keys, "day").agg(F.count("*").alias("n_times"))
        .where(F.col("n_times") >= expected)
    )


def latest_complete_day(pred: DataFrame, versions: Sequence[str], *, keys: Sequence[str] = (), expected: int = 96) -> DataFrame:
    return complete_days(pred, versions, keys=keys, expected=expected).groupBy(*keys).agg(F.max("day").alias("day"))


def day_curve(pred: DataFrame, days: DataFrame, versions: Sequence[str], *, keys: Sequence[str] = ()) -> DataFrame:
    """Preferred prediction per period of the given days, with clock time and segment."""
    dated = pred.withColumn("day", _target_day(pred)).join(days.select(*keys, "day"), [*keys, "day"], "left_semi")
    best = prefer_version(dated, versions, keys=[*keys, "day", "target_time"])
    p = calendar.period(F.col("target_time"))
    return best.select(
        *keys, "day", p.alias("period"), calendar.period_to_time(p).alias("time"),
        F.bround("predicted_price", 1).alias("price"), calendar.segment_of(p).alias("segment"), "model_version",
    )


def stored_day_curve(spark: SparkSession, path: str, versions: Sequence[str], *, keys: Sequence[str] = (), since: date | None = None,
                     expected: int = 96) -> DataFrame:
    """Curve of the latest complete day of each key from the prediction store.

    Dates before `since` are not looked at; of the others the days are found by
    the time column alone, and only the partitions of the found days are read whole.
    """
    recent = read_predictions(spark, path, versions, first=since)
    days = materialise(latest_complete_day(recent, versions, keys=keys, expected=expected), "latest-days")
    return day_curve(read_predictions(spark, path, versions, days=days), days, versions, keys=keys)


def day_summary(df: DataFrame, *, keys: Sequence[str] = (), value: str = "price", period: str = "period") -> DataFrame:
    """Average, peak and valley of a day; among equal prices the first period counts."""
    v, p = col(value), col(period)
    return df.groupBy(*keys, "day").agg(
        F.bround(F.avg(v), 1).alias("avg_price"),
        F.max(v).alias("peak_price"),
        F.max(F.when(v.isNotNull(), F.struct(v.alias("v"), (-p).alias("p"))))["p"].alias("_peak"),
        F.min(v).alias("valley_price"),
        F.min(F.when(v.isNotNull(), F.struct(v.alias("v"), p.alias("p"))))["p"].alias("valley_period"),
    ).select(*keys, "day", "avg_price", "peak_price", (-F.col("_peak")).alias("peak_period"), "valley_price", "valley_period")


def history_compare(actual: DataFrame, pred: DataFrame, start: Column, end: Column, versions: Sequence[str], *,
                    keys: Sequence[str] = (), series: DataFrame | None = None) -> DataFrame:
    """Measured and predicted price for every day and period of a range, both ends included.

    The keys come from `series`; without it a series counts that has a measured row at
    any time, or a prediction in the range, and the measured table is read for its keys.
    Of a stored prediction table only the range's partitions are read.
    """
    stop = F.date_add(end, 1).cast("timestamp_ntz")
    first = start.cast("timestamp_ntz")
    seen = actual.where((col("ts") >= first) & (col("ts") < stop)).select(
        *keys, step_index(col("ts")).alias("_step"), F.bround("price", 1).alias("actual"))
    day = _target_day(pred)
    inside = pred.where((day >= start) & (day <= end) & (col("target_time") >= first) & (col("target_time") < stop))
    chosen = prefer_version(inside, versions, keys=[*keys, "target_time"])
    guess = chosen.select(*keys, step_index(col("target_time")).alias("_step"),
                          F.bround("predicted_price", 1).alias("predicted"))
    both = seen.join(guess, [*keys, "_step"], "full")
    if not keys:
        span = actual.sparkSession.range(1).select()
    else:
        span = (series.select(*keys) if series is not None else actual.select(*keys).union(chosen.select(*keys))).distinct()
    bounds = span.select(*keys, step_index(first).alias("_lo"), (step_index(stop) - 1).alias("_hi"))
    dense = spine(bounds, series=list(keys)).join(both, [*keys, "_step"], "left")
    ts = step_time(F.col("_step"))
    return dense.select(*keys, F.to_date(ts).alias("day"), calendar.period(ts).alias("period"), "actual", "predicted")


def history_arrays(history: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """96-slot arrays per day, as the web form of the history wants them."""
    def slots(c: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.struct("period", c)))
        return F.transform(ordered, lambda s: s[c]).alias(c)
    return history.groupBy(*keys, "day").agg(slots("actual"), slots("predicted"))


def table_stats(df: DataFrame, *, keys: Sequence[str] = (), ts: str = "ts", expected: int | None = None) -> DataFrame:
    """Row count and time range."""
    stats = df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.min(col(ts)).alias("first_ts"), F.max(col(ts)).alias("last_ts"))
    return stats if expected is None else stats.withColumn("as_expected", F.col("n_rows") == expected)


def first_rows(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)
