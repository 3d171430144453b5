"""Data-quality checks and the daily status, for all days in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom import dims
from gridloom.functions.calendar import period
from gridloom.functions.timegrid import col
from gridloom.operators.spatial import as_map

EXPECTED = 96


def _day(ts: str) -> Column:
    return F.to_date(col(ts))


def completeness(df: DataFrame, *, series: Sequence[str], ts: str = "ts", expected: int = EXPECTED) -> DataFrame:
    """Distinct periods present per series and day."""
    slots = df.select(*series, _day(ts).alias("day"), period(col(ts)).alias("period")).distinct()
    per = slots.groupBy(*series, "day").agg(F.count("*").alias("present"))
    return per.withColumns({
        "missing": F.lit(expected) - F.col("present"),
        "completeness_pct": F.round(F.col("present") / expected * 100, 2),
    })


def missing_slots(df: DataFrame, *, series: Sequence[str], ts: str = "ts", show: int = 10) -> DataFrame:
    """Periods absent from each day that has rows; the first few and their number.

    A day has 96 slots, so the collected set is small whatever the row count.
    """
    every = F.sequence(F.lit(0), F.lit(EXPECTED - 1))
    per = df.groupBy(*series, _day(ts).alias("day")).agg(F.collect_set(period(col(ts))).alias("_have"))
    gone = F.array_sort(F.array_except(every, F.col("_have")))
    return per.select(*series, "day", F.size(gone).alias("n_missing"), F.slice(gone, 1, show).alias("missing_slots"))


def absent_periods(df: DataFrame, *, series: Sequence[str], ts: str = "ts") -> DataFrame:
    """Rows (series, day, period) that do not occur, as an anti join against the full day."""
    have = df.select(*series, _day(ts).alias("day"), period(col(ts)).alias("period")).distinct()
    days = have.select(*series, "day").distinct()
    full = days.withColumn("period", F.explode(F.sequence(F.lit(0), F.lit(EXPECTED - 1))))
    return full.join(have, [*series, "day", "period"], "left_anti")


def to_long(df: DataFrame, cols: Sequence[str], keep: Sequence[Column]) -> DataFrame:
    """Channels as rows, in one pass over the table."""
    pairs = F.array(*[F.struct(F.lit(c).alias("channel"), col(c).cast("double").alias("value")) for c in cols])
    return df.select(*keep, F.explode(pairs).alias("_p")).select("*", "_p.channel", "_p.value").drop("_p")


def range_check(df: DataFrame, *, series: Sequence[str], ts: str = "ts", ranges: dict | None = None) -> DataFrame:
    """Values outside their valid range per series, day and channel."""
    ranges = ranges or dims.VALID_RANGES
    cols = [c for c in ranges if c in df.columns]
    limits = F.broadcast(dims.range_dim(df.sparkSession, ranges))  # one row per channel
    long = to_long(df, cols, [*[col(s) for s in series], _day(ts).alias("day")])
    outside = (F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))
    return long.join(limits, "channel").groupBy(*series, "day", "channel").agg(
        F.count(F.when(outside, 1)).alias("outliers"),
        F.round(F.min("value"), 2).alias("min_value"), F.round(F.max("value"), 2).alias("max_value"))


def jump_check(df: DataFrame, *, series: Sequence[str], ts: str = "ts", limits: dict | None = None) -> DataFrame:
    """Steps between neighbouring known values of a day that exceed the limit."""
    limits = limits or dims.JUMP_LIMITS
    cols = [c for c in limits if c in df.columns]
    long = to_long(df, cols, [*[col(s) for s in series], _day(ts).alias("day"), period(col(ts)).alias("period")])
    long = long.where(F.col("value").isNotNull())
    w = Window.partitionBy(*series, "day", "channel").orderBy("period")  # at most 96 rows
    limit = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(float(limits[c])))])
    steps = long.withColumns({
        "_jump": F.abs(F.col("value") - F.lag("value").over(w)), "_from": F.lag("period").over(w),
    }).where(F.col("_jump").isNotNull())
    over = F.col("_jump") > F.try_element_at(limit, F.col("channel"))
    best = F.max(F.when(over, F.struct(F.col("_jump").alias("j"), (-F.col("_from")).alias("p"))))
    found = steps.groupBy(*series, "day", "channel").agg(F.count(F.when(over, 1)).alias("jumps"), best.alias("_best"))
    return found.select(*series, "day", "channel", "jumps", F.round("_best.j", 1).alias("max_jump"),
                        (-F.col("_best.p")).alias("max_jump_from"))


def key_missing_rate(obs: DataFrame, *, ts: str = "ts", value: str = "variables", keys: Sequence[str] | None = None) -> DataFrame:
    """Share of a day's rows in which a key is absent or null."""
    obs = as_map(obs, value)
    rows = obs.groupBy(_day(ts).alias("day")).agg(F.count("*").alias("n_rows"))
    found = obs.select(_day(ts).alias("day"), F.explode(col(value)).alias("key", "_v"))
    have = found.groupBy("day", "key").agg(F.count("_v").alias("n_values"))
    if keys is not None:
        every = rows.select("day", F.explode(F.array(*[F.lit(k) for k in keys])).alias("key"))
        have = every.join(have, ["day", "key"], "left")
    return have.join(rows, "day").select(
        "day", "key",
        F.round((F.col("n_rows") - F.coalesce("n_values", F.lit(0))) / F.col("n_rows"), 4).alias("missing_rate"))


def status_of(pct: Column, price_load_outliers: Column, price_jumps: Column, core_missing: Column) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (
        F.when(F.coalesce(pct, F.lit(0.0)) < 90, "critical")
        .when(zero(price_load_outliers) > 3, "warning")
        .when(zero(price_jumps) > 5, "warning")
        .when(F.coalesce(core_missing, F.lit(0.0)) > 0.5, "warning")
        .when(pct < 95, "warning")
        .otherwise("ok")
    )


def quality_status(df: DataFrame, obs: DataFrame | None = None, *, series: Sequence[str], ts: str = "ts",
                   ranges: dict | None = None, limits: dict | None = None,
                   core: Sequence[str] = tuple(dims.CORE_WEATHER)) -> DataFrame:
    """Status per series and day: completeness, ranges, jumps and core weather keys.

    Everything is reduced to day tables before the joins.
    """
    keys = [*series, "day"]
    ranged = range_check(df, series=series, ts=ts, ranges=ranges).groupBy(*keys).agg(
        F.sum("outliers").alias("anomaly_count"),
        F.max(F.when(F.col("channel").isin("price", "load"), F.col("outliers"))).alias("price_load_outliers"))
    jumped = jump_check(df, series=series, ts=ts, limits=limits).groupBy(*keys).agg(
        F.max(F.when(F.col("channel") == "price", F.col("jumps"))).alias("price_jumps"))
    report = completeness(df, series=series, ts=ts).join(ranged, keys, "left").join(jumped, keys, "left")
    if obs is not None:
        starts = "^(" + "|".join(core) + ")_"
        worst = key_missing_rate(obs, ts=ts).where(F.col("key").rlike(starts)).groupBy("day").agg(
            F.max("missing_rate").alias("core_missing"),
            F.max(F.struct(F.col("missing_rate"), F.col("key")))["key"].alias("worst_key"))
        report = report.join(worst, "day", "left")
    else:
        report = report.withColumns({"core_missing": F.lit(None).cast("double"), "worst_key": F.lit(None).cast("string")})
    return report.select(
        *keys,
        status_of(F.col("completeness_pct"), F.col("price_load_outliers"), F.col("price_jumps"), F.col("core_missing")).alias("status"),
        "present", "completeness_pct", F.coalesce("anomaly_count", F.lit(0)).alias("anomaly_count"),
        F.coalesce("price_jumps", F.lit(0)).alias("price_jumps"), "core_missing", "worst_key")


def quality_log(report: DataFrame) -> DataFrame:
    """Log rows with the findings packed as JSON."""
    details = F.to_json(F.struct("present", "price_jumps", "core_missing", "worst_key"))
    keep = [c for c in report.columns if c not in {"day", "status", "completeness_pct", "anomaly_count", "present",
                                                   "price_jumps", "core_missing", "worst_key"}]
    return report.select(*keep, F.col("day").alias("check_date"), "status", "completeness_pct", "anomaly_count",
                         details.alias("details"))
