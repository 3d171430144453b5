"""Runs of equal values, day-over-day breaks, sessions: the checks that look along a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.timegrid import QUARTER, col, step_index, step_time, steps_per_day
from gridloom.operators.chunked import CHUNK, CHUNK_DAYS, STEP
from gridloom.operators.shift import lag_by


def frozen_runs(df: DataFrame, cols: Sequence[str], *, series: Sequence[str], ts: str = "ts", min_rows: int = 6, minutes: int = QUARTER,
                chunk_days: int = CHUNK_DAYS) -> DataFrame:
    """(series, channel, value, first_ts, last_ts, n): runs of at least `min_rows` equal values at consecutive steps.

    Runs are found inside (series, channel, time chunk). Only those that touch a
    chunk's border, at most two of a chunk, are put in order along the series and
    joined where value and step go on, so a run may cover any number of chunks
    and no window holds a series' rows. A null or a missing step ends a run; a
    null series is a series.
    """
    size = steps_per_day(minutes) * chunk_days
    keys = [*series, "channel"]
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), col(c).cast("double").alias("value")) for c in cols])).alias("_v")
    long = df.select(*[col(s) for s in series], step_index(col(ts), minutes).alias(STEP), named).select(*series, STEP, "_v.channel", "_v.value")
    chunked = long.where(F.col("value").isNotNull()).withColumn(CHUNK, F.floor(F.col(STEP) / size))
    inside = Window.partitionBy(*keys, CHUNK).orderBy(STEP)
    same = (F.lag(STEP).over(inside) == F.col(STEP) - 1) & (F.lag("value").over(inside) == F.col("value"))
    numbered = chunked.withColumn("_new", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn(
        "_run", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy(*keys, CHUNK, "_run").agg(F.min("value").alias("value"), F.min(STEP).alias("_from"), F.max(STEP).alias("_to"))
    at_border = (F.pmod("_from", F.lit(size)) == 0) | (F.pmod("_to", F.lit(size)) == size - 1)
    order = Window.partitionBy(*keys).orderBy("_from")  # two rows a chunk at most
    goes_on = (F.lag("_to").over(order) == F.col("_from") - 1) & (F.lag("value").over(order) == F.col("value"))
    border = runs.where(at_border).withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn(
        "_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    stitched = border.groupBy(*keys, "_run").agg(F.min("value").alias("value"), F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    fields = [*keys, "value", "_from", "_to"]
    every = runs.where(~at_border).select(*fields).unionByName(stitched.select(*fields))
    long_enough = every.withColumn("n", F.col("_to") - F.col("_from") + 1).where(F.col("n") >= min_rows)
    return long_enough.select(*keys, "value", step_time(F.col("_from"), minutes).alias("first_ts"), step_time(F.col("_to"), minutes).alias("last_ts"), "n")


def sigma_breaks(df: DataFrame, c: str, *, series: Sequence[str], ts: str = "ts", sigmas: float = 5.0, minutes: int = QUARTER) -> DataFrame:
    """(series, ts, value, previous, sigma): steps whose change to the same time of the day before is beyond `sigmas` deviations of such changes.

    The deviation of a series is folded from one row per (series, month); it comes
    back by (series, month), so the rows of a long series keep apart.
    """
    day_ago = lag_by(df.select(*[col(s) for s in series], col(ts).alias(ts), col(c).cast("double").alias("value")), {"previous": ("value", steps_per_day(minutes))}, series=series, ts=ts)
    rows = day_ago.withColumns({"_change": F.col("value") - F.col("previous"), "_month": F.trunc(F.to_date(col(ts)), "month")})
    keys = [*series, "_month"]
    parts = rows.where(F.col("_change").isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n"), F.avg("_change").alias("_mean"), F.var_pop("_change").alias("_var"))
    whole = Window.partitionBy(*series)  # a row per month
    total = F.sum("_n").over(whole)
    mean = F.sum(F.col("_n") * F.col("_mean")).over(whole) / total
    spread = parts.withColumns({"_total": total, "_centre": mean}).withColumn(
        "_squares", F.sum(F.col("_n") * (F.col("_var") + F.pow(F.col("_mean") - F.col("_centre"), 2))).over(whole))
    sigma = spread.select(*[col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.when(F.col("_total") > 1, F.sqrt(F.col("_squares") / (F.col("_total") - 1))).alias("sigma"))
    on = [col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return rows.join(sigma, on).where(F.abs("_change") > F.col("sigma") * sigmas).select(*series, ts, "value", "previous", "sigma")


def sessions(df: DataFrame, *, keys: Sequence[str] = (), ts: str = "fetch_time", gap: str = "6 hours", event_time: str | None = None) -> DataFrame:
    """(keys, first, last, n): arrivals that follow one another within `gap`; on a stream, `event_time` names the column with the watermark."""
    grouped = df.groupBy(*[col(k) for k in keys], F.session_window(event_time or col(ts).cast("timestamp"), gap))
    # the window ends a gap after the last arrival
    last = F.col("session_window.end").cast("timestamp_ntz") - F.expr(f"INTERVAL {gap}")
    return grouped.agg(F.count("*").alias("n")).select(*keys, F.col("session_window.start").cast("timestamp_ntz").alias("first"), last.alias("last"), "n")


def stale_spans(found: DataFrame, *, keys: Sequence[str] = (), as_of=None) -> DataFrame:
    """(keys, stale_from, until, hours): what lies between two sessions, and after the last one up to `as_of`."""
    order = Window.partitionBy(*keys).orderBy("first")  # a row a session
    until = F.lead("first").over(order)
    rows = found.withColumn("until", F.coalesce(until, as_of) if as_of is not None else until)
    hours = (F.unix_micros(F.col("until").cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / F.lit(3.6e9)
    return rows.where(F.col("until") > F.col("last")).select(*keys, F.col("last").alias("stale_from"), "until", hours.alias("hours"))
