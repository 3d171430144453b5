"""Feature tables that follow their grid: only what new or corrected days can change is computed again.

A ledger holds the finished (series, day) with a mark of the rows they were
computed from. Days that are missing there, or whose mark differs, are pending.
A pending day changes the features of the days up to `back` steps after it and
`ahead` steps before it; to compute those, the grid is read another `back` and
`ahead` steps around. Months outside are not scanned, partitions of other days
not written.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.timegrid import QUARTER, col, steps_per_day
from gridloom.session import materialise
from gridloom.sources.store import exists, append_log, latest_per_key, overwrite_partitions

MONTH, DAY = "month", "day"


def write_grid(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Add rows to a grid table with a directory per month."""
    df.withColumn(MONTH, F.date_format(col(ts), "yyyy-MM")).write.mode("append").partitionBy(MONTH).parquet(path)


def _months(first: date | None, last: date | None) -> Column:
    month = F.col(MONTH).cast("string")
    low = month >= f"{first:%Y-%m}" if first else F.lit(True)
    return low & (month <= f"{last:%Y-%m}") if last else low


def _grid(spark: SparkSession, path: str, ts: str, first: date | None = None, last: date | None = None) -> DataFrame:
    """Rows of whole days; the month is a literal filter, so the scan lists only its directories."""
    rows = spark.read.parquet(path).where(_months(first, last)).withColumn(DAY, F.to_date(col(ts)))
    rows = rows.where(F.col(DAY) >= F.lit(first)) if first else rows
    return rows.where(F.col(DAY) <= F.lit(last)) if last else rows


def _matched(df: DataFrame, named: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join; null keys match."""
    held = named.select(*[col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    return df.join(held, reduce(and_, [col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]), how)


def _around(days: DataFrame, series: Sequence[str], before: int, after: int) -> DataFrame:
    spread = F.explode(F.sequence(F.date_sub(DAY, before), F.date_add(DAY, after)))
    return days.select(*[col(s) for s in series], spread.alias(DAY)).distinct()


def pending_days(spark: SparkSession, grid_path: str, ledger_path: str, *, series: Sequence[str], ts: str = "ts", recheck_days: int = 35) -> DataFrame:
    """(series, day, n, mark) of days that the ledger lacks or knows with other rows.

    Days up to `recheck_days` before the ledger's last are looked at again for
    corrections; earlier months are not scanned.
    """
    known = exists(spark, ledger_path)
    first = None
    if known:
        last = spark.read.parquet(ledger_path).agg(F.max(DAY)).first()[0]  # one value
        first = last - timedelta(days=recheck_days) if last else None
    rows = _grid(spark, grid_path, ts, first)
    content = [col(c) for c in rows.columns if c not in {*series, MONTH, DAY}]
    marks = rows.groupBy(*[col(s) for s in series], DAY).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*content)).alias("mark"))
    if not known:
        return marks
    done = latest_per_key(spark.read.parquet(ledger_path), [*series, DAY], F.col("finished_at")).select(*series, DAY, "n", "mark")
    return _matched(marks, done, [*series, DAY, "n", "mark"], "left_anti")


def refresh(spark: SparkSession, grid_path: str, feature_path: str, ledger_path: str, build: Callable[[DataFrame], DataFrame], *, series: Sequence[str] = ("series_id",),
            ts: str = "ts", back: int, ahead: int = 0, minutes: int = QUARTER, recheck_days: int = 35) -> DataFrame:
    """Bring a feature table up to its grid; returns the pending days that were handled.

    `build` maps a regular grid to features of the same (series, ts) and looks at
    most `back` steps back and `ahead` steps ahead. The features lie in a directory
    per day; series that nothing changed for keep their rows there. The ledger is
    written last: a run that died in between is done again with the same result.
    """
    series, days = list(series), [*series, DAY]
    pending = materialise(pending_days(spark, grid_path, ledger_path, series=series, ts=ts, recheck_days=recheck_days), "pending")
    span = pending.agg(F.min(DAY), F.max(DAY)).first()  # two dates
    if span[0] is None:
        return pending
    per_day = steps_per_day(minutes)
    back_days, ahead_days = -(-back // per_day), -(-ahead // per_day)
    changed = _around(pending, series, ahead_days, back_days)
    needed = _around(changed, series, back_days, ahead_days)
    first, last = span[0] - timedelta(days=ahead_days), span[1] + timedelta(days=back_days)
    around = _grid(spark, grid_path, ts, first - timedelta(days=back_days), last + timedelta(days=ahead_days))
    built = build(_matched(around, needed, days, "left_semi").drop(DAY, MONTH))
    fresh = _matched(built.withColumn(DAY, F.to_date(col(ts))), changed, days, "left_semi")
    if exists(spark, feature_path):
        fresh = materialise(fresh, "features")
        table = spark.read.parquet(feature_path).where(F.col(DAY).between(F.lit(first), F.lit(last)))
        touched = table.join(fresh.select(DAY).distinct(), DAY, "left_semi")
        kept = _matched(touched, changed, days, "left_anti").select(*[col(c) for c in fresh.columns])
        fresh = materialise(fresh.unionByName(kept), "merged")
    overwrite_partitions(fresh, feature_path, [DAY])
    append_log(pending.withColumn("finished_at", F.current_timestamp()), ledger_path)
    return pending
