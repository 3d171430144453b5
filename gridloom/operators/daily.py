"""Day-shape operators: morning snapshot, previous-day curve, diurnal range.

The statistics are written once over an `agg` wrapper: the identity gives
grouped aggregates, `lambda a: a.over(window)` the same numbers on every row.
A statistic over a range of slots is null unless every slot of it has a value.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.calendar import period
from gridloom.functions.timegrid import QUARTER, col, step_index, step_period, steps_per_day
from gridloom.operators.quantiles import join_few

Wrap = Callable[[Column], Column]
SLOTS = 96
MORNING_END = 34   # 08:30
RAMP_START = 24    # 06:00


class SlotStats:
    """Aggregates over slot ranges of one day."""

    def __init__(self, value: Column, p: Column, agg: Wrap):
        self.value, self.p, self.agg = value, p, agg

    def part(self, fn: Callable[[Column], Column], where: Column, slots: int) -> Column:
        chosen = F.when(where, self.value)
        return F.when(self.agg(F.count(chosen)) == slots, self.agg(fn(chosen)))

    def full(self, fn: Callable[[Column], Column]) -> Column:
        return self.part(fn, self.p >= 0, SLOTS)

    def at(self, slot: int) -> Column:
        return self.agg(F.max(F.when(self.p == slot, self.value)))

    def between(self, fn: Callable[[Column], Column], lo: int, hi: int) -> Column:
        return self.part(fn, self.p.between(lo, hi), hi - lo + 1)


def morning_stats(value: Column, p: Column, agg: Wrap) -> dict[str, Column]:
    s = SlotStats(value, p, agg)
    return {
        "mean": s.between(F.avg, 0, MORNING_END),
        "last": s.at(MORNING_END),
        "ramp": s.at(MORNING_END) - s.at(RAMP_START),
        "std": s.between(F.stddev_pop, 0, MORNING_END),
    }


def curve_stats(value: Column, p: Column, agg: Wrap, ops: Sequence[str]) -> dict[str, Column]:
    s = SlotStats(value, p, agg)
    high = lambda lo, hi: s.between(F.max, lo, hi)
    complete = agg(F.count(value)) == SLOTS
    known: dict[str, Callable[[], Column]] = {
        "peak": lambda: s.full(F.max),
        "mean": lambda: s.full(F.avg),
        "range": lambda: s.full(F.max) - s.full(F.min),
        "std": lambda: s.full(F.stddev_pop),
        "total": lambda: s.full(F.sum),
        "night_mean": lambda: s.part(F.avg, (p < 20) | (p >= 88), 28),
        "daytime_mean": lambda: s.between(F.avg, 28, 75),
        "ramp_up": lambda: high(28, 75) - s.at(28),
        "duration": lambda: F.when(complete, agg(F.count(F.when(value > 100, 1))).cast("double")),
        "morning_peak": lambda: high(20, 35),
        "evening_peak": lambda: high(68, 87),
        "valley": lambda: s.between(F.min, 40, 67),
        "peak_ratio": lambda: F.when(high(20, 35) > 0, high(68, 87) / (high(20, 35) + 1)).when(
            high(20, 35).isNotNull() & high(68, 87).isNotNull(), F.lit(0.0)),
    }
    return {op: known[op]() for op in ops}


CURVE_OPS = ["peak", "mean", "range", "std", "total", "night_mean", "daytime_mean", "ramp_up", "duration",
             "morning_peak", "evening_peak", "valley", "peak_ratio"]


def _per_day(df: DataFrame, aggs: dict[str, Column], series: Sequence[str], ts: str) -> DataFrame:
    day = F.to_date(col(ts)).alias("day")
    return df.groupBy(*[col(s) for s in series], day).agg(*[a.alias(n) for n, a in aggs.items()])


def morning_snapshot(df: DataFrame, cols: Sequence[str], *, series: Sequence[str], ts: str = "ts") -> DataFrame:
    """One row per series and day: mean, last, ramp and deviation of slots 0-34."""
    aggs = {f"morning_{op}_{c}": e for c in cols
            for op, e in morning_stats(col(c), period(col(ts)), lambda a: a).items()}
    return _per_day(df, aggs, series, ts)


def day_curve_stats(df: DataFrame, specs: dict[str, Sequence[str]], *, series: Sequence[str],
                    ts: str = "ts") -> DataFrame:
    """One row per series and day with the requested curve statistics."""
    aggs = {f"{c}_{op}": e for c, ops in specs.items()
            for op, e in curve_stats(col(c), period(col(ts)), lambda a: a, ops).items()}
    return _per_day(df, aggs, series, ts)


def prev_day_curve(df: DataFrame, specs: dict[str, Sequence[str]], *, series: Sequence[str],
                   ts: str = "ts") -> DataFrame:
    """Curve statistics of the day before, one row per series and day of the input.

    Both sides are day tables, 1/96 of the grid, joined by shifting the date.
    """
    stats = day_curve_stats(df, specs, series=series, ts=ts)
    names = [c for c in stats.columns if c not in {*series, "day"}]
    before = stats.select(*series, F.date_add("day", 1).alias("day"), *[col(n).alias(f"d2_{n}") for n in names])
    return stats.select(*series, "day").join(before, [*series, "day"], "left")


def diurnal_range(df: DataFrame, c: str, out: str, *, series: Sequence[str], ts: str = "ts") -> DataFrame:
    """Spread between the day's extremes on every row of the day."""
    w = Window.partitionBy(*series, F.to_date(col(ts)))
    return df.withColumn(out, F.max(col(c)).over(w) - F.min(col(c)).over(w))


def attach_day(df: DataFrame, per_day: DataFrame, *, series: Sequence[str], ts: str = "ts") -> DataFrame:
    """Join day-level columns back to the rows of the day."""
    return df.withColumn("day", F.to_date(col(ts))).join(per_day, [*series, "day"], "left").drop("day")


def last_day(df: DataFrame, *, series: Sequence[str], ts: str = "ts", minutes: int = QUARTER) -> DataFrame:
    """Rows within 24 hours of the last row of each series."""
    step = step_index(col(ts), minutes)
    ends = df.groupBy(*[col(s) for s in series]).agg(F.max(step).alias("_end"))
    joined = join_few(df, ends, series, spread=[ts])
    return joined.where(step > F.col("_end") - steps_per_day(minutes)).drop("_end")
