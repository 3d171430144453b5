"""Leakage-safe time splits and folds."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom import dims
from gridloom.functions.calendar import season
from gridloom.functions.timegrid import QUARTER, col, step_index, steps_per_day

ROLLING_DAYS = 7


def split_assign(df: DataFrame, *, label: str, windows: Sequence[dims.SplitWindow], ts: str = "ts",
                 rolling_days: int = ROLLING_DAYS, as_of: date | None = None) -> DataFrame:
    """Add `season`, `split` (train, val, test, rolling or null) and `is_rolling`.

    The last labelled days, up to `as_of` if given, form the rolling test; labelled days between the end
    of the fixed test window and those days join the training rows. Windows cover
    whole days. `is_rolling` also marks rolling rows inside a fixed validation or
    test window, where `split` names the fixed window.
    """
    day = F.to_date(col(ts))
    known = col(label).isNotNull() if as_of is None else col(label).isNotNull() & (day <= F.lit(as_of))
    newest = df.where(known).agg(F.max(day).alias("_newest"))
    out = df.withColumn("season", season(col(ts))).crossJoin(F.broadcast(newest))  # one row
    start = F.date_sub(F.col("_newest"), rolling_days - 1)
    split = F.lit(None).cast("string")
    for w in windows:
        inside = lambda span: day.between(F.lit(span[0]), F.lit(span[1]))
        rolling = day.between(start, F.col("_newest"))
        later = (day > F.lit(w.test[1])) & (day < start)
        split = F.when(
            F.col("season") == w.season,
            F.when(inside(w.val), "val").when(inside(w.test), "test").when(rolling, "rolling")
            .when(inside(w.train) | later, "train"),
        ).otherwise(split)
    labelled = col(label).isNotNull()
    in_rolling = labelled & F.col("season").isin([w.season for w in windows]) & day.between(start, F.col("_newest"))
    return out.withColumns({
        "split": F.when(labelled, split), "is_rolling": F.coalesce(in_rolling, F.lit(False)),
    }).drop("_newest")


def time_positions(df: DataFrame, *, by: Sequence[str] = (), ts: str = "ts", minutes: int = QUARTER) -> DataFrame:
    """Position of every distinct time of a group and the number of times.

    Counted per day first; days are then accumulated and times numbered inside
    their day, so no task holds more than one group's days or one day's times.
    """
    per_day = steps_per_day(minutes)
    times = df.select(*[col(b) for b in by], step_index(col(ts), minutes).alias("_step")).distinct()
    times = times.withColumn("_day", F.floor(F.col("_step") / per_day))
    days = times.groupBy(*by, "_day").agg(F.count("*").alias("_in_day"))
    before = Window.partitionBy(*by).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumns({
        "_before": F.coalesce(F.sum("_in_day").over(before), F.lit(0)),
        "n_times": F.sum("_in_day").over(Window.partitionBy(*by)),
    })
    inside = Window.partitionBy(*by, "_day").orderBy("_step")
    return times.join(days.drop("_in_day"), [*by, "_day"]).select(
        *by, "_step", (F.col("_before") + F.row_number().over(inside) - 1).alias("position"), "n_times")


def time_folds(df: DataFrame, k: int, *, by: Sequence[str] = (), ts: str = "ts", minutes: int = QUARTER,
               head: float = 0.85) -> DataFrame:
    """Expanding-window folds and a chronological early-stopping flag.

    `fold` i (0 ... k-1) is the test part of fold i, which trains on everything
    before it; the first block, never tested, has fold -1. `is_late` marks the
    last rows, held out while the final model is fitted. Rows of one time always
    fall together.
    """
    pos = time_positions(df, by=by, ts=ts, minutes=minutes)
    size = F.floor(F.col("n_times") / (k + 1))
    first = F.col("n_times") - size * k
    fold = F.when(F.col("position") < first, F.lit(-1)).otherwise(F.floor((F.col("position") - first) / size)).cast("int")
    pos = pos.withColumns({"fold": fold, "is_late": F.col("position") >= F.floor(F.col("n_times") * head)})
    keyed = df.withColumn("_step", step_index(col(ts), minutes))
    return keyed.join(pos.select(*by, "_step", "position", "fold", "is_late"), [*by, "_step"], "left").drop("_step")
