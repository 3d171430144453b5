"""Wall-clock arithmetic on a fixed time grid.

Timestamps are TIMESTAMP_NTZ. A *step* is the number of whole grid intervals
since 1970-01-01, a BIGINT, so shifting, chunking and joining in time are
integer operations and do not depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUARTER = 15
HOUR = 60


def steps_per_day(minutes: int = QUARTER) -> int:
    if 1440 % minutes:
        raise ValueError("a grid interval must divide one day")
    return 1440 // minutes


def col(name: str) -> Column:
    """Column by literal name, also for names such as `B_solar[t]`."""
    return F.col("`" + name.replace("`", "``") + "`")


def step_index(ts: Column, minutes: int = QUARTER) -> Column:
    within = F.floor((F.hour(ts) * 60 + F.minute(ts)) / F.lit(minutes))
    return (F.unix_date(F.to_date(ts)).cast("bigint") * steps_per_day(minutes) + within).cast("bigint")


def step_day(step: Column, minutes: int = QUARTER) -> Column:
    """Days since 1970-01-01 of a step."""
    return F.floor(step / F.lit(steps_per_day(minutes))).cast("int")


def step_period(step: Column, minutes: int = QUARTER) -> Column:
    """Position of a step inside its day, from 0."""
    return F.pmod(step, F.lit(steps_per_day(minutes))).cast("int")


def step_time(step: Column, minutes: int = QUARTER) -> Column:
    midnight = F.date_from_unix_date(step_day(step, minutes)).cast("timestamp_ntz")
    offset = (step_period(step, minutes) * F.lit(minutes)).cast("int")
    return midnight + F.make_dt_interval(F.lit(0), F.lit(0), offset)


def floor_time(ts: Column, minutes: int = QUARTER) -> Column:
    return step_time(step_index(ts, minutes), minutes)


def hour_of(step: Column, minutes: int = QUARTER) -> Column:
    """Hour step that holds a finer step."""
    return F.floor(step / F.lit(HOUR // minutes)).cast("bigint")


def shift_minutes(ts: Column, minutes: int) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))


def finite(c: Column) -> Column:
    """The number, null where it is NaN or infinite: missing is null everywhere in this library."""
    return F.when(F.abs(c) < float("inf"), c)
