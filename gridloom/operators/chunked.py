"""Windows over long series, cut into time chunks of bounded size.

`Window.partitionBy(series)` puts a whole series into one task. Here rows are
grouped by (series, time chunk); a row is copied into a neighbouring chunk when
it lies within the look-back or look-ahead of that chunk. On a regular grid a
group has at most `chunk + back + ahead` rows, however long the series is or
however few series there are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gridloom.functions.timegrid import QUARTER, col, step_index, steps_per_day

STEP, CHUNK = "_step", "_chunk"
CHUNK_DAYS = 56

Phase = Callable[["ChunkWindows"], dict[str, Column]]


class ChunkWindows:
    """Window specifications available to the expressions of one pass."""

    def __init__(self, series: Sequence[str], per_day: int):
        self.series = list(series)
        self.per_day = per_day
        self.keys = [*self.series, CHUNK]
        self._frames: dict[tuple, WindowSpec] = {}

    @cached_property
    def time(self) -> WindowSpec:
        """Rows of the chunk in time order."""
        return Window.partitionBy(*self.keys).orderBy(STEP)

    @cached_property
    def whole(self) -> WindowSpec:
        """All rows of the chunk; keeps the time order, so no other sort is needed."""
        return self.time.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    @cached_property
    def day(self) -> WindowSpec:
        """Rows of one day; days never straddle chunks."""
        return Window.partitionBy(*self.keys, F.floor(F.col(STEP) / self.per_day))

    def rows(self, first: int, last: int) -> WindowSpec:
        """Time order, framed by row offsets."""
        return self._keep(("rows", first, last), lambda: self.time.rowsBetween(first, last))

    @cached_property
    def running(self) -> WindowSpec:
        return self.time.rowsBetween(Window.unboundedPreceding, 0)

    def block(self, rows: int, descending: bool = False) -> WindowSpec:
        """Running frame inside fixed blocks of `rows` steps."""
        order = F.col(STEP).desc() if descending else F.col(STEP).asc()
        return self._keep(("block", rows, descending), lambda: (
            Window.partitionBy(*self.keys, F.floor(F.col(STEP) / rows)).orderBy(order)
            .rowsBetween(Window.unboundedPreceding, 0)))

    def lag(self, c: str, k: int) -> Column:
        return F.lag(col(c), k).over(self.time)

    def _keep(self, key: tuple, make: Callable[[], WindowSpec]) -> WindowSpec:
        if key not in self._frames:
            self._frames[key] = make()
        return self._frames[key]


def chunk_windows(
    df: DataFrame,
    phases: Sequence[Phase],
    *,
    series: Sequence[str],
    ts: str = "ts",
    back: int = 0,
    ahead: int = 0,
    minutes: int = QUARTER,
    chunk_days: int = CHUNK_DAYS,
    keep_temp: bool = False,
) -> DataFrame:
    """Add window columns to a regular grid, one shuffle for all of them.

    `phases` are applied in order, each may read the columns of the ones before.
    Columns whose names start with `_` are dropped at the end. `back` and `ahead`
    are the number of steps an expression may look away from its row.
    """
    per_day = steps_per_day(minutes)
    size = per_day * chunk_days
    back = -(-back // per_day) * per_day      # whole days, so day windows stay complete
    ahead = -(-ahead // per_day) * per_day
    step = F.col(STEP)
    own = F.floor(step / size)
    out = df.withColumn(STEP, step_index(col(ts), minutes))
    if back or ahead:
        first = F.floor((step - ahead) / size)
        last = F.floor((step + back) / size)
        out = out.withColumn(CHUNK, F.explode(F.sequence(first, last)))
    else:
        out = out.withColumn(CHUNK, own)
    windows = ChunkWindows(series, per_day)
    for phase in phases:
        new = phase(windows)
        if new:
            out = out.withColumns(new)
    out = out.where(F.col(CHUNK) == own)
    if not keep_temp:
        out = out.select(*[col(c) for c in out.columns if not c.startswith("_")])
    return out
