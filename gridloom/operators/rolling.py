"""Trailing statistics over a fixed number of grid rows.

Sums, means and deviations come from running totals inside a chunk and one lag
of them, so the cost per row does not depend on the width of the window. Maxima
come from running maxima of fixed blocks: a window of w rows is the end of one
block and the beginning of the next.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.timegrid import HOUR, QUARTER, col
from gridloom.operators.chunked import STEP, ChunkWindows, Phase, chunk_windows


@dataclass(frozen=True)
class Roll:
    """One trailing statistic: `fn` of `column` over `rows` rows.

    `lag=1` ends the window at the row before, `lag=0` at the row itself.
    Fewer than `min_rows` values give null.
    """

    name: str
    column: str
    rows: int
    fn: str                      # mean | std | sum | count | max | min
    lag: int = 1
    min_rows: int | None = None
    fill_first: bool = False     # use the row's own value while nothing came before

    @property
    def needed(self) -> int:
        if self.min_rows is not None:
            return self.min_rows
        return max(1, self.rows // 2) if self.fn in ("mean", "std") else 1

    @property
    def back(self) -> int:
        return self.rows + self.lag


def rolling_phases(rolls: Sequence[Roll]) -> list[Phase]:
    totals = [r for r in rolls if r.fn in ("mean", "std", "sum", "count")]
    peaks = [r for r in rolls if r.fn in ("max", "min")]
    plain = sorted({r.column for r in totals})
    squared = sorted({r.column for r in totals if r.fn == "std"})

    def centre(w: ChunkWindows) -> dict[str, Column]:
        # a whole number near the mean: keeps squares small, integers exact
        return {f"_mid_{c}": F.coalesce(F.round(F.avg(col(c)).over(w.whole)), F.lit(0.0)) for c in squared}

    def running(w: ChunkWindows) -> dict[str, Column]:
        upto = w.running
        out: dict[str, Column] = {}
        for c in plain:
            x = col(c).cast("double")
            out[f"_n_{c}"] = F.count(x).over(upto)
            out[f"_s_{c}"] = F.sum(F.coalesce(x, F.lit(0.0))).over(upto)
        for c in squared:
            d = col(c).cast("double") - col(f"_mid_{c}")
            out[f"_d_{c}"] = F.sum(F.coalesce(d, F.lit(0.0))).over(upto)
            out[f"_q_{c}"] = F.sum(F.coalesce(d * d, F.lit(0.0))).over(upto)
        return out

    def blocks(w: ChunkWindows) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for fn, c, rows in sorted({(r.fn, r.column, r.rows) for r in peaks}):
            agg = F.max if fn == "max" else F.min
            out[f"_head_{fn}_{c}_{rows}"] = agg(col(c)).over(w.block(rows))
            out[f"_tail_{fn}_{c}_{rows}"] = agg(col(c)).over(w.block(rows, descending=True))
        return out

    def finish(w: ChunkWindows) -> dict[str, Column]:
        return {r.name: _finish(r, w) for r in rolls}

    # block windows have their own sort order, the other phases share one
    return [blocks, centre, running, finish]


def _finish(r: Roll, w: ChunkWindows) -> Column:
    if r.fn in ("max", "min"):
        return _peak(r, w)

    def within(prefix: str) -> Column:
        total = col(f"{prefix}_{r.column}")
        upper = F.lag(total, r.lag).over(w.time) if r.lag else total
        lower = F.lag(total, r.lag + r.rows).over(w.time)
        return F.coalesce(upper, F.lit(0)) - F.coalesce(lower, F.lit(0))

    n = within("_n")
    if r.fn == "count":
        return n
    if r.fn == "sum":
        value = within("_s")
    elif r.fn == "mean":
        value = F.try_divide(within("_s"), n.cast("double"))
    else:
        d, q = within("_d"), within("_q")
        value = F.sqrt(F.greatest(F.try_divide(q - F.try_divide(d * d, n.cast("double")), (n - 1).cast("double")),
                                  F.lit(0.0)))
        value = F.when(n >= 2, value)
    value = F.when(n >= r.needed, value)
    return F.coalesce(value, col(r.column)) if r.fill_first else value


def _peak(r: Roll, w: ChunkWindows) -> Column:
    pick = F.greatest if r.fn == "max" else F.least
    head, tail = (col(f"_{side}_{r.fn}_{r.column}_{r.rows}") for side in ("head", "tail"))
    block = F.floor(F.col(STEP) / r.rows)
    at = lambda c, k: F.lag(c, k).over(w.time) if k else c
    start = r.lag + r.rows - 1
    first_block = F.first(block).over(w.running)
    first_tail = F.first(tail).over(w.running)
    # while the window reaches past the first row, it starts at that row
    early = F.when(first_block < at(block, r.lag), first_tail)
    left = F.when(at(F.col(STEP), start).isNull(), early).otherwise(at(tail, start))
    value = pick(at(head, r.lag), left)
    return F.coalesce(value, col(r.column)) if r.fill_first else value


def rolling(df: DataFrame, rolls: Sequence[Roll], *, series: Sequence[str], ts: str = "ts",
            minutes: int = QUARTER) -> DataFrame:
    """Add trailing statistics to a regular grid."""
    back = max(r.back for r in rolls)
    return chunk_windows(df, rolling_phases(rolls), series=series, ts=ts, back=back, minutes=minutes)


def hourly_rolling_sum(grid: DataFrame, hourly: DataFrame, sums: dict[str, tuple[str, int]], *,
                       series: Sequence[str], ts: str = "ts", minutes: int = QUARTER) -> DataFrame:
    """Sums over n hours, the current one included, taken on the hourly table.

    Summing a carried-forward fine column would count every hour several times.
    """
    from gridloom.functions.timegrid import step_index

    rolls = [Roll(name, c, hours, "sum", lag=0, min_rows=1) for name, (c, hours) in sums.items()]
    summed = rolling(hourly, rolls, series=series, ts=ts, minutes=HOUR)
    summed = summed.select(*series, step_index(col(ts), HOUR).alias("_hour"), *[col(n) for n in sums])
    return (
        grid.withColumn("_hour", step_index(col(ts), HOUR))
        .join(summed, [*series, "_hour"], "left").drop("_hour")
    )


def offset_window_phases(cols: Sequence[str], near: int, far: int) -> list[Phase]:
    """Shape of the rows t-far ... t-near: mean, std, trend, range, largest step, acceleration."""
    width = far - near + 1
    middle = (near + far) // 2

    def steps(w: ChunkWindows) -> dict[str, Column]:
        return {f"_jump_{c}": F.abs(col(c) - F.lag(col(c), 1).over(w.time)) for c in cols}

    def stats(w: ChunkWindows) -> dict[str, Column]:
        span, inner = w.rows(-far, -near), w.rows(-far + 1, -near)
        out: dict[str, Column] = {}
        for c in cols:
            full = F.count(col(c)).over(span) == width
            at = lambda k: F.lag(col(c), k).over(w.time)
            out[f"{c}_mean"] = F.when(full, F.avg(col(c)).over(span))
            out[f"{c}_std"] = F.when(full, F.stddev_pop(col(c)).over(span))
            out[f"{c}_trend"] = at(near) - at(far)
            out[f"{c}_range"] = F.when(full, F.max(col(c)).over(span) - F.min(col(c)).over(span))
            out[f"{c}_max_step"] = F.when(full, F.max(col(f"_jump_{c}")).over(inner))
            out[f"{c}_accel"] = at(near) - at(middle) * 2 + at(far)
        return out

    return [steps, stats]


def offset_window_stats(df: DataFrame, cols: Sequence[str], *, series: Sequence[str], near: int = 192,
                        far: int = 200, ts: str = "ts", minutes: int = QUARTER) -> DataFrame:
    return chunk_windows(df, offset_window_phases(cols, near, far), series=series, ts=ts, back=far + 1,
                         minutes=minutes)
