"""Lags, leads, differences and the grid-lag mode.

Two methods with equal results on a regular grid: `window` (one shuffle on
series and time chunk) and `join` (equi-join on the shifted step, also right on
a grid with gaps). Edges are null; nothing wraps around.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.timegrid import QUARTER, col, step_index
from gridloom.operators.chunked import ChunkWindows, chunk_windows

Shift = tuple[str, int]  # column, steps back (negative: ahead)


def lag_by(df: DataFrame, shifts: Mapping[str, Shift], *, series: Sequence[str], ts: str = "ts",
           minutes: int = QUARTER, method: str = "window") -> DataFrame:
    """Add columns holding the value a number of steps away."""
    if method == "join":
        return _lag_join(df, shifts, series, ts, minutes)
    if method != "window":
        raise ValueError(f"unknown method {method!r}")
    back = max([k for _, k in shifts.values()] + [0])
    ahead = max([-k for _, k in shifts.values()] + [0])
    phase = lambda w: {out: F.lag(col(c), k).over(w.time) if k >= 0 else F.lead(col(c), -k).over(w.time)
                       for out, (c, k) in shifts.items()}
    return chunk_windows(df, [phase], series=series, ts=ts, back=back, ahead=ahead, minutes=minutes)


def _lag_join(df: DataFrame, shifts: Mapping[str, Shift], series: Sequence[str], ts: str,
              minutes: int) -> DataFrame:
    by_steps: dict[int, list[tuple[str, str]]] = {}
    for out, (c, k) in shifts.items():
        by_steps.setdefault(k, []).append((out, c))
    result = df.withColumn("_step", step_index(col(ts), minutes))
    for k, pairs in by_steps.items():
        moved = df.select(
            *[col(s) for s in series],
            (step_index(col(ts), minutes) + k).alias("_step"),
            *[col(c).alias(out) for out, c in pairs],
        )
        result = result.join(moved, [*series, "_step"], "left")
    return result.drop("_step")


def lead_by(df: DataFrame, leads: Mapping[str, Shift], *, series: Sequence[str], ts: str = "ts",
            minutes: int = QUARTER, method: str = "join") -> DataFrame:
    """Value a number of steps ahead (96 steps = the day-ahead target)."""
    return lag_by(df, {o: (c, -k) for o, (c, k) in leads.items()}, series=series, ts=ts,
                  minutes=minutes, method=method)


def change(x: str, k: int) -> "callable":
    """x[t] - x[t-k]."""
    return lambda w: col(x) - F.lag(col(x), k).over(w.time)


def acceleration(x: str, k: int) -> "callable":
    """x[t] - 2 x[t-k] + x[t-2k]."""
    return lambda w: col(x) - F.lag(col(x), k).over(w.time) * 2 + F.lag(col(x), 2 * k).over(w.time)


def ramp(x: str) -> "callable":
    """One-step change, 0 at the first row."""
    return lambda w: F.coalesce(col(x) - F.lag(col(x), 1).over(w.time), F.lit(0.0))


def diffs(df: DataFrame, exprs: Mapping[str, "callable"], *, series: Sequence[str], back: int,
          ts: str = "ts", minutes: int = QUARTER) -> DataFrame:
    phase = lambda w: {name: make(w) for name, make in exprs.items()}
    return chunk_windows(df, [phase], series=series, ts=ts, back=back, minutes=minutes)


def grid_lag_phase(cols: Sequence[str], steps: int):
    """Phase that replaces channels by their value `steps` ago, originals kept as `*_orig`."""
    def phase(w: ChunkWindows) -> dict[str, Column]:
        kept = {f"{c}_orig": col(c) for c in cols}
        return {**kept, **{c: F.lag(col(c), steps).over(w.time) for c in cols}}
    return phase


def grid_lag(df: DataFrame, cols: Sequence[str], steps: int, *, series: Sequence[str],
             ts: str = "ts", minutes: int = QUARTER) -> DataFrame:
    """Channels as published `steps` late; `{c}_orig` keeps the value for targets."""
    if steps <= 0:
        return df.withColumns({f"{c}_orig": col(c) for c in cols})
    return chunk_windows(df, [grid_lag_phase(cols, steps)], series=series, ts=ts, back=steps,
                         minutes=minutes)
