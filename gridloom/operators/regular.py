"""Regular grids: binning, spines, carry-forward, resampling, extension."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.timegrid import HOUR, QUARTER, col, step_index, step_time, steps_per_day
from gridloom.operators.chunked import CHUNK, CHUNK_DAYS, STEP, chunk_windows


def bin_rows(df: DataFrame, aggs: Mapping[str, Column], *, series: Sequence[str], ts: str = "ts",
             minutes: int = QUARTER) -> DataFrame:
    """One row per series and grid interval; combines on the map side first."""
    step = step_index(col(ts), minutes).alias(STEP)
    binned = df.groupBy(*[col(s) for s in series], step).agg(*[a.alias(n) for n, a in aggs.items()])
    return binned.withColumn(ts, step_time(F.col(STEP), minutes)).select(
        *series, ts, *[col(n) for n in aggs]
    )


def step_bounds(df: DataFrame, *, series: Sequence[str], ts: str = "ts", minutes: int = QUARTER) -> DataFrame:
    """First and last step of each series."""
    step = step_index(col(ts), minutes)
    return df.groupBy(*[col(s) for s in series]).agg(F.min(step).alias("_lo"), F.max(step).alias("_hi"))


def spine(bounds: DataFrame, *, series: Sequence[str], minutes: int = QUARTER) -> DataFrame:
    """All steps between the bounds, day by day so that no row holds a whole series."""
    per_day = steps_per_day(minutes)
    days = bounds.withColumn(
        "_day", F.explode(F.sequence(F.floor(F.col("_lo") / per_day), F.floor(F.col("_hi") / per_day)))
    )
    first = F.greatest(F.col("_lo"), F.col("_day") * per_day)
    last = F.least(F.col("_hi"), F.col("_day") * per_day + (per_day - 1))
    return days.select(*series, F.explode(F.sequence(first, last)).alias(STEP))


def _quoted(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


#: The chunk of rows without a time, before all others, as null would be.
_NO_CHUNK = -(1 << 63)


def _chunk(size: int) -> Column:
    """Time chunk of a step, never null: a join on it asks no row whether it has one.

    That question would be moved below an aggregate that made the rows, with the
    arithmetic from its input's time to the chunk written out many times over.
    """
    return F.coalesce(F.floor(F.col(STEP) / size), F.lit(_NO_CHUNK))


def _with_next(df: DataFrame, values: Sequence[str], series: Sequence[str], ts: str, minutes: int, chunk_days: int,
               fill: Sequence[str]) -> DataFrame:
    """Rows with their step, the step of the next row of the series (`_next`) and, for the
    columns in `fill`, the last known value.

    Works chunk by chunk; what crosses a chunk (its first step, its last values)
    is taken from a summary with one row per series and chunk. A row without a
    time has no step, and `_cover` repeats it for none; its values come before
    the first step's.
    """
    size = steps_per_day(minutes) * chunk_days
    base = df.select(*series, step_index(col(ts), minutes).alias(STEP), *[col(c) for c in values]).withColumn(CHUNK, _chunk(size))
    keys = [*series, CHUNK]
    summary = base.groupBy(*keys).agg(F.min(STEP).alias("_first"), *[
        F.expr(f"max(CASE WHEN {_quoted(c)} IS NOT NULL THEN struct({STEP}, {_quoted(c)} AS v) END) AS `_end_{c}`") for c in fill])
    by = "PARTITION BY " + ", ".join(_quoted(k) for k in series) if series else ""
    before = f"({by} ORDER BY {CHUNK} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    around = summary.selectExpr(
        *[_quoted(k) for k in keys], f"lead(_first) OVER ({by} ORDER BY {CHUNK}) AS _after",
        *[f"last(`_end_{c}`, true) OVER {before}.v AS `_carry_{c}`" for c in fill])
    inside = f"PARTITION BY {', '.join(_quoted(k) for k in keys)} ORDER BY {STEP}"
    filled = set(fill)
    known = lambda c: (f"coalesce(last({_quoted(c)}, true) OVER ({inside} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), `_carry_{c}`) "
                       f"AS {_quoted(c)}") if c in filled else _quoted(c)
    return base.join(around, keys).selectExpr(
        *[_quoted(k) for k in series], STEP, f"coalesce(lead({STEP}) OVER ({inside}), _after) AS _next", *[known(c) for c in values])


def _cover(rows: DataFrame, values: Sequence[str], series: Sequence[str], ts: str, minutes: int, keep_values: bool) -> DataFrame:
    """Repeat each row for the steps up to the next one; rows that share a step each keep it."""
    steps = rows.withColumn("_at", F.explode(F.sequence(F.col(STEP), F.greatest(F.col("_next") - 1, F.col(STEP)))))
    value = (lambda c: _quoted(c)) if keep_values else (
        lambda c: f"CASE WHEN _at = {STEP} THEN {_quoted(c)} END AS {_quoted(c)}")
    out = steps.selectExpr(*[_quoted(s) for s in series], "_at", *[value(c) for c in values])
    return out.select(*series, step_time(F.col("_at"), minutes).alias(ts), *[col(c) for c in values])


def regularize(df: DataFrame, *, series: Sequence[str], ts: str = "ts", minutes: int = QUARTER,
               chunk_days: int = CHUNK_DAYS) -> DataFrame:
    """Every step from the first to the last row of each series, null where absent.

    `df` has at most one row per series and step. A row yields the empty steps
    that follow it, so there is no spine to build and join.
    """
    values = [c for c in df.columns if c not in {*series, ts}]
    rows = _with_next(df, values, series, ts, minutes, chunk_days, fill=[])
    return _cover(rows, values, series, ts, minutes, keep_values=False)


def densify(df: DataFrame, *, series: Sequence[str], ts: str = "ts", minutes: int = QUARTER,
            chunk_days: int = CHUNK_DAYS) -> DataFrame:
    """`regularize` followed by an unlimited `ffill` of all columns, in one pass over the sparse rows."""
    values = [c for c in df.columns if c not in {*series, ts}]
    rows = _with_next(df, values, series, ts, minutes, chunk_days, fill=values)
    return _cover(rows, values, series, ts, minutes, keep_values=True)


def ffill(df: DataFrame, cols: Sequence[str], *, series: Sequence[str], ts: str = "ts",
          limit: int | None = None, minutes: int = QUARTER, chunk_days: int = CHUNK_DAYS) -> DataFrame:
    """Carry the last value forward, at most `limit` steps if one is given.

    Without a limit a value can cross any number of chunks: the last value of
    each chunk is computed first, carried over the (few) chunks, and used where a
    chunk has nothing of its own before a row.
    """
    name = _quoted
    if limit is not None:
        phase = lambda w: {c: F.last(col(c), ignorenulls=True).over(w.time.rowsBetween(-limit, 0)) for c in cols}
        return chunk_windows(df, [phase], series=series, ts=ts, back=limit, minutes=minutes,
                             chunk_days=chunk_days)
    size = steps_per_day(minutes) * chunk_days
    base = df.withColumn(STEP, step_index(col(ts), minutes)).withColumn(CHUNK, _chunk(size))
    keys = [*series, CHUNK]
    ends = base.groupBy(*keys).agg(*[
        F.expr(f"max(CASE WHEN {name(c)} IS NOT NULL THEN struct({STEP}, {name(c)} AS v) END) AS `_end_{c}`") for c in cols])
    by = ", ".join(name(k) for k in series)
    before = f"({'PARTITION BY ' + by if by else ''} ORDER BY {CHUNK} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    carried = ends.selectExpr(
        *[name(k) for k in keys], *[f"last(`_end_{c}`, true) OVER {before}.v AS `_carry_{c}`" for c in cols])
    inside = (f"(PARTITION BY {', '.join(name(k) for k in keys)} ORDER BY {STEP} "
              "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    filled = set(cols)
    return base.join(carried, keys, "left").selectExpr(*[
        f"coalesce(last({name(c)}, true) OVER {inside}, `_carry_{c}`) AS {name(c)}" if c in filled else name(c)
        for c in df.columns])


def upsample(grid: DataFrame, coarse: DataFrame, cols: Sequence[str], *, series: Sequence[str] = (),
             ts: str = "ts", minutes: int = QUARTER, limit: int | None = None) -> DataFrame:
    """Hourly values on a finer grid.

    Missing hours are filled on the hourly table (a quarter of the rows), then one
    equi-join on the hour; rows after the last hour see that hour. `limit` counts
    the fine steps a value may be carried past its own step.
    """
    per_hour = HOUR // minutes
    series = list(series)
    hourly = coarse.select(*series, ts, *[col(c) for c in cols])
    if limit is None:
        hourly = densify(hourly, series=series, ts=ts, minutes=HOUR)
    else:
        seen = [f"seen {c}" for c in cols]
        hourly = regularize(hourly, series=series, ts=ts, minutes=HOUR).withColumns(
            {a: F.when(col(c).isNotNull(), step_index(col(ts), HOUR)) for a, c in zip(seen, cols)})
        if limit >= per_hour:
            hourly = ffill(hourly, [*cols, *seen], series=series, ts=ts, minutes=HOUR, limit=limit // per_hour)
    hours = hourly.withColumn("_hour", step_index(col(ts), HOUR)).drop(ts)
    ends = coarse.groupBy(*series).agg(F.max(step_index(col(ts), HOUR)).alias("_last"))
    placed = grid.join(ends, series, "left") if series else grid.crossJoin(F.broadcast(ends))  # one row
    out = placed.withColumn("_hour", F.least(step_index(col(ts), HOUR), F.col("_last"))).join(hours, [*series, "_hour"], "left")
    if limit is not None:
        fine = step_index(col(ts), minutes)
        out = out.withColumns({c: F.when(fine - col(a) * per_hour <= limit, col(c)) for a, c in zip(seen, cols)}).drop(*seen)
    return out.select(*[col(c) for c in out.columns if not c.startswith("_")])


def downsample(df: DataFrame, *, ts: str = "ts", minutes: int = HOUR) -> DataFrame:
    """Rows that start a coarser interval."""
    return df.where(col(ts) == step_time(step_index(col(ts), minutes), minutes))


def latest_run(runs: DataFrame, *, as_of: Column, key: Sequence[str], value: str = "variables",
               fetch: str = "fetch_time") -> DataFrame:
    """For every target the newest forecast fetched at or before `as_of`."""
    return (
        runs.where(col(fetch) <= as_of)
        .groupBy(*[col(k) for k in key])
        .agg(F.max_by(F.struct(col(fetch), col(value)), col(fetch)).alias("_pick"))
        .select(*key, F.col(f"_pick.{fetch}").alias(fetch), F.col(f"_pick.{value}").alias(value))
    )


def obs_over_forecast(obs: DataFrame, runs: DataFrame, *, as_of: Column, ts: str = "ts",
                      target: str = "target_time", value: str = "variables") -> DataFrame:
    """One weather row per hour: the observation if there is one, else the newest forecast."""
    forecast = runs.where(F.col("fetch_time") <= as_of).select(
        col(target).alias(ts), F.lit(0).alias("_rank"), F.col("fetch_time").alias("_fetched"), col(value)
    )
    seen = obs.select(
        ts, F.lit(1).alias("_rank"), F.lit(None).cast("timestamp_ntz").alias("_fetched"), col(value)
    )
    both = seen.unionByName(forecast)
    # group first: partial aggregation keeps one candidate per hour and task
    best = both.groupBy(ts).agg(F.max_by(F.struct("_rank", value), F.struct("_rank", "_fetched")).alias("_pick"))
    return best.select(
        ts,
        F.when(F.col("_pick._rank") == 1, "obs").otherwise("forecast").alias("source"),
        F.col(f"_pick.{value}").alias(value),
    )


def forward_extend(grid: DataFrame, steps: int, *, series: Sequence[str], ts: str = "ts",
                   minutes: int = QUARTER) -> DataFrame:
    """Append steps after the end of each series; measured channels are null there."""
    bounds = step_bounds(grid, series=series, ts=ts, minutes=minutes)
    future = spine(
        bounds.select(*series, (F.col("_hi") + 1).alias("_lo"), (F.col("_hi") + steps).alias("_hi")),
        series=series, minutes=minutes,
    ).select(*series, step_time(F.col(STEP), minutes).alias(ts))
    return grid.unionByName(future, allowMissingColumns=True)
