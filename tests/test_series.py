"""Regular grids, shifts and rolling statistics against brute force."""

import math
import random
import re
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from grid_helpers import START, at, column
from pyspark.sql import functions as F

from gridloom.functions.timegrid import step_index, step_time
from gridloom.operators import chunked, daily, quantiles, regular, rolling, shift
from gridloom.operators.rolling import Roll
from gridloom.plans import metrics

S = ["series_id"]


def noisy(n, seed, gaps=0.2):
    rnd = random.Random(seed)
    return [None if rnd.random() < gaps else float(rnd.randint(-50, 500)) for _ in range(n)]


def test_step_roundtrip_before_and_after_epoch(spark):
    times = [datetime(1969, 12, 31, 23, 45), datetime(1970, 1, 1), datetime(2024, 2, 29, 13, 30)]
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")
    rows = df.select("ts", step_index(F.col("ts")).alias("s"), step_time(step_index(F.col("ts"))).alias("back")).orderBy("ts").collect()
    assert [r.s for r in rows][:2] == [-1, 0]
    assert all(r.ts == r.back for r in rows)


def test_regularize_fills_gaps_per_series(series):
    df = series({1: [1.0, ..., ..., 4.0], 2: [..., 5.0, 6.0]})
    out = regular.regularize(df, series=S)
    assert column(out, "x") == [1.0, None, None, 4.0, 5.0, 6.0]
    assert column(out, "ts")[4] == at(1)


@pytest.mark.parametrize("chunk_days", [1, 3, 56])
def test_densify_and_ffill_cross_chunks(series, chunk_days):
    values = [7.0] + [...] * 400 + [None, 3.0] + [...] * 250 + [None]
    df = series({1: values, 2: [None, 2.0]})
    dense = regular.densify(df, series=S, chunk_days=chunk_days)
    twice = regular.ffill(regular.regularize(df, series=S, chunk_days=chunk_days), ["x"], series=S, chunk_days=chunk_days)
    expect = [7.0] * 402 + [3.0] * 252 + [None, 2.0]
    assert column(dense, "x") == expect
    assert column(twice, "x") == expect


def test_grid_of_binned_rows_repeats_no_time_arithmetic_per_row(spark):
    """The join on chunks asks no row below the aggregate whether it has one."""
    rows = spark.createDataFrame([(i % 2, at(7 * i), float(i)) for i in range(40)], "series_id int, t timestamp_ntz, x double")
    binned = regular.bin_rows(rows.withColumn("ts", F.col("t") + F.make_dt_interval(F.col("series_id"))), {"x": F.sum("x")}, series=S)
    for df in (regular.densify(binned, series=S), regular.regularize(binned, series=S), regular.ffill(binned, ["x"], series=S)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.split("\n") if "Filter" in line and "hour(" in line]


def test_rows_without_a_time_give_no_step(spark):
    rows = [(1, at(0), 1.0), (1, None, 7.0), (1, at(2), None), (1, at(9000), 3.0), (2, None, 8.0), (3, None, 5.0), (3, at(1), None), (None, at(1), 9.0)]
    df = spark.createDataFrame(rows, "series_id int, ts timestamp_ntz, x double")
    full = regular.densify(df, series=S, chunk_days=1)
    assert full.where("series_id = 1 AND x = 1.0").count() == 9000 and full.count() == 9002
    assert [tuple(r) for r in full.where("series_id = 3").collect()] == [(3, at(1), 5.0)]
    assert regular.regularize(df, series=S, chunk_days=1).where("x is not null").count() == 2
    filled = {(r.series_id, r.ts): r.x for r in regular.ffill(df, ["x"], series=S, chunk_days=1).collect()}
    assert filled == {(1, at(0)): 1.0, (1, None): 7.0, (1, at(2)): 1.0, (1, at(9000)): 3.0, (2, None): 8.0, (3, None): 5.0, (3, at(1)): 5.0, (None, at(1)): 9.0}


def test_ffill_limit_crosses_chunk_border(series):
    df = series({1: [1.0] + [None] * 5}, start=datetime(2024, 1, 1, 23, 30))
    out = regular.ffill(df, ["x"], series=S, limit=3, chunk_days=1)
    assert column(out, "x") == [1.0, 1.0, 1.0, 1.0, None, None]


def test_upsample_limits(spark, series):
    grid = series({1: [0.0] * 16}).select("series_id", "ts")
    hourly = spark.createDataFrame([(at(0), 5.0), (at(8), 9.0)], "ts timestamp_ntz, v double")
    assert column(regular.upsample(grid, hourly, ["v"]), "v") == [5.0] * 8 + [9.0] * 8
    assert column(regular.upsample(grid, hourly, ["v"], limit=3), "v") == [5.0] * 4 + [None] * 4 + [9.0] * 4 + [None] * 4
    assert column(regular.upsample(grid, hourly, ["v"], limit=5), "v") == [5.0] * 6 + [None] * 2 + [9.0] * 6 + [None] * 2
    assert column(regular.upsample(grid, hourly, ["v"], limit=2), "v") == [5.0] * 3 + [None] * 5 + [9.0] * 3 + [None] * 5


def test_downsample_keeps_interval_starts(series):
    assert column(regular.downsample(series({1: [0.0, 1.0, 2.0, 3.0, 4.0]})), "x") == [0.0, 4.0]


def test_edge_lags_do_not_wrap(series):
    df = series({1: [float(i) for i in range(300)]})
    out = shift.lag_by(df, {"l": ("x", 96), "a": ("x", -96)}, series=S)
    assert column(out, "l") == [None] * 96 + [float(i) for i in range(204)]
    assert column(out, "a") == [float(i) for i in range(96, 300)] + [None] * 96


@pytest.mark.parametrize("chunk_days", [1, 2, 56])
def test_lag_methods_and_chunks_agree(series, chunk_days):
    df = series({1: noisy(500, 1), 2: noisy(300, 2)})
    phase = lambda w: {"l": w.lag("x", 100)}
    chunks = chunked.chunk_windows(df, [phase], series=S, back=100, chunk_days=chunk_days)
    joined = shift.lag_by(df, {"l": ("x", 100)}, series=S, method="join")
    assert column(chunks, "l") == column(joined, "l")


def test_lead_undoes_lag(series):
    df = series({1: noisy(400, 3)})
    out = shift.lead_by(shift.lag_by(df, {"l": ("x", 50)}, series=S), {"back": ("l", 50)}, series=S)
    assert column(out, "back")[:350] == column(df, "x")[:350]


def test_grid_lag_keeps_originals(series):
    out = shift.grid_lag(series({1: [1.0, 2.0, 3.0]}), ["x"], 2, series=S)
    assert column(out, "x") == [None, None, 1.0] and column(out, "x_orig") == [1.0, 2.0, 3.0]


ROLLS = [
    Roll("mean96", "x", 96, "mean"), Roll("std96", "x", 96, "std"), Roll("std4", "x", 4, "std", lag=0), Roll("sum10", "x", 10, "sum", lag=0),
    Roll("max50", "x", 50, "max", fill_first=True), Roll("min7", "x", 7, "min", lag=0), Roll("max200", "x", 200, "max"), Roll("n30", "x", 30, "count"),
]


@pytest.mark.parametrize("chunk_days", [1, 4, 56])
@pytest.mark.parametrize("gaps", [0.0, 0.3, 0.95])
def test_rolling_matches_pandas(series, chunk_days, gaps):
    values = {1: noisy(420, 5, gaps), 2: noisy(150, 6, gaps)}
    df = series(values)
    back = max(r.back for r in ROLLS)
    out = chunked.chunk_windows(df, rolling.rolling_phases(ROLLS), series=S, back=back, chunk_days=chunk_days).orderBy("series_id", "ts").toPandas()
    for sid, vs in values.items():
        got = out[out.series_id == sid].reset_index(drop=True)
        s = pd.Series(vs, dtype=float)
        for r in ROLLS:
            base = s.shift(r.lag).rolling(r.rows, min_periods=0 if r.fn == "count" else max(r.needed, 2 if r.fn == "std" else 1))
            want = getattr(base, r.fn)()
            if r.fill_first:
                want = want.fillna(s)
            np.testing.assert_allclose(got[r.name].astype(float), want.fillna(0.0) if r.fn == "count" else want, rtol=1e-9, atol=1e-7, err_msg=f"{r}")


def test_offset_window_matches_numpy(series):
    values = noisy(330, 9, 0.05)
    out = rolling.offset_window_stats(series({1: values}), ["x"], series=S).orderBy("ts").toPandas()
    x = np.array([np.nan if v is None else v for v in values])
    for t in (200, 210, 329):
        w = x[t - 200:t - 191][::-1]
        if np.isnan(w).any():
            assert pd.isna(out.x_mean[t])
            continue
        assert math.isclose(out.x_mean[t], w.mean()) and math.isclose(out.x_std[t], w.std(), abs_tol=1e-9)
        assert out.x_trend[t] == w[0] - w[-1] and out.x_range[t] == w.max() - w.min()
        assert out.x_max_step[t] == np.abs(np.diff(w)).max() and out.x_accel[t] == (w[0] - w[4]) - (w[4] - w[-1])
    assert out.x_mean[:200].isna().all()


def test_hourly_sum_counts_each_hour_once(spark, series):
    grid = series({1: [0.0] * 16}).select("series_id", "ts")
    hourly = spark.createDataFrame([(at(4 * i), float(v)) for i, v in enumerate([1, 2, 4, 8])], "ts timestamp_ntz, rain double")
    out = rolling.hourly_rolling_sum(grid, hourly, {"s2": ("rain", 2)}, series=[])
    assert column(out, "s2") == [1.0] * 4 + [3.0] * 4 + [6.0] * 4 + [12.0] * 4


def test_morning_snapshot_and_incomplete_day(series):
    full = [float(i) for i in range(96)]
    broken = list(full)
    broken[10] = None
    rows = daily.morning_snapshot(series({1: full + broken}), ["x"], series=S).orderBy("day").collect()
    assert rows[0].morning_mean_x == 17.0 and rows[0].morning_last_x == 34.0 and rows[0].morning_ramp_x == 10.0
    assert math.isclose(rows[0].morning_std_x, np.std(np.arange(35)))
    assert rows[1].morning_mean_x is None and rows[1].morning_last_x == 34.0


def test_prev_day_curve_uses_dates_not_row_blocks(series):
    day1 = [float(i) for i in range(96)]
    out = daily.prev_day_curve(series({1: day1 + [..., 1.0]}), {"x": daily.CURVE_OPS}, series=S).orderBy("day").collect()
    assert out[0].d2_x_peak is None
    r = out[1]
    assert (r.d2_x_peak, r.d2_x_range, r.d2_x_mean, r.d2_x_total) == (95.0, 95.0, 47.5, 4560.0)
    assert r.d2_x_night_mean == (sum(range(20)) + sum(range(88, 96))) / 28 and r.d2_x_daytime_mean == 51.5
    assert (r.d2_x_ramp_up, r.d2_x_duration, r.d2_x_morning_peak, r.d2_x_evening_peak, r.d2_x_valley) == (47.0, 0.0, 35.0, 87.0, 40.0)
    assert r.d2_x_peak_ratio == 87.0 / 36.0


def test_last_day_is_by_time(series):
    df = series({1: [1.0] * 50 + [...] * 70 + [2.0]})
    assert column(daily.last_day(df, series=S), "ts") == [at(i) for i in range(25, 50)] + [at(120)]


@pytest.mark.parametrize("accuracy", [100, 20_000])
def test_exact_quantiles_match_numpy(spark, accuracy):
    rnd = random.Random(4)
    groups = {"ties": [1.0] * 400 + [2.0] * 200 + [rnd.random() for _ in range(300)], "one": [3.5], "two": [1.0, 2.0],
              "wide": [rnd.gauss(0, 1e6) for _ in range(999)], "same": [8.0] * 50}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("two", None)], "g string, v double")
    probs = [0.0, 0.1, 0.5, 0.8, 0.95, 1.0]
    rows = {r.g: r for r in quantiles.exact_quantiles(df, "v", probs, by=["g"], accuracy=accuracy).collect()}
    for g, vs in groups.items():
        assert rows[g].n == len(vs)
        np.testing.assert_allclose([rows[g][f"q{i}"] for i in range(len(probs))], np.quantile(vs, probs), rtol=1e-12)
    whole = quantiles.exact_quantiles(df, "v", [0.3], accuracy=accuracy).first()
    np.testing.assert_allclose(whole.q0, np.quantile([v for vs in groups.values() for v in vs], 0.3), rtol=1e-12)


@pytest.mark.parametrize("sort_rows", [2, 40])
def test_large_brackets_are_split_until_they_are_small(spark, sort_rows):
    rnd = random.Random(5)
    groups = {"hot": [rnd.gauss(0, 1) ** 9 for _ in range(6000)], "ties": [float(i % 7) for i in range(700)], None: [4.0, 6.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    probs = [0.0, 0.25, 0.5, 0.999, 1.0]
    rows = {r.g: r for r in quantiles.exact_quantiles(df, "v", probs, by=["g"], accuracy=20, sort_rows=sort_rows).collect()}
    for g, vs in groups.items():
        assert rows[g].n == len(vs)
        np.testing.assert_allclose([rows[g][f"q{i}"] for i in range(len(probs))], np.quantile(vs, probs), rtol=1e-12)
    assert quantiles.exact_quantiles(df.where("false"), "v", probs, by=["g"], sort_rows=sort_rows).count() == 0


def _exchange_keys(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"hashpartitioning\((.*?), \d+\)", plan)


def test_values_of_a_hot_group_are_not_brought_together(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(2000).selectExpr("cast(id % 3 as string) as g", "cast(id as double) as v")
        few = spark.createDataFrame([("0", 1.0), ("1", 2.0), (None, 3.0)], "g string, x double")
        joined = quantiles.join_few(df, few, ["g"], how="left")
        assert _exchange_keys(joined) and all("_share" in keys for keys in _exchange_keys(joined))
        assert joined.count() == 2000 and joined.where("x is null").count() == joined.where("g = '2'").count()
        weighted = metrics.robust_weights(df, "v", by=["g"])
        # on the group key alone: the partial sketches and the result with one row per group
        joins = [k for k in _exchange_keys(weighted) if "_share" in k]
        assert len(joins) >= 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_quantile_flag_needs_more_than_100_rows(series):
    jan = [float(i) for i in range(120)]
    df = series({1: jan}, start=datetime(2024, 1, 31))  # 96 rows in January, 24 in February
    assert set(column(quantiles.quantile_flag(df, {"x": (0.1, 0.9)}, series=S), "extreme_x")) == {0.0}
    flags = column(quantiles.quantile_flag(series({1: jan}), {"x": (0.1, 0.9)}, series=S), "extreme_x")
    assert flags[:12] == [-1.0] * 12 and flags[-12:] == [1.0] * 12 and flags[60] == 0.0


def test_observation_beats_forecast_and_newest_run_wins(spark):
    obs = spark.createDataFrame([(at(0), "obs")], "ts timestamp_ntz, variables string")
    runs = spark.createDataFrame(
        [(at(-40), at(0), "old"), (at(-40), at(4), "old"), (at(-20), at(4), "new"), (at(50), at(4), "too late")],
        "fetch_time timestamp_ntz, target_time timestamp_ntz, variables string")
    as_of = F.lit(START).cast("timestamp_ntz")
    out = regular.obs_over_forecast(obs, runs, as_of=as_of).orderBy("ts").collect()
    assert [(r.source, r.variables) for r in out] == [("obs", "obs"), ("forecast", "new")]
    best = regular.latest_run(runs, as_of=as_of, key=["target_time"]).orderBy("target_time").collect()
    assert [r.variables for r in best] == ["old", "new"]
