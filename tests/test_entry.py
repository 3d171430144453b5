"""The registered queries: coverage, independence from a session, plan shapes."""

import os
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridloom.bindings import catalog
from gridloom.bindings import tables as t
from gridloom.bindings.feature_sql import FEATURE_NAMES
from gridloom.operators import rolling, shift
from gridloom.plans import features

DATA = "/root/testdata/sf0.001"
PLANNED = """scan_range select_by_pattern pack_json unpack_json unnest_series_pivot parse_time_label interval_start fallback_fill valid_rows
try_numeric long_to_map upsert_latest upsert_two_keys replace_partitions prune_superseded model_registry feature_store base_table table_stats
calendar_features day_type season_route segment_of segment_masks weather_derived supply_demand event_distance interactions stage2_inputs
fill_constant select_by_rule regularize ffill_limit ffill upsample_hourly forward_extend obs_over_forecast grid_weather_join lead_join lag_join
cluster_fusion history_compare forecast_asof complete_days cluster_mean day_summary morning_snapshot prev_day_curve diurnal_range
month_quantile_flag joint_extreme_flag completeness range_check jump_check key_missing_rate forecast_metrics baseline_metrics robust_weights
feature_importance frame_diff residual_hist lags diffs rolling_mean_std hourly_rolling_sum rolling_max offset_window_stats grid_lag
prefer_version time_folds last_day missing_slots split_intersect gap_fill_days split_assign stage1_train stage2_train oof_predict price_anchor
blend_weights two_stage_predict guard_decision guard_apply day_curve quality_status stream_ingest bin_15m""".split()
ROWS_ONLY = {"oof_predict", "stage1_train", "stage2_train", "feature_importance", "two_stage_predict", "model_registry", "daily_inference"}


def test_every_planned_query_is_registered():
    runs, sql = catalog.RUNS, catalog.SQL
    assert set(runs) <= set(entry.queries()) and set(sql) <= set(entry.oracle_sql())
    assert not set(PLANNED) - set(runs)
    assert set(runs) - set(sql) == ROWS_ONLY and not set(sql) - set(runs)


def test_sql_needs_no_session():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = "import __spark_entry__ as e; print(len(e.oracle_sql()), len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr


def test_sql_and_plan_name_the_same_features(spark):
    assert FEATURE_NAMES == features.feature_names()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="sample tables absent")
def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def nodes(text, name):
    return len(re.findall(rf"(?<![A-Za-z]){name} ", text))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="sample tables absent")
def test_all_lags_and_rolls_share_one_shuffle(spark):
    g = spark.read.parquet(f"{DATA}/events.parquet").select(F.col("user_id").alias("series_id"), "ts", F.col("value").alias("x"))
    rolls = [rolling.Roll(f"m{w}", "x", w, "mean") for w in (96, 672, 720)] + [rolling.Roll("s", "x", 96, "std"), rolling.Roll("p", "x", 720, "max")]
    text = plan(rolling.rolling(g, rolls, series=["series_id"]))
    assert nodes(text, "Exchange") == 1 and nodes(text, "Sort") <= 4
    text = plan(shift.lag_by(g, {f"l{k}": ("x", k) for k in (1, 96, 672)}, series=["series_id"]))
    assert nodes(text, "Exchange") == 1 and nodes(text, "Window") == 1 and nodes(text, "Sort") == 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="sample tables absent")
def test_feature_plan_shape(spark):
    from gridloom.session import materialise

    grid = materialise(t.grid(spark, DATA), "grid")
    text = plan(features.build_features(grid, t.weather(spark, DATA)))
    assert "CartesianProduct" not in text and "Python" not in text
    # hash exchanges: two cut-off tables, the two halves of the hourly table, joins when not broadcast, one for all windows
    assert nodes(text, "Exchange") <= 8 and nodes(text, "Window") <= 8 and nodes(text, "Sort") <= 9


@pytest.mark.skipif(not os.path.isdir(DATA), reason="sample tables absent")
def test_filters_and_columns_reach_the_scan(spark):
    text = plan(entry.queries()["scan_range"](spark, DATA))
    assert "GreaterThanOrEqual(ts" in text and "LessThan(ts" in text and "props" not in text
    text = plan(t.raw_fine(spark, DATA))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in text


SAFE = [q for q in catalog.RUNS if q not in ROWS_ONLY]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="sample tables absent")
@pytest.mark.parametrize("name", [q for q in SAFE if not q.startswith("feature") and q not in ("interactions", "select_by_rule", "base_table")])
def test_query_equals_sql(spark, name):
    """Value by value on the smallest tables (the feature frames are compared by `tools/check.py`)."""
    import duckdb

    from tools.check import run

    con = duckdb.connect()
    for table in ("events", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    ok, note, _, _ = run(spark, con, name, DATA, entry.oracle_sql()[name])
    assert ok or note == "0 rows EMPTY", note
