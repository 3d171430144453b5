"""Quality rules and serving queries on hand-made days."""

import json
from datetime import date

import pytest
from grid_helpers import START, at, column
from pyspark.sql import functions as F

from gridloom.plans import quality, serving

S = ["series_id"]


def test_gap_day_completeness(series):
    values = [1.0] * 96
    for gone in (3, 50, 95):
        values[gone] = ...
    df = series({1: values})
    row = quality.completeness(df, series=S).first()
    assert (row.present, row.missing, row.completeness_pct) == (93, 3, 96.88)
    slots = quality.missing_slots(df, series=S).first()
    assert (slots.n_missing, slots.missing_slots) == (3, [3, 50, 95])
    assert [r.period for r in quality.absent_periods(df, series=S).orderBy("period").collect()] == [3, 50, 95]
    assert quality.missing_slots(series({1: [1.0]}), series=S).first().missing_slots == list(range(1, 11))


def test_range_and_jump_checks_skip_nulls(series):
    df = series({1: [100.0, None, 700.0, 100.0, 1600.0]}, name="price")
    r = quality.range_check(df, series=S, ranges={"price": (0.0, 1500.0)}).first()
    assert (r.outliers, r.min_value, r.max_value) == (1, 100.0, 1600.0)
    j = quality.jump_check(df, series=S, limits={"price": 500.0}).first()
    assert (j.jumps, j.max_jump, j.max_jump_from) == (3, 1500.0, 3)
    assert quality.range_check(series({1: [None, None]}, name="price"), series=S, ranges={"price": (0.0, 1.0)}).first().outliers == 0


def test_key_missing_rate_is_a_true_rate(spark):
    obs = spark.createDataFrame([(at(4 * i), '{"temp_a": 1.0}' if i else '{"temp_a": 1.0, "rad_b": 2.0}') for i in range(4)], "ts timestamp_ntz, variables string")
    rates = {r.key: r.missing_rate for r in quality.key_missing_rate(obs, keys=["temp_a", "rad_b", "gone"]).collect()}
    assert rates == {"temp_a": 0.0, "rad_b": 0.75, "gone": 1.0}


@pytest.mark.parametrize("pct,outliers,jumps,core,status", [
    (0.0, 0, 0, None, "critical"), (89.9, 9, 9, 1.0, "critical"), (90.0, 0, 0, 0.0, "warning"), (100.0, 4, 0, 0.0, "warning"),
    (100.0, 3, 6, 0.0, "warning"), (100.0, 3, 5, 0.51, "warning"), (100.0, 3, 5, 0.5, "ok"), (95.0, None, None, None, "ok"), (94.9, 0, 0, 0.0, "warning")])
def test_status_rules(spark, pct, outliers, jumps, core, status):
    df = spark.createDataFrame([(pct, outliers, jumps, core)], "p double, o int, j int, c double")
    assert df.select(quality.status_of(F.col("p"), F.col("o"), F.col("j"), F.col("c")).alias("s")).first().s == status


def test_quality_log_has_json_details(spark, series):
    report = quality.quality_status(series({1: [100.0] * 96}, name="price"), series=S)
    row = quality.quality_log(report).first()
    assert row.status == "ok" and row.check_date == date(2024, 1, 1) and json.loads(row.details)["present"] == 96


def preds(spark, rows):
    return spark.createDataFrame(rows, "target_time timestamp_ntz, predicted_price double, model_version string")


def test_version_preference_and_complete_day(spark):
    day0 = [(at(i), 1.0, "v") for i in range(96)]
    day1 = [(at(96 + i), 2.0, "v") for i in range(40)] + [(at(96 + i), 3.0, "g") for i in range(96)]
    day2 = [(at(192 + i), 4.0, "g") for i in range(95)] * 2 + [(at(300), 9.0, "old")]
    p = preds(spark, day0 + day1 + day2)
    assert serving.latest_complete_day(p, ["v", "g"]).first().day == date(2024, 1, 2)
    curve = serving.day_curve(p, serving.latest_complete_day(p, ["v", "g"]), ["v", "g"]).orderBy("period").collect()
    assert len(curve) == 96 and [c.price for c in curve[38:42]] == [2.0, 2.0, 3.0, 3.0] and curve[41].time == "10:15"
    assert {c.model_version for c in curve} == {"v", "g"}


def test_tie_day_takes_the_first_period(spark):
    rows = [(date(2024, 1, 1), p, 5.0 if p in (20, 80) else 1.0 if p in (30, 31) else 3.0) for p in range(96)]
    s = serving.day_summary(spark.createDataFrame(rows, "day date, period int, price double")).first()
    assert (s.peak_price, s.peak_period, s.valley_price, s.valley_period, s.avg_price) == (5.0, 20, 1.0, 30, 3.0)
    gap = serving.day_summary(spark.createDataFrame(rows[50:], "day date, period int, price double")).first()
    assert gap.peak_period == 80  # a period, not a list position


def test_history_is_dense_and_includes_the_last_quarter(spark):
    actual = spark.createDataFrame([(at(95), 10.04), (at(96), 1.0)], "ts timestamp_ntz, price double")
    p = preds(spark, [(at(95), 2.0, "g"), (at(95), 1.0, "v"), (at(0), None, "v")])
    h = serving.history_compare(actual, p, F.lit(date(2024, 1, 1)), F.lit(date(2024, 1, 1)), ["v", "g"]).orderBy("period").collect()
    assert len(h) == 96 and (h[95].actual, h[95].predicted) == (10.0, 1.0) and h[0].actual is None
    arrays = serving.history_arrays(spark.createDataFrame(h)).first()
    assert len(arrays.actual) == 96 and arrays.actual[95] == 10.0 and arrays.predicted[0] is None


def test_history_of_a_series_with_predictions_only(spark):
    actual = spark.createDataFrame([("a", at(0), 1.0)], "series_id string, ts timestamp_ntz, price double")
    p = spark.createDataFrame([("b", at(3), 7.0, "v")], "series_id string, target_time timestamp_ntz, predicted_price double, model_version string")
    day = F.lit(date(2024, 1, 1))
    h = serving.history_compare(actual, p, day, day, ["v"], keys=S)
    assert {(r.series_id, r.n, r.p) for r in h.groupBy("series_id").agg(F.count("*").alias("n"), F.sum("predicted").alias("p")).collect()} == {("a", 96, None), ("b", 96, 7.0)}


def test_table_stats_and_first_rows(series):
    df = series({1: [1.0, 2.0], 2: [3.0]})
    rows = serving.table_stats(df, keys=S, expected=2).orderBy("series_id").collect()
    assert [(r.n_rows, r.as_expected) for r in rows] == [(2, True), (1, False)]
    assert [r.x for r in serving.first_rows(df, 2, ["series_id", "ts"]).collect()] == [1.0, 2.0]
