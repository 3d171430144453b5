"""Back-fill, gap pass and the pruned readers of the prediction store."""

from datetime import date, timedelta

import pytest
from grid_helpers import START, at
from pyspark.sql import functions as F

from gridloom.operators.shift import lag_by
from gridloom.plans import jobs, serving
from gridloom.session import materialise
from gridloom.sources import store

S = ["series_id"]
LAGS = {"price_lag96": ("price", 96), "price_lag672": ("price", 672)}
predict = jobs.by_anchor(tuple(LAGS))


def inputs(series, days):
    """Lagged rows of series of so many days."""
    grid = series({sid: [float(i % 96 + i // 96) for i in range(96 * n)] for sid, n in days.items()}, name="price")
    return materialise(lag_by(grid, LAGS, series=S), "lagged")


def rows_of(spark, path):
    return sorted(map(tuple, spark.read.parquet(path).select("series_id", "target_time", "predicted_price", "model_version", "season", "period").collect()))


def test_killed_backfill_goes_on_where_it_was(spark, series, tmp_path):
    feats = inputs(series, {1: 12, 2: 5})
    whole, path, ledger = str(tmp_path / "whole"), str(tmp_path / "p"), str(tmp_path / "ledger")
    assert jobs.backfill(feats, predict, path=whole, ledger_path=str(tmp_path / "l2"), run="a", version="v", step_days=4) == 3
    calls = []

    def dies(df):
        calls.append(df)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return predict(df)

    with pytest.raises(RuntimeError):
        jobs.backfill(feats, dies, path=path, ledger_path=ledger, run="a", version="v", step_days=4)
    assert jobs.backfill(feats, dies, path=path, ledger_path=ledger, run="a", version="v", step_days=4) == 2
    assert rows_of(spark, path) == rows_of(spark, whole) and len(rows_of(spark, path)) == (12 + 5) * 96
    assert jobs.backfill(feats, dies, path=path, ledger_path=ledger, run="a", version="v", step_days=4) == 0
    assert jobs.backfill(feats, dies, path=path, ledger_path=ledger, run="b", version="v", step_days=40) == 1  # a new run does all
    assert rows_of(spark, path) == rows_of(spark, whole)


def test_step_that_died_before_its_ledger_entry_is_written_again(spark, series, tmp_path, monkeypatch):
    feats, path, ledger = inputs(series, {1: 6}), str(tmp_path / "p"), str(tmp_path / "ledger")
    entered = store.append_log
    monkeypatch.setattr(store, "append_log", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        jobs.backfill(feats, predict, path=path, ledger_path=ledger, run="a", version="v", step_days=3)
    monkeypatch.setattr(store, "append_log", entered)
    assert jobs.backfill(feats, predict, path=path, ledger_path=ledger, run="a", version="v", step_days=3) == 2
    assert len(rows_of(spark, path)) == 6 * 96 == len({(r[0], r[1]) for r in rows_of(spark, path)})


def test_dates_are_whole_and_unknown_prices_zero(series):
    feats = series({1: [5.0] * 40}, start=START.replace(hour=12), name="price")  # half a day, no lag known
    out = jobs.full_days(predict(lag_by(feats, LAGS, series=S)), "v").collect()
    assert len(out) == 96 and {r.predicted_price for r in out} == {0.0} and sorted(r.period for r in out) == list(range(96))
    assert {r.target_time.date() for r in out} == {START.date() + timedelta(days=1)}


def test_empty_history(spark, series, tmp_path):
    feats = inputs(series, {1: 1}).where("false")
    assert jobs.backfill(feats, predict, path=str(tmp_path / "p"), ledger_path=str(tmp_path / "l"), run="a", version="v") == 0


@pytest.fixture
def two_versions(spark, tmp_path):
    """Series 1 has normal rows on three days, series 2 on one, both gap rows on five; a null series has gap rows only."""
    def days(n, sid, version):
        return [(sid, at(i), 1.0, version) for i in range(96 * n)]
    rows = days(3, 1, "v") + days(1, 2, "v") + days(5, 1, "g") + days(5, 2, "g") + days(2, None, "g")
    path = str(tmp_path / "store")
    store.replace_predictions(spark.createDataFrame(rows, "series_id int, target_time timestamp_ntz, predicted_price double, model_version string"), path)
    return path


def test_superseded_rows_are_removed_by_series(spark, two_versions):
    before = {r[0] for r in spark.read.parquet(two_versions).select("target_date").distinct().collect()}
    expected = sorted(map(str, store.prune_superseded(spark.read.parquet(two_versions), version="v", gap_version="g").groupBy(
        "series_id", "target_date", "model_version").count().collect()))
    store.drop_superseded(spark, two_versions, version="v", gap_version="g")
    after = spark.read.parquet(two_versions).groupBy("series_id", "target_date", "model_version").count()
    assert sorted(map(str, after.collect())) == expected
    assert {r.target_date for r in after.where("model_version = 'g' and series_id = 1").collect()} == set(sorted(before)[3:])
    assert {r.target_date for r in after.where("model_version = 'g' and series_id = 2").collect()} == set(sorted(before)[1:])
    assert after.where("series_id is null").count() == 2
    store.drop_superseded(spark, two_versions, version="none", gap_version="g")
    assert spark.read.parquet(two_versions).count() == sum(r["count"] for r in after.collect())


def test_emptied_partitions_are_dropped(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(1, at(i), 1.0, v) for i in range(96) for v in ("v", "g")]
    store.replace_predictions(spark.createDataFrame(rows, "series_id int, target_time timestamp_ntz, predicted_price double, model_version string"), path)
    store.drop_superseded(spark, path, version="v", gap_version="g")
    assert {r.model_version for r in spark.read.parquet(path).collect()} == {"v"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_readers_prune_partitions(spark, two_versions):
    one_day = START.date() + timedelta(days=1)
    fixed = plan_of(store.read_predictions(spark, two_versions, ["v"], first=one_day))
    filters = next(x for x in fixed.splitlines() if "PartitionFilters" in x)
    assert "target_date" in filters.split("PartitionFilters:")[1] and "model_version" in filters.split("PartitionFilters:")[1]
    days = spark.createDataFrame([(one_day,), (one_day,), (None,)], "day date")
    read = store.read_predictions(spark, two_versions, days=days)
    assert "dynamicpruning" in plan_of(read)
    assert {r.target_date for r in read.collect()} == {one_day}
    assert store.read_predictions(spark, two_versions, days=days.where("false")).count() == 0


def test_history_reads_only_its_range(spark, two_versions):
    actual = spark.createDataFrame([(1, at(0), 3.0)], "series_id int, ts timestamp_ntz, price double")
    series = spark.createDataFrame([(1,), (7,)], "series_id int")
    lo = F.lit(START.date())
    out = serving.history_compare(actual, store.read_predictions(spark, two_versions), lo, lo, ["v", "g"], keys=S, series=series)
    scans = [x for x in plan_of(out).splitlines() if "PartitionFilters" in x and "model_version" in x]
    assert scans and all("target_date" in x.split("PartitionFilters:")[1] for x in scans)
    got = {(r.series_id, r.period): (r.actual, r.predicted) for r in out.collect()}
    assert len(got) == 2 * 96 and got[(1, 0)] == (3.0, 1.0) and got[(7, 5)] == (None, None)


def test_curve_of_the_latest_complete_day(spark, two_versions):
    out = serving.stored_day_curve(spark, two_versions, ["v"], keys=S, since=START.date())
    assert {(r.series_id, r.day) for r in out.collect()} == {(1, START.date() + timedelta(days=2)), (2, START.date())}
    assert serving.stored_day_curve(spark, two_versions, ["v"], keys=S, since=date(2100, 1, 1)).count() == 0
