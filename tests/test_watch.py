"""Runs, streaks, gaps filled by level, features that follow their grid, versions and compaction."""

import re
from datetime import date, datetime, timedelta

import pytest
from grid_helpers import START, at
from pyspark.sql import functions as F

from gridloom.bindings.q_watch import _local_features
from gridloom.operators import runs
from gridloom.plans import impute, incremental, promotion
from gridloom.sources import store
from gridloom.streaming import ingest


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """Broadcasts off, and the plan as it is before run time."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def exchanges(text):
    return [re.sub(r"#\d+L?", "", k) for k in re.findall(r"hashpartitioning\((.*?), \d+\)", text)]


# -- frozen runs -------------------------------------------------------------------------------------------------------

def frozen(df, **more):
    return sorted((r.series_id, r.value, r.first_ts, r.last_ts, r.n) for r in runs.frozen_runs(df, ["x"], series=["series_id"], **more).collect())


def test_a_run_across_two_chunk_borders_is_one_run(series):
    values = [1.0] * 90 + [7.0] * 200 + [2.0] * 5 + [3.0] * 7 + [4.0] * 82  # days of 96 steps: 7.0 covers a whole one
    got = frozen(series({1: values}), chunk_days=1)
    assert got == [(1, 1.0, at(0), at(89), 90), (1, 3.0, at(295), at(301), 7), (1, 4.0, at(302), at(383), 82), (1, 7.0, at(90), at(289), 200)]
    assert got == frozen(series({1: values}), chunk_days=56)


def test_nulls_gaps_and_borders_end_runs(series):
    values = [5.0] * 96 + [6.0] * 6 + [None] + [6.0] * 6 + [...] + [6.0] * 6 + [8.0, 9.0] * 10
    got = frozen(series({1: values}), chunk_days=1)
    assert [(v, n) for _, v, _, _, n in got] == [(5.0, 96), (6.0, 6), (6.0, 6), (6.0, 6)]


def test_null_series_and_empty_table(spark):
    rows = [(None, at(i), 2.0) for i in range(100)] + [(3, at(i), float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "series_id int, ts timestamp_ntz, x double")
    assert [(r.series_id, r.n) for r in runs.frozen_runs(df, ["x"], series=["series_id"], chunk_days=1).collect()] == [(None, 100)]
    assert runs.frozen_runs(df.limit(0), ["x"], series=["series_id"]).count() == 0


def test_no_window_spans_the_rows_of_a_series(series):
    text = plan(runs.frozen_runs(series({1: [1.0] * 200}), ["x"], series=["series_id"]))
    # rows are grouped with their chunk; what is ordered along a series are border runs, already aggregated
    assert text.count("Window [") >= 2 and "_chunk" in text


def test_sigma_breaks_keep_a_long_series_apart(spark, series, no_broadcast):
    out = runs.sigma_breaks(series({1: [float(i % 7) for i in range(300)] + [900.0]}), "x", series=["series_id"])
    joins = re.findall(r"SortMergeJoin \[(.*?)\]", plan(out))
    assert joins and all("_month" in j for j in joins)
    assert [(r.ts, r.value) for r in out.collect()] == [(at(300), 900.0)]


# -- staleness ---------------------------------------------------------------------------------------------------------

def test_sessions_and_stale_spans(spark):
    """An arrival just a gap after the last one still belongs to its session."""
    hours = [0, 1, 7, 13.5, 30]
    df = spark.createDataFrame([(START + timedelta(hours=h),) for h in hours], "fetch_time timestamp_ntz")
    found = runs.sessions(df)
    assert [(r.first, r.last, r.n) for r in found.orderBy("first").collect()] == [
        (START, START + timedelta(hours=7), 3), (START + timedelta(hours=13.5), START + timedelta(hours=13.5), 1), (START + timedelta(hours=30), START + timedelta(hours=30), 1)]
    spans = runs.stale_spans(found, as_of=F.lit("2024-01-02 08:00:00").cast("timestamp_ntz")).orderBy("stale_from").collect()
    assert [r.hours for r in spans] == [6.5, 16.5, 2.0]


# -- shadow promotion --------------------------------------------------------------------------------------------------

def scores(spark, wins, start=date(2024, 3, 1)):
    """wins: True, False or None (no shadow score that day)."""
    rows = [(1, v, start + timedelta(days=i), m) for i, w in enumerate(wins) for v, m in (("now", 10.0), ("shadow", None if w is None else 9.0 if w else 11.0)) if m is not None]
    return spark.createDataFrame(rows, "series_id int, model_version string, day date, mae double")


def streak(spark, wins, **more):
    out = promotion.streaks(scores(spark, wins), keys=["series_id"], active="now", shadow="shadow", **more)
    return {r.day.day: (r.streak, r.promoted) for r in out.collect()}


def test_seven_days_in_a_row(spark):
    got = streak(spark, [True] * 3 + [False] + [True] * 8)
    assert [got[d][0] for d in range(1, 13)] == [1, 2, 3, 0, 1, 2, 3, 4, 5, 6, 7, 8]
    assert [d for d in got if got[d][1]] == [11]


def test_a_missing_day_breaks_the_streak(spark):
    got = streak(spark, [True] * 6 + [None] + [True] * 6)
    assert 7 not in got and got[6] == (6, False) and got[8] == (1, False) and not any(p for _, p in got.values())


def test_a_critical_day_breaks_the_streak(spark):
    critical = spark.createDataFrame([(1, date(2024, 3, 4))], "series_id int, day date")
    got = streak(spark, [True] * 11, critical=critical)
    assert got[3][0] == 3 and got[4][0] == 0 and got[5][0] == 1 and [d for d in got if got[d][1]] == [11]


def test_promotion_and_rollback_change_the_registry(spark):
    wins = scores(spark, [True] * 9)
    worse = F.when((F.col("model_version") == "shadow") & (F.col("day") == F.lit(date(2024, 3, 9))), 9.99).otherwise(F.col("mae"))
    registry = spark.createDataFrame([(1, "a", "active"), (1, "b", "shadow"), (1, "c", "archived"), (2, "d", "active"), (2, "e", "shadow")], "series_id int, version_name string, status string")
    def after(df, **more):
        found = promotion.streaks(df, keys=["series_id"], active="now", shadow="shadow")
        done = promotion.promotions(found, keys=["series_id"], **more)
        return done.first(), {r.version_name: r.status for r in promotion.apply_promotions(registry, done, keys=["series_id"]).collect()}
    row, status = after(wins)
    assert row.promoted_on == date(2024, 3, 7) and row.rolled_back_on is None and status == {"a": "archived", "b": "active", "c": "archived", "d": "active", "e": "shadow"}
    row, status = after(wins.withColumn("mae", worse), worse_by=0.1)
    assert row.rolled_back_on == date(2024, 3, 9) and status["a"] == "active" and status["b"] == "shadow"


# -- gaps filled by level ----------------------------------------------------------------------------------------------

def test_levels_of_filling(series):
    day = [float(i) for i in range(96)]
    holed = [*day[:40], *[None] * 10, *day[50:]]
    flat = [1.0, None, *[2.0] * 94]
    values = day + holed + [v + 10 for v in day] + flat  # Monday to Thursday, 1 January is a holiday of its own kind
    out = {r.ts: (r.x, r.x_level) for r in impute.hierarchical_fill(series({1: values}, start=datetime(2024, 3, 4)), ["x"]).collect()}
    t = lambda i: at(i, datetime(2024, 3, 4))
    assert [out[t(96 + i)] for i in (39, 40, 43)] == [(39.0, 0), (39.0, 1), (39.0, 1)]
    assert out[t(96 + 44)] == (44.0, 2)  # measured on the other days: 44, 54 and 2
    assert out[t(3 * 96 + 1)] == (1.0, 1)


def test_what_no_level_fills_is_refused(series):
    out = impute.hierarchical_fill(series({1: [None, 1.0, 2.0]}), ["x"])
    assert sorted((r.ts, r.x_level) for r in out.collect()) == [(at(0), 3), (at(1), 0), (at(2), 0)]
    with pytest.raises(Exception, match="a model input is missing"):
        impute.refuse_nulls(out, ["x"]).collect()
    assert impute.refuse_nulls(out.where("x IS NOT NULL"), ["x"]).count() == 2


def test_medians_come_back_without_a_hot_key(spark, series, no_broadcast):
    text = plan(impute.hierarchical_fill(series({1: [1.0, None] * 300}), ["x"]))
    joined = [k for k in exchanges(text) if "_period" in k]
    assert "CartesianProduct" not in text and any("_month" in k for k in joined)


# -- features that follow their grid -----------------------------------------------------------------------------------

@pytest.fixture
def table(spark, tmp_path):
    """A grid of two series over 40 days and what a full build gives."""
    rows = [(s, at(i, datetime(2024, 1, 20)), float((i * 7 + s) % 101), float(i % 53)) for s in (1, 2) for i in range(40 * 96)]
    grid = spark.createDataFrame(rows, "series_id int, ts timestamp_ntz, price double, load double").cache()
    paths = {n: str(tmp_path / n) for n in ("grid", "features", "ledger")}
    refresh = lambda **more: incremental.refresh(spark, paths["grid"], paths["features"], more.pop("ledger", paths["ledger"]), _local_features, series=["series_id"], back=721, ahead=96, **more)
    return grid, paths, refresh


def rows_of(df):
    names = sorted(df.columns)
    return sorted(map(str, (tuple(r) for r in df.select(*names).collect())))


def test_appending_equals_one_full_build(spark, table):
    grid, paths, refresh = table
    for cut in [(0, 30), (30, 31), (31, 33), (33, 40)]:
        lo, hi = (datetime(2024, 1, 20) + timedelta(days=d) for d in cut)
        incremental.write_grid(grid.where((F.col("ts") >= F.lit(lo)) & (F.col("ts") < F.lit(hi))), paths["grid"])
        handled = refresh()
        assert handled.count() == 2 * (cut[1] - cut[0])
    built = spark.read.parquet(paths["features"]).drop("day")
    assert rows_of(built) == rows_of(_local_features(grid))
    assert refresh().count() == 0  # nothing left to do


def test_a_corrected_day_and_a_lost_ledger(spark, table, tmp_path):
    grid, paths, refresh = table
    incremental.write_grid(grid, paths["grid"])
    refresh()
    wrong = (F.col("series_id") == 2) & (F.to_date("ts") == F.lit("2024-02-11").cast("date"))
    fixed = grid.withColumn("price", F.when(wrong, 5000.0).otherwise(F.col("price")))
    store.overwrite_partitions(fixed.where(F.month("ts") == 2).withColumn("month", F.date_format("ts", "yyyy-MM")), paths["grid"], ["month"])
    assert [(r.series_id, r.day) for r in refresh().collect()] == [(2, date(2024, 2, 11))]
    want = rows_of(_local_features(fixed))
    assert rows_of(spark.read.parquet(paths["features"]).drop("day")) == want
    # a run that ended before its ledger was written is done again and changes nothing
    refresh(ledger=str(tmp_path / "other"))
    assert rows_of(spark.read.parquet(paths["features"]).drop("day")) == want


def test_old_months_are_not_scanned(spark, table):
    grid, paths, refresh = table
    incremental.write_grid(grid, paths["grid"])
    text = plan(incremental._grid(spark, paths["grid"], "ts", date(2024, 2, 5), date(2024, 2, 9)))
    assert re.search(r"PartitionFilters: \[.*month.*>= 2024-02.*\]", text)
    scanned = incremental._grid(spark, paths["grid"], "ts", date(2024, 2, 5)).inputFiles()
    assert scanned  # files of the table; the directories read follow from the partition filter
    refresh()
    marks = plan(incremental.pending_days(spark, paths["grid"], paths["ledger"], series=["series_id"], recheck_days=5))
    assert ">= 2024-02" in marks


# -- versions and change logs ------------------------------------------------------------------------------------------

def test_an_older_version_that_arrives_last_loses(spark, tmp_path):
    path = str(tmp_path / "t")
    def put(*rows):
        df = spark.createDataFrame([(*r, "p") for r in rows], "id int, value string, version int, part string")
        store.write_upsert(df, path, ["id", "part"], ["part"], F.col("version"), versioned=True)
    put((1, "new", 2), (2, "old", 0))
    put((1, "late", 1), (2, "newer", 1), (3, "first", 0))
    put((1, "again", 2))
    assert {r.id: r.value for r in spark.read.parquet(path).collect()} == {1: "again", 2: "newer", 3: "first"}


def test_a_compacted_change_log_reads_the_same(spark, tmp_path):
    path = str(tmp_path / "log")
    write = ingest._write_batch(path)
    for b, rows in enumerate([[(1, 10), (2, 20)], [(2, 21)], [(3, 30)]]):
        write(spark.createDataFrame(rows, "k int, v int"), b)
    before = rows_of(ingest.read_changelog(spark, path, ["k"]))
    assert ingest.compact_changelog(spark, path, ["k"]) == 2
    assert rows_of(ingest.read_changelog(spark, path, ["k"])) == before == rows_of(spark.read.parquet(path).drop("batch_id"))
    assert ingest.compact_changelog(spark, path, ["k"]) == 0
