"""Splits, folds, metrics, guard and the two-stage chain on a small synthetic grid."""

import dataclasses
import math
from datetime import date, datetime

import numpy as np
import pytest
from grid_helpers import START, at, column
from pyspark.sql import functions as F

from gridloom import dims
from gridloom.plans import features, metrics, splits, training

S = ["series_id"]


def days(spark, first, last):
    df = spark.sql(f"SELECT explode(sequence(date'{first}', date'{last}')) AS d")
    return df.select(F.lit(1).alias("series_id"), F.col("d").cast("timestamp_ntz").alias("ts"), F.lit(1.0).alias("y"))


def test_split_edges_cover_whole_days(spark):
    df = days(spark, "2026-01-01", "2026-06-30").withColumn("ts", F.col("ts") + F.expr("INTERVAL '23:45' HOUR TO MINUTE"))
    out = {r.ts.date(): r for r in splits.split_assign(df, label="y", windows=dims.split_windows(2026)).collect()}
    s = {d: r.split for d, r in out.items()}
    assert s[date(2026, 1, 1)] is None and s[date(2026, 1, 2)] == "train" and s[date(2026, 3, 15)] == "train"
    assert s[date(2026, 3, 16)] == "val" and s[date(2026, 4, 7)] == "val" and s[date(2026, 4, 30)] == "test"
    assert s[date(2026, 6, 6)] == "test" and s[date(2026, 6, 7)] == "train" and s[date(2026, 6, 23)] == "train"
    assert s[date(2026, 6, 24)] == "rolling" and out[date(2026, 6, 30)].is_rolling and not out[date(2026, 6, 23)].is_rolling


def test_rolling_days_inside_the_test_window(spark):
    df = days(spark, "2026-05-01", "2026-06-10").withColumn("y", F.when(F.col("ts") < F.lit("2026-06-05").cast("timestamp_ntz"), 1.0))
    out = {r.ts.date(): r for r in splits.split_assign(df, label="y", windows=dims.split_windows(2026)).collect()}
    assert out[date(2026, 6, 4)].split == "test" and out[date(2026, 6, 4)].is_rolling
    assert out[date(2026, 6, 5)].split is None and not out[date(2026, 6, 5)].is_rolling


@pytest.mark.parametrize("n,k", [(23, 5), (100, 3), (200, 4)])
def test_time_folds_follow_expanding_windows(series, n, k):
    df = series({1: [1.0] * n})
    got = column(splits.time_folds(df, k), "fold")
    size = n // (k + 1)
    want = np.full(n, -1)
    for i in range(k):
        want[n - (k - i) * size:n - (k - i - 1) * size if i < k - 1 else n] = i
    assert got == want.tolist()
    assert column(splits.time_folds(df, k), "is_late").count(False) == math.floor(0.85 * n)


def test_folds_keep_one_time_together(series):
    both = series({1: [1.0] * 40, 2: [1.0] * 40})
    per_time = splits.time_folds(both, 3).groupBy("ts").agg(F.count_distinct("fold").alias("n"))
    assert {r.n for r in per_time.collect()} == {1}


def test_metrics_match_their_definitions(spark):
    y, p = [1.0, 2.0, 4.0, 8.0], [1.5, 2.0, 3.0, 9.0]
    df = spark.createDataFrame([("a" if i < 2 else "b", y[i], p[i]) for i in range(4)] + [("b", None, 1.0), ("b", 1.0, None)], "g string, y double, p double")
    rows = {r.g: r for r in metrics.forecast_metrics(df, actual="y", predicted="p", part="g").collect()}
    ya, pa = np.array(y), np.array(p)
    assert rows["all"].n == 4 and math.isclose(rows["all"].mae, np.abs(ya - pa).mean())
    assert math.isclose(rows["all"].r2, 1 - ((ya - pa) ** 2).sum() / ((ya - ya.mean()) ** 2).sum())
    flat = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "y double, p double")
    assert metrics.forecast_metrics(flat, actual="y", predicted="p").first().r2 is None


def test_anchor_uses_the_lags_that_exist(spark):
    df = spark.createDataFrame([(1.0, 3.0), (1.0, None), (None, 3.0), (None, None)], "price_lag96 double, price_lag672 double")
    assert [r.anchor for r in metrics.price_anchor(df).collect()] == [2.0, 1.0, 3.0, None]


def test_robust_weights(spark):
    ys = [float(i) for i in range(-10, 11)]
    out = metrics.robust_weights(spark.createDataFrame([(y,) for y in ys], "y double"), "y").orderBy("y").collect()
    p80 = np.quantile(np.abs(ys), 0.8)
    np.testing.assert_allclose([r.weight for r in out], [1 / (1 + abs(y) / (p80 + 1e-6)) for y in ys])


def test_residual_histogram_like_numpy(spark):
    r = [0.0, 0.1, 0.2, 0.9, 1.0, 1.0, 0.5]
    rows = {x.bin: x.n for x in metrics.residual_histogram(spark.createDataFrame([(v,) for v in r], "r double"), "r", bins=4).collect()}
    assert rows == {i: n for i, n in enumerate(np.histogram(r, bins=4)[0]) if n}


def test_frame_diff(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 5.0)], "k int, x double, z double")
    b = spark.createDataFrame([(1, 1.5, 1.0), (2, 2.0, 5.0)], "k int, x double, z double")
    rows = {r.column: r for r in metrics.frame_diff(a, b, keys=["k"], cols=["x", "z"]).collect()}
    assert (rows["x"].n, rows["x"].max_diff, rows["x"].mean_diff, rows["x"].n_beyond) == (2, 0.5, 0.25, 1)
    assert (rows["z"].n, rows["z"].n_null_mismatch, rows["z"].n_beyond) == (1, 1, 0)
    assert [r.column for r in metrics.worst_columns(metrics.frame_diff(a, b, keys=["k"], cols=["x", "z"]), 1).collect()] == ["x"]


@pytest.mark.parametrize("season,n,model,anchor,lag,mode,reason", [
    ("dry", 500, 9.0, 1.0, 1.0, "model", "only_wet_guarded"), ("wet", 95, 9.0, 1.0, 1.0, "model", "insufficient_rolling_test"),
    ("wet", 96, None, 1.0, 1.0, "model", "insufficient_rolling_test"), ("wet", 96, 9.5, 10.0, 12.0, "model", "model_beats_recent_baseline"),
    ("wet", 96, 9.6, 12.0, 10.0, "lag96", "recent_lag96_baseline_wins"), ("wet", 96, 9.6, 10.0, 12.0, "blend", "recent_baseline_wins_blend"),
    ("wet", 96, 9.6, 10.0, 10.0, "blend", "recent_baseline_wins_blend"), ("wet", 96, 9.6, None, 10.0, "lag96", "recent_lag96_baseline_wins"),
    ("wet", 96, 9.6, None, None, "model", "no_valid_baseline")])
def test_guard_cases(spark, season, n, model, anchor, lag, mode, reason):
    df = spark.createDataFrame([(season, n, model, anchor, lag)], "season string, n long, model_mae double, anchor_mae double, lag96_mae double")
    r = training.guard_decision(df).first()
    assert (r.mode, r.reason, r.enabled) == (mode, reason, mode != "model")


def test_guard_apply(spark):
    policy = spark.createDataFrame([("dry", "model", "anchor", 0.3), ("wet", "blend", "anchor", 0.3), ("lag", "lag96", "lag96", 0.3)],
                                   "season string, mode string, best_baseline string, model_share double")
    rows = [("dry", 10.0, 20.0, 30.0), ("wet", 10.0, 20.0, 30.0), ("wet", None, 20.0, 30.0), ("wet", 10.0, None, 30.0), ("lag", 10.0, 20.0, 30.0), ("none", 10.0, 1.0, 1.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, season string, price_pred double, anchor double, price_lag96 double")
    out = training.guard_apply(df, policy).orderBy("i").collect()
    np.testing.assert_allclose([r.price_served for r in out], [10.0, 17.0, 20.0, 10.0, 30.0, 10.0])


def wave_grid(spark, first, n_days):
    steps = spark.range(n_days * 96)
    ts = F.lit(first).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("id") * 15).cast("int"))
    p = F.col("id") % 96
    day = F.sin(F.lit(2 * math.pi) * p / 96)
    cols = {"price": 300 + day * 80 + F.pmod(F.hash("id"), F.lit(20)), "load": 20000 + day * 3000, "solar": F.greatest(day * 4000, F.lit(0.0)),
            "wind": 1000 + F.pmod(F.hash("id") , F.lit(300)).cast("double"), "hydro": 9000 + day * 100, "bidspace": 8000 + day * 10, "reserve": 1.0 + day,
            "nonmarket": 500 + day, "tieline": -1.0 + day, "load_tie": 21000 + day, "renewable_total": 5000 + day}
    return steps.select(F.lit(1).alias("series_id"), ts.alias("ts"), *[v.cast("double").alias(k) for k, v in cols.items()])


def hourly_weather(spark, first, n_hours):
    ts = F.lit(first).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))
    return spark.range(n_hours).select(ts.alias("ts"), F.to_json(F.create_map(*[
        x for k in dims.weather_keys() for x in (F.lit(k), (20 + F.col("id") % 24).cast("double"))])).alias("variables"))


def test_feature_names_and_selections(spark):
    names = features.feature_names()
    assert len(names) == len(set(names)) == 185
    counts = {g: sum(n.startswith(g + "_") for n in names) for g in "ABCDEFGHIJKLMNOP"}
    assert counts == dict(A=12, B=14, C=10, D=25, E=4, F=14, G=6, H=4, I=1, J=6, K=19, L=16, M=2, N=18, O=16, P=18)
    safe = features.safe_columns(names)
    assert len(safe) == 79 and len(training.OOF) + len(safe) + len(training.INTERACTIONS) == 89
    assert {t: len(f) for t, f in features.STAGE1_FEATURES.items()} == {"solar": 36, "hydro": 45, "wind": 32, "load": 37}
    assert all(n in names for f in features.STAGE1_FEATURES.values() for n in f)
    assert "B_solar[t]" in features.topic_columns(names, "solar") and "F_period_cos_pp" in features.topic_columns(names, "solar")


def test_served_rows_see_the_weather_of_their_target(spark):
    grid = wave_grid(spark, "2026-01-10", 2)
    weather = hourly_weather(spark, "2026-01-10", 72)
    rows = features.build_features(grid, weather).where(F.col("ts") >= F.lit("2026-01-11").cast("timestamp_ntz"))
    bad = rows.where((F.abs(F.col("D_temp_avg_pp") - (20 + F.hour("ts"))) > 1e-9) | (F.col("F_is_dry_season_pp") != 1.0)).count()
    assert rows.count() == 96 and bad == 0


def test_chunk_border_does_not_change_features(spark, monkeypatch):
    """The same rows with windows cut every two days or not at all."""
    from gridloom.operators import chunked

    grid, weather = wave_grid(spark, "2026-01-10", 12), hourly_weather(spark, "2026-01-10", 13 * 24)
    whole = features.build_features(grid, weather)
    original = chunked.chunk_windows
    monkeypatch.setattr(features, "chunk_windows", lambda df, phases, **kw: original(df, phases, **{**kw, "chunk_days": 2}))
    cut = features.build_features(grid, weather)
    diff = metrics.frame_diff(whole, cut, keys=["series_id", "ts"], cols=features.feature_names(), tolerance=1e-5)
    assert diff.agg(F.sum("n_beyond"), F.min("n")).first() == (0, 12 * 96)


def test_rows_without_a_season_are_served(spark):
    feats = features.build_features(wave_grid(spark, "2026-09-28", 9), hourly_weather(spark, "2026-09-28", 9 * 24))
    pred = training.two_stage_predict(feats, {}, {})
    autumn = pred.where(F.month("ts") == 10)
    assert pred.count() == 9 * 96 and autumn.count() == 6 * 96
    assert autumn.where("predicted_price = 0 AND resid_pred IS NULL").count() == 6 * 96


def test_two_stage_chain(spark, tmp_path):
    """Train both stages on two seasons, save and load, serve with the guard."""
    from gridloom.plans import jobs
    from gridloom.session import materialise

    grid = wave_grid(spark, "2026-04-15", 30)
    obs = hourly_weather(spark, "2026-04-15", 30 * 24)
    windows = [dims.SplitWindow("dry", (date(2026, 4, 16), date(2026, 4, 26)), (date(2026, 4, 27), date(2026, 4, 28)), (date(2026, 4, 29), date(2026, 4, 30))),
               dims.SplitWindow("wet", (date(2026, 5, 1), date(2026, 5, 5)), (date(2026, 5, 6), date(2026, 5, 6)), (date(2026, 5, 7), date(2026, 5, 7)))]
    settings = dataclasses.replace(training.Settings().with_trees(1, 1), stage1_folds=1, stage2_folds={"dry": 1, "wet": 1}, threads=8)
    out = jobs.retrain(grid, obs, windows=windows, settings=settings)
    assert len(out["stage1"]) == 8 and len(out["stage2"]) == 6
    assert out["report"].where("segment = 'all' AND split = 'test'").count() == 2
    keys = list(out["stage2"])
    training.save_models(out["stage2"], str(tmp_path / "m"))
    loaded = training.load_models(str(tmp_path / "m"), keys)
    feats = materialise(features.build_features(grid, obs), "features")
    pred = training.two_stage_predict(feats, out["stage1"], loaded, policy=out["policy"])
    stats = pred.agg(F.count("*"), F.count("predicted_price"), F.min("predicted_price")).first()
    assert stats[0] == stats[1] == 30 * 96
    runs = spark.createDataFrame([], "fetch_time timestamp_ntz, target_time timestamp_ntz, variables string")
    stored = jobs.daily_inference(grid, obs, runs, as_of=F.lit("2026-06-01").cast("timestamp_ntz"), models=(out["stage1"], loaded),
                                  gap_models=(out["stage1"], loaded), path=str(tmp_path / "p"), version="v1", policy=out["policy"])
    by = {(r.model_version, str(r.target_date)): r["count"] for r in stored.groupBy("model_version", "target_date").count().collect()}
    assert by == {("v1", "2026-05-15"): 96, ("v1_lag192", "2026-05-16"): 96, ("v1_lag192", "2026-05-17"): 96}
    jobs.backfill(feats, jobs.by_models(out["stage1"], loaded, policy=out["policy"]), path=str(tmp_path / "h"), ledger_path=str(tmp_path / "l"),
                  run="r", version="v1", step_days=20)
    history = spark.read.parquet(str(tmp_path / "h"))
    assert history.count() == 30 * 96 == history.select("target_time").distinct().count()
    served = pred.select("target_time", F.col("predicted_price").alias("price"))
    assert history.join(served, "target_time").where("abs(predicted_price - price) < 1e-9").count() == 30 * 96


def test_model_queries_fit_all_folds_and_rows(spark, monkeypatch):
    from gridloom.bindings import q_models

    days = ["2024-01-10", "2024-06-20", "2024-06-29", "2024-09-30", "2024-12-31"]
    frame = spark.createDataFrame([(1, d, 1.0, "x") for d in days], "series_id int, ts string, y_price double, season string")
    frame = frame.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    monkeypatch.setattr(q_models, "year_features", lambda *_: frame)
    used = []
    monkeypatch.setattr(q_models, "_DONE", {})
    monkeypatch.setattr(training, "train_stage1", lambda df, settings: used.append(settings) or ({}, df))
    q_models.stage1(spark, "full")
    # all folds; the trees are those the module names, the other settings of a tree are the original ones
    (settings,), full = used, training.Settings()
    assert (settings.stage1_folds, settings.stage2_folds) == (full.stage1_folds, full.stage2_folds)
    assert all(b == dataclasses.replace(full.stage1[k], rounds=q_models.TREES[0]) for k, b in settings.stage1.items()) and settings.forest["numTrees"] == q_models.TREES[1]
    rows = {str(r.ts.date()): r for r in q_models.labelled(spark, "full").collect()}
    assert sorted(rows) == days and rows["2024-06-29"].is_rolling and not rows["2024-06-20"].is_rolling and rows["2024-12-31"].split is None


@pytest.mark.parametrize("name", ["oof_predict", "stage2_train", "two_stage_predict"])
def test_model_queries_fit_all_trees(spark, monkeypatch, name):
    """Both stages are fitted with the original number of trees."""
    from gridloom.bindings import q_models

    frame = spark.createDataFrame([(1, "a", 1)], "series_id int, ts string, period int")
    used = []
    monkeypatch.setattr(q_models, "_DONE", {})
    monkeypatch.setattr(q_models, "year_features", lambda *_: frame)
    monkeypatch.setattr(q_models, "labelled", lambda *_: frame)
    for step in ("train_stage1", "train_stage2"):
        monkeypatch.setattr(training, step, lambda df, settings: used.append(settings) or ({}, frame.select("series_id", "ts")))
    for module, step in ((metrics, "forecast_metrics"), (training, "guard_decision"), (training, "rolling_scores"), (training, "two_stage_predict")):
        monkeypatch.setattr(module, step, lambda *_, **__: None)
    monkeypatch.setattr(q_models, "segment_of", lambda *_: F.lit("base"))
    getattr(q_models, name)(spark, "whole")
    full = training.Settings()
    assert len(used) == (1 if name == "oof_predict" else 2)
    assert all((s.stage1, s.stage2, s.forest, s.stage1_folds, s.stage2_folds) == (full.stage1, full.stage2, full.forest, full.stage1_folds, full.stage2_folds) for s in used)


def test_rows_that_lack_an_input_are_scored_as_unknown(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import GBTRegressor

    names = training.STAGE1_FEATURES["solar"]
    rows = spark.createDataFrame([(i, float(i % 7)) for i in range(60)], "id int, label double").select(
        "id", "label", *[(F.col("label") + k).alias(n) for k, n in enumerate(names)])
    tree = GBTRegressor(maxIter=2, featuresCol="features", labelCol="label", predictionCol="raw")
    model = Pipeline(stages=[training._assembler(names), tree]).fit(rows)
    holed = rows.withColumn(names[0], F.when(F.col("id") == 1, None).when(F.col("id") == 2, float("nan")).otherwise(F.col(f"`{names[0]}`")))
    got = {r.id: r.oof_solar for r in training.predict_stage1(holed, {("solar", "dry"): model}, "dry").select("id", "oof_solar").collect()}
    assert len(got) == 60 and {i for i, v in got.items() if v is None} == {1, 2}
