"""Feature frame, export table, splits, metrics."""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import functions as F

from gridloom import dims
from gridloom.bindings import tables as t
from gridloom.bindings.ctes import W, ora, period_of
from gridloom.bindings.feature_sql import BASE_TABLE_SQL, DIGITS, FEATURE_NAMES, feature_views
from gridloom.bindings.registry import query, steady_col
from gridloom.functions.timegrid import col
from gridloom.plans import base_table as bt
from gridloom.plans import features, metrics, splits, training
from gridloom.session import materialise, work_path
from gridloom.sources import store

S = t.SERIES
FESTIVAL = date(2024, 1, 12)
#: Last day of the rolling window, so that the wet-season models are scored on recent rows.
AS_OF = date(2024, 6, 30)
WINDOWS = dims.split_windows(2024)


def sample_features(spark, sf, lag_steps=0):
    # read several times by the plan (cut-offs, windows): written once
    grid = materialise(t.grid(spark, sf), "grid")
    return features.build_features(grid, t.weather(spark, sf), lag_steps=lag_steps, festival=FESTIVAL)


def _tidy(df):
    """Irrational values rounded, sums and means of whole cents left exact."""
    value = lambda n: col(n) if DIGITS[n] is None else steady_col(col(n), DIGITS[n])
    return df.select(*S, "ts", *[value(n).alias(n) for n in FEATURE_NAMES])


_FEATURES = "SELECT series_id, ts, " + ", ".join(f'"{n}"' for n in FEATURE_NAMES) + " FROM feats"


@query("feature_matrix", ora(_FEATURES, "grid", "weather", **feature_views(0)))
def feature_matrix(spark, sf):
    """All 185 columns of every row."""
    return _tidy(sample_features(spark, sf))


@query("feature_matrix_lag192", ora(_FEATURES, "grid", "weather", **feature_views(192)))
def feature_matrix_lag192(spark, sf):
    return _tidy(sample_features(spark, sf, 192))


@query("select_by_rule", ora("SELECT series_id, ts, " + ", ".join(f'"{n}"' for n in features.safe_columns(FEATURE_NAMES)) + " FROM feats", "grid", "weather", **feature_views(0)))
def select_by_rule(spark, sf):
    return features.select_by_rule(_tidy(sample_features(spark, sf)), keep=["series_id", "ts"])


_J = [n for n in FEATURE_NAMES if n.startswith("J_")]


@query("interactions", ora("SELECT series_id, ts, " + ", ".join(f'"{n}"' for n in _J) + " FROM feats", "grid", "weather", **feature_views(0)))
def interactions(spark, sf):
    return _tidy(sample_features(spark, sf)).select("series_id", "ts", *_J)


@query("feature_store", ora("SELECT series_id, ts, 'dry' AS season, \"A_price_lag_96\", \"B_load[t]\", \"O_wind_lag_192\" FROM feats WHERE month(ts) <= 4", "grid", "weather", **feature_views(0)))
def feature_store(spark, sf):
    path = work_path(spark, "features")
    store.write_features(sample_features(spark, sf), path)
    return store.read_features(spark, path, "dry").select("series_id", "ts", "season", "A_price_lag_96", col("B_load[t]"), "O_wind_lag_192")


@query("base_table", BASE_TABLE_SQL)
def base_table(spark, sf):
    out = bt.base_table(t.gap_grid(spark, sf), t.weather_obs(spark, sf), series=S, festival=FESTIVAL)
    rounded = [c for c in out.columns if any(k in c for k in ("_", "CDD", "HDD")) and c not in ("series_id", "datetime_bj")]
    return out.select(*[(steady_col(col(c), 5) if c in rounded else col(c)).alias(c) for c in out.columns])


def _d(x):
    return f"DATE '{x.isoformat()}'"


def _split_sql() -> str:
    newest = f"(SELECT max(CAST(ts AS DATE)) FROM split_in WHERE y_price IS NOT NULL AND CAST(ts AS DATE) <= {_d(AS_OF)})"
    season = "CASE WHEN month(ts) BETWEEN 1 AND 4 THEN 'dry' WHEN month(ts) BETWEEN 5 AND 6 THEN 'wet' END"
    arms = ""
    for w in WINDOWS:
        span = lambda s: f"day BETWEEN {_d(s[0])} AND {_d(s[1])}"
        arms += (f" WHEN season = '{w.season}' THEN CASE WHEN {span(w.val)} THEN 'val' WHEN {span(w.test)} THEN 'test' WHEN day > newest - 7 THEN 'rolling' "
                 f"WHEN {span(w.train)} OR (day > {_d(w.test[1])} AND day <= newest - 7) THEN 'train' END")
    return (f"SELECT *, CASE WHEN y_price IS NOT NULL THEN CASE {arms} END END AS split, y_price IS NOT NULL AND season IS NOT NULL AND day > newest - 7 AS is_rolling "
            f"FROM (SELECT *, CAST(ts AS DATE) AS day, {season} AS season, {newest} AS newest FROM split_in)")


_SPLIT = _split_sql()


def _split(spark, sf):
    return splits.split_assign(t.split_inputs(spark, sf), label="y_price", windows=WINDOWS, as_of=AS_OF)


@query("split_assign", ora("SELECT series_id, ts, season, split, is_rolling FROM sp", "split_in", sp=_SPLIT))
def split_assign(spark, sf):
    return _split(spark, sf).select("series_id", "ts", "season", "split", "is_rolling")


@query("split_intersect", ora("SELECT series_id, ts FROM sp WHERE split = 'train' INTERSECT SELECT series_id, ts FROM sp WHERE price_lag96 IS NOT NULL AND price_lag672 IS NOT NULL", "split_in", sp=_SPLIT))
def split_intersect(spark, sf):
    rows = _split(spark, sf)
    train = rows.where(F.col("split") == "train").select("series_id", "ts")
    valid = rows.where(F.col("price_lag96").isNotNull() & F.col("price_lag672").isNotNull()).select("series_id", "ts")
    return train.intersect(valid)


def _fold_sql(k: int) -> str:
    return (f"SELECT series_id, ts, position, CAST(CASE WHEN position < n - (n // {k + 1}) * {k} THEN -1 ELSE (position - (n - (n // {k + 1}) * {k})) // (n // {k + 1}) END AS INTEGER) AS fold, "
            "position >= floor(n * 0.85::DOUBLE) AS is_late FROM (SELECT series_id, ts, dense_rank() OVER (ORDER BY ts) - 1 AS position, (SELECT count(DISTINCT ts) FROM raw_grid) AS n FROM raw_grid)")


@query("time_folds", ora(_fold_sql(5), "raw_grid"))
def time_folds(spark, sf):
    return splits.time_folds(t.raw_grid(spark, sf).select("series_id", "ts"), 5)


@query("price_anchor", ora(
    "SELECT series_id, ts, price_lag96, price_lag672, CASE WHEN price_lag96 IS NULL THEN price_lag672 WHEN price_lag672 IS NULL THEN price_lag96 ELSE (price_lag96 + price_lag672) / 2 END AS anchor FROM split_in", "split_in"))
def price_anchor(spark, sf):
    return metrics.price_anchor(t.split_inputs(spark, sf)).select("series_id", "ts", "price_lag96", "price_lag672", "anchor")


def _scored(spark, sf):
    """Naive forecast (value at t) beside anchor and lag, with segment and season."""
    from gridloom.functions.calendar import period, segment_of, serving_season

    rows = metrics.price_anchor(t.split_inputs(spark, sf))
    return rows.select("series_id", "ts", "y_price", F.col("price").alias("price_pred"), "anchor", "price_lag96",
                       serving_season(F.col("ts")).alias("season"), segment_of(period(F.col("ts"))).alias("segment"))


_SCORED = ("SELECT series_id, ts, y_price, price AS price_pred, CASE WHEN price_lag96 IS NULL THEN price_lag672 WHEN price_lag672 IS NULL THEN price_lag96 ELSE (price_lag96 + price_lag672) / 2 END AS anchor, price_lag96, "
           "CASE WHEN month(ts) BETWEEN 1 AND 4 THEN 'dry' WHEN month(ts) BETWEEN 5 AND 9 THEN 'wet' END AS season, "
           f"CASE WHEN {period_of()} <= 35 OR {period_of()} >= 88 THEN 'base' WHEN {period_of()} <= 67 THEN 'valley' ELSE 'peak' END AS segment FROM split_in")


@query("forecast_metrics", ora(
    "SELECT season, coalesce(segment, 'all') AS segment, n, mae, r2 FROM (SELECT season, segment, count(*) AS n, avg(abs(y_price - price_pred)) AS mae, "
    "round(1 - sum((y_price - price_pred) * (y_price - price_pred)) / (var_pop(y_price) * count(*)), 8) AS r2 FROM scored WHERE y_price IS NOT NULL AND price_pred IS NOT NULL GROUP BY GROUPING SETS ((season), (season, segment)))",
    "split_in", scored=_SCORED))
def forecast_metrics(spark, sf):
    out = metrics.forecast_metrics(_scored(spark, sf), actual="y_price", predicted="price_pred", by=["season"], part="segment")
    return out.withColumn("r2", F.round("r2", 8))


@query("baseline_metrics", ora(
    "SELECT season, count(*) AS n, avg(abs(y_price - anchor)) AS mae_anchor, avg(abs(y_price - price_lag96)) AS mae_lag96 FROM scored WHERE y_price IS NOT NULL AND anchor IS NOT NULL AND price_lag96 IS NOT NULL GROUP BY 1", "split_in", scored=_SCORED))
def baseline_metrics(spark, sf):
    return metrics.baseline_metrics(_scored(spark, sf), actual="y_price", anchor="anchor", lag96="price_lag96", by=["season"])


@query("robust_weights", ora(
    "SELECT series_id, ts, season, resid, round(1 / (1 + abs(resid) / (quantile_cont(abs(resid), 0.8) OVER (PARTITION BY season) + 0.000001::DOUBLE)), 9) AS weight FROM "
    "(SELECT series_id, ts, season, y_price - anchor AS resid FROM scored WHERE y_price IS NOT NULL AND anchor IS NOT NULL AND season IS NOT NULL)", "split_in", scored=_SCORED))
def robust_weights(spark, sf):
    rows = _scored(spark, sf).select("series_id", "ts", "season", (F.col("y_price") - F.col("anchor")).alias("resid"))
    rows = rows.where(F.col("resid").isNotNull() & F.col("season").isNotNull())
    return metrics.robust_weights(rows, "resid", by=["season"]).withColumn("weight", F.round("weight", 9))


@query("residual_hist", ora(
    "SELECT season, round(mean, 6) AS mean, round(sigma, 4) AS sigma, bin, count(*) AS n FROM (SELECT season, mean, sigma, CAST(least(floor((r - lo) / ((hi - lo) / 60)), 59) AS INTEGER) AS bin FROM "
    "(SELECT season, y_price - price_pred AS r, min(y_price - price_pred) OVER s AS lo, max(y_price - price_pred) OVER s AS hi, avg(y_price - price_pred) OVER s AS mean, stddev_pop(y_price - price_pred) OVER s AS sigma "
    "FROM scored WHERE y_price IS NOT NULL AND price_pred IS NOT NULL AND season IS NOT NULL WINDOW s AS (PARTITION BY season))) GROUP BY ALL", "split_in", scored=_SCORED))
def residual_hist(spark, sf):
    rows = _scored(spark, sf).where(F.col("season").isNotNull()).withColumn("resid", F.col("y_price") - F.col("price_pred"))
    out = metrics.residual_histogram(rows, "resid", bins=60, by=["season"])
    return out.withColumns({"mean": F.round("mean", 6), "sigma": F.round("sigma", 4)})


@query("frame_diff", ora(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(abs(a.{c} - b.{c})) AS n, max(abs(a.{c} - b.{c})) AS max_diff, avg(abs(a.{c} - b.{c})) AS mean_diff, count(CASE WHEN abs(a.{c} - b.{c}) > 0.000001 THEN 1 END) AS n_beyond, "
        f"count(CASE WHEN (a.{c} IS NULL) <> (b.{c} IS NULL) THEN 1 END) AS n_null_mismatch FROM gap_grid a JOIN grid b ON b.series_id = a.series_id AND b.ts = a.ts + INTERVAL 15 MINUTE"
        for c in ("price", "load", "solar")), "gap_grid", "grid"))
def frame_diff(spark, sf):
    """The filled grid one step later against the grid with gaps."""
    later = t.grid(spark, sf).withColumn("ts", F.col("ts") - F.expr("INTERVAL 15 MINUTES"))
    return metrics.frame_diff(t.gap_grid(spark, sf), later, keys=["series_id", "ts"], cols=["price", "load", "solar"])


@query("worst_columns", ora(
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", max(abs(a.{c} - b.{c})) AS max_diff FROM gap_grid a JOIN grid b ON b.series_id = a.series_id AND b.ts = a.ts + INTERVAL 15 MINUTE" for c in dims.CHANNELS)
    + ") ORDER BY max_diff DESC, 1 LIMIT 5", "gap_grid", "grid"))
def worst_columns(spark, sf):
    later = t.grid(spark, sf).withColumn("ts", F.col("ts") - F.expr("INTERVAL 15 MINUTES"))
    diff = metrics.frame_diff(t.gap_grid(spark, sf), later, keys=["series_id", "ts"], cols=dims.CHANNELS)
    return metrics.worst_columns(diff, 5).select("column", "max_diff")


_RECENT = "SELECT *, CAST(ts AS DATE) AS day FROM scored WHERE season IS NOT NULL"
_SCORES = ("SELECT season, count(CASE WHEN y_price IS NOT NULL AND price_pred IS NOT NULL THEN 1 END) AS n, avg(abs(y_price - price_pred)) AS model_mae, "
           "avg(CASE WHEN anchor IS NOT NULL AND price_lag96 IS NOT NULL THEN abs(y_price - anchor) END) AS anchor_mae, avg(CASE WHEN anchor IS NOT NULL AND price_lag96 IS NOT NULL THEN abs(y_price - price_lag96) END) AS lag96_mae FROM scored "
           "WHERE season IS NOT NULL GROUP BY 1")
_POLICY = ("SELECT *, mode <> 'model' AS enabled, 0.3::DOUBLE AS model_share FROM (SELECT *, CASE WHEN reason = 'recent_lag96_baseline_wins' THEN 'lag96' WHEN reason = 'recent_baseline_wins_blend' THEN 'blend' ELSE 'model' END AS mode FROM "
           "(SELECT season, n, model_mae, anchor_mae, lag96_mae, CASE WHEN anchor_mae <= lag96_mae THEN 'anchor' ELSE 'lag96' END AS best_baseline, round(least(anchor_mae, lag96_mae) * (1 - 0.05::DOUBLE), 2) AS required_model_mae, "
           "CASE WHEN season <> 'wet' THEN 'only_wet_guarded' WHEN n < 96 THEN 'insufficient_rolling_test' WHEN model_mae <= least(anchor_mae, lag96_mae) * (1 - 0.05::DOUBLE) THEN 'model_beats_recent_baseline' "
           "WHEN anchor_mae > lag96_mae THEN 'recent_lag96_baseline_wins' ELSE 'recent_baseline_wins_blend' END AS reason FROM scores))")


def _policy(spark, sf):
    scored = _scored(spark, sf).where(F.col("season").isNotNull()).withColumn("is_rolling", F.lit(True))
    return training.guard_decision(training.rolling_scores(scored))


@query("guard_decision", ora("SELECT * FROM policy", "split_in", scored=_SCORED, scores=_SCORES, policy=_POLICY))
def guard_decision(spark, sf):
    return _policy(spark, sf)


@query("guard_apply", ora(
    "SELECT s.series_id, s.ts, s.season, s.price_pred, round(CASE WHEN p.mode = 'model' THEN s.price_pred WHEN b IS NULL THEN s.price_pred WHEN s.price_pred IS NULL THEN b ELSE share * s.price_pred + (1 - share) * b END, 6) AS price_served FROM "
    "(SELECT s.*, CASE WHEN p.mode = 'lag96' OR p.best_baseline = 'lag96' THEN s.price_lag96 ELSE s.anchor END AS b, CASE WHEN p.mode = 'lag96' THEN 0 ELSE p.model_share END AS share FROM scored s JOIN policy p ON p.season = s.season) s JOIN policy p ON p.season = s.season",
    "split_in", scored=_SCORED, scores=_SCORES, policy=_POLICY))
def guard_apply(spark, sf):
    rows = _scored(spark, sf).where(F.col("season").isNotNull())
    out = training.guard_apply(rows, _policy(spark, sf))
    return out.select("series_id", "ts", "season", "price_pred", F.round("price_served", 6).alias("price_served"))
