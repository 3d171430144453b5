"""Two-stage seasonal forecasting with Spark ML.

Stage 1 predicts solar, hydro, wind and load one day ahead, stage 2 the price as
a correction of a lag anchor. Out-of-fold predictions of stage 1 feed stage 2.
Frames carry rows from fit to fit; nothing but model objects and one-row metric
tables lives on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import calendar
from gridloom.functions.timegrid import col
from gridloom.plans import metrics
from gridloom.plans.features import STAGE1_FEATURES, safe_columns
from gridloom.plans.splits import time_folds
from gridloom.session import materialise

TARGETS = ["solar", "hydro", "wind", "load"]
SEASONS = ["dry", "wet"]
SEGMENTS = ["valley", "peak", "base"]
RESIDUAL_TARGETS = {"hydro", "load"}      # predicted as a change from the value at t
SEED = 42
OOF = [f"oof_{t}" for t in TARGETS]
INTERACTIONS = ["int_solar_period", "int_solar_valley", "int_load_peak", "int_solar_load", "int_renew_valley", "int_load_period"]


@dataclass(frozen=True)
class Boost:
    """Boosted-tree settings; `rounds` is the number of trees."""

    rounds: int
    depth: int
    subsample: float
    columns: float
    leaf: int
    step: float = 0.03

    def estimator(self, **kw) -> GBTRegressor:
        return GBTRegressor(maxIter=self.rounds, maxDepth=self.depth, stepSize=self.step, subsamplingRate=self.subsample,
                            featureSubsetStrategy=str(self.columns), minInstancesPerNode=self.leaf, seed=SEED,
                            featuresCol="features", cacheNodeIds=False, **kw)


# fixed values: tree settings per season, target and segment
STAGE1_BOOST = {
    ("dry", "hydro"): Boost(300, 5, 0.80, 0.75, 8), ("wet", "hydro"): Boost(200, 3, 0.75, 0.70, 12),
    "dry": Boost(500, 5, 0.85, 0.80, 3), "wet": Boost(300, 3, 0.80, 0.75, 5),
}
STAGE2_BOOST = {
    "valley": Boost(300, 3, 0.80, 0.75, 10), "peak": Boost(300, 3, 0.80, 0.75, 10), "base": Boost(300, 4, 0.80, 0.80, 8),
}
FOREST = {"numTrees": 100, "maxDepth": 5, "minInstancesPerNode": 10}
STAGE1_FOLDS = 5
STAGE2_FOLDS = {"dry": 5, "wet": 3}
MIN_SEGMENT_ROWS = 50


@dataclass(frozen=True)
class Settings:
    """Trees and folds of all fits; rows of a fit are dealt into tasks of `rows_per_task`."""

    stage1: Mapping = field(default_factory=lambda: STAGE1_BOOST)
    stage2: Mapping = field(default_factory=lambda: STAGE2_BOOST)
    forest: Mapping = field(default_factory=lambda: FOREST)
    stage1_folds: int = STAGE1_FOLDS
    stage2_folds: Mapping = field(default_factory=lambda: STAGE2_FOLDS)
    threads: int = 4
    rows_per_task: int = 50_000

    def with_trees(self, boosted: int, forest: int) -> Settings:
        """The same with so many trees in each model; folds and rows stay."""
        fewer = lambda held: {k: replace(b, rounds=boosted) for k, b in held.items()}
        return replace(self, stage1=fewer(self.stage1), stage2=fewer(self.stage2), forest={**self.forest, "numTrees": forest})


@contextmanager
def _dealt(df: DataFrame, rows_per_task: int) -> Iterator[DataFrame]:
    """The rows held in as few partitions as they need: a round of a small fit costs scheduling, not work."""
    held = df.persist()
    try:
        yield held.coalesce(max(1, -(-held.count() // rows_per_task)))
    finally:
        held.unpersist()


def _parallel(jobs: Sequence[Callable], threads: int) -> list:
    """Independent fits as concurrent Spark jobs."""
    with ThreadPoolExecutor(max_workers=max(1, threads)) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")


def _score(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    """Add a model's raw prediction to every row; null where an input is missing, a row the fitted assembler would leave out."""
    assembler = model.stages[0].copy({model.stages[0].handleInvalid: "keep"})
    known = [col(c).isNotNull() & ~F.isnan(col(c).cast("double")) for c in assembler.getInputCols()]
    out = model.stages[-1].transform(assembler.transform(df))
    return out.withColumn(name, F.when(reduce(lambda a, b: a & b, known), F.col("raw"))).drop("features", "raw")


# --- stage 1 -----------------------------------------------------------------

def stage1_anchor(target: str) -> Column:
    """The value at t, the same in training and serving; zero for directly predicted targets."""
    return col(f"B_{target}[t]") if target in RESIDUAL_TARGETS else F.lit(0.0)


def _stage1_estimator(target: str, season: str, features: Sequence[str], settings: Settings) -> Pipeline:
    boost = settings.stage1.get((season, target), settings.stage1[season])
    return Pipeline(stages=[_assembler(features), boost.estimator(labelCol="label", predictionCol="raw")])


def stage1_rows(df: DataFrame, target: str, season: str) -> DataFrame:
    """Labelled rows of a season with only the columns one target needs (the assembler blocks pruning)."""
    features = [f for f in STAGE1_FEATURES[target] if f in df.columns]
    keys = [c for c in ("series_id", "ts", "split") if c in df.columns]
    rows = df.where((F.col("season") == season) & col(f"y_{target}").isNotNull())
    anchor = stage1_anchor(target)
    return rows.select(*keys, *[col(f) for f in features], anchor.alias("anchor1"),
                       (col(f"y_{target}") - anchor).alias("label"))


def train_stage1(df: DataFrame, *, settings: Settings = Settings(), targets: Sequence[str] = tuple(TARGETS),
                 seasons: Sequence[str] = tuple(SEASONS), folds: bool = True) -> tuple[dict[tuple[str, str], PipelineModel], DataFrame | None]:
    """Fit every target and season; returns the models and the out-of-fold table (without `folds`, the final models alone).

    The table has (series_id, ts) and `oof_*`. Train and validation rows carry the
    prediction of the fold that did not see them (null in the first block, which no
    fold tests), test and rolling rows that of the final model.
    """
    keys = ["series_id", "ts"]
    models: dict[tuple[str, str], PipelineModel] = {}
    parts: dict[str, list[DataFrame]] = {t: [] for t in targets}
    with ExitStack() as held:
        def prepare(target: str, season: str):
            rows = stage1_rows(df, target, season)
            labelled = time_folds(rows.where(F.col("split").isin("train", "val")), settings.stage1_folds)
            seen = held.enter_context(_dealt(labelled, settings.rows_per_task))
            return (target, season), rows, None if seen.isEmpty() else seen

        def fit(key: tuple[str, str], rows: DataFrame, seen: DataFrame, k: int | None):
            """The final model, or that of fold `k`, which is let go once its rows are written."""
            target, season = key
            features = [f for f in STAGE1_FEATURES[target] if f in df.columns]
            model = _stage1_estimator(target, season, features, settings).fit(seen if k is None else seen.where(F.col("fold") < k))
            if not folds:
                return model, None
            scored = rows.where(F.col("split").isin("test", "rolling")) if k is None else seen.where(F.col("fold") == k)
            return model if k is None else None, materialise(_stage1_apply(model, scored, target), "fold")

        ready = [r for r in _parallel([lambda t=t, s=s: prepare(t, s) for t in targets for s in seasons], settings.threads) if r[2] is not None]
        each = [None, *(reversed(range(settings.stage1_folds)) if folds else ())]      # those of the most rows first
        tasks = [(r, k) for k in each for r in ready]
        fitted = _parallel([lambda r=r, k=k: fit(*r, k) for r, k in tasks], settings.threads)
        done = {(r[0], k): f for (r, k), f in zip(tasks, fitted)}
        for key, *_ in ready:
            models[key] = done[key, None][0]
            if folds:
                outs = [done[key, k][1] for k in (*range(settings.stage1_folds), None)]
                parts[key[0]].append(materialise(_union(outs), "oof"))
    table = None
    for t in targets:
        if parts[t]:
            one_target = _union(parts[t])
            table = one_target if table is None else table.join(one_target, keys, "full")
    return models, table


def _stage1_apply(model: PipelineModel, rows: DataFrame, target: str) -> DataFrame:
    return model.transform(rows).select("series_id", "ts", (F.col("raw") + F.col("anchor1")).alias(f"oof_{target}"))


def predict_stage1(df: DataFrame, models: dict[tuple[str, str], PipelineModel], season: str) -> DataFrame:
    """Add `oof_*` of one season's models; a target without a model stays null."""
    for t in TARGETS:
        model = models.get((t, season))
        if model is None:
            df = df.withColumn(f"oof_{t}", F.lit(None).cast("double"))
        else:
            df = _score(model, df, f"oof_{t}").withColumn(f"oof_{t}", F.col(f"oof_{t}") + stage1_anchor(t))
    return df


# --- stage 2 -----------------------------------------------------------------

def interactions(df: DataFrame, *, period: str = "period") -> DataFrame:
    """Products of the stage-1 outputs with the time of day and the segments."""
    p = col(period)
    _, cos = calendar.cyclic(p, 96)
    valley, peak = calendar.flag(p.between(36, 67)), calendar.flag(p.between(68, 87))
    s, w, l = F.col("oof_solar"), F.col("oof_wind"), F.col("oof_load")
    return df.withColumns(dict(zip(INTERACTIONS, [s * cos, s * valley, l * peak, s * l, (s + w) * valley, l * cos])))


def stage2_inputs(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Frame with the 89 price inputs and their names."""
    names = [*OOF, *safe_columns(df.columns), *INTERACTIONS]
    return interactions(df), names


def _stage2_estimator(season: str, segment: str, features: Sequence[str], settings: Settings, stop_early: bool) -> Pipeline:
    if season == "dry":
        tree = RandomForestRegressor(labelCol="label", predictionCol="raw", seed=SEED, **settings.forest)
    else:
        extra = {"validationIndicatorCol": "is_late", "validationTol": 0.0} if stop_early else {}
        tree = settings.stage2[segment].estimator(labelCol="label", predictionCol="raw", weightCol="weight", **extra)
    return Pipeline(stages=[_assembler(features), tree])


def train_stage2(df: DataFrame, *, settings: Settings = Settings(), seasons: Sequence[str] = tuple(SEASONS), anchor_lags: Sequence[str] = (
        "price_lag96", "price_lag672")) -> tuple[dict[tuple[str, str], PipelineModel], DataFrame]:
    """Fit the segment models of every season on frames that carry `oof_*`, `season` and `split`.

    Returns the models and scored rows: (series_id, ts, season, split, is_rolling,
    period, y_price, anchor, price_lag96, price_pred), predictions out of fold where a fold
    tested the row.
    """
    df, names = stage2_inputs(metrics.price_anchor(df, anchor_lags))
    meta = ["series_id", "ts", "season", "split", "is_rolling", "period", "y_price", "anchor", "price_lag96"]
    base = df.where(F.col("split").isNotNull() & F.col("anchor").isNotNull()).withColumn("label", F.col("y_price") - F.col("anchor"))
    for c in OOF:
        base = base.where(col(c).isNotNull())
    base = materialise(base.select(*meta, "label", *[col(n) for n in names if n not in meta]), "stage2")

    def one(season: str, segment: str):
        rows = base.where(F.col("season") == season)
        k = settings.stage2_folds[season]
        fit_rows = rows.where(F.col("split").isin("train", "val") & calendar.segment_masks(F.col("period"))[f"{segment}_train"])
        fit_rows = time_folds(fit_rows, k)
        if season == "wet":
            fit_rows = metrics.robust_weights(fit_rows, "label")
        with _dealt(fit_rows, settings.rows_per_task) as seen:
            if seen.count() < MIN_SEGMENT_ROWS:
                return (season, segment), None, None
            final = _stage2_estimator(season, segment, names, settings, True).fit(seen)
            fold_est = _stage2_estimator(season, segment, names, settings, False)
            outs = [fold_est.fit(seen.where(F.col("fold") < i)).transform(seen.where(F.col("fold") == i))
                    .select("series_id", "ts", F.col("raw").alias("_fold")) for i in range(k)]
            scored = final.transform(rows).select("series_id", "ts", F.col("raw").alias("_final"))
            merged = scored.join(_union(outs), ["series_id", "ts"], "left").select(
                "series_id", "ts", F.coalesce("_fold", "_final").alias(f"pred_{segment}"))
            return (season, segment), final, materialise(merged, "segment")

    results = _parallel([lambda s=s, g=g: one(s, g) for s in seasons for g in SEGMENTS], settings.threads)
    models = {key: m for key, m, _ in results if m is not None}
    scored = base.select(*meta)
    for g in SEGMENTS:
        frames = [f for (s, seg), _, f in results if seg == g and f is not None]
        scored = (scored.join(_union(frames), ["series_id", "ts"], "left") if frames
                  else scored.withColumn(f"pred_{g}", F.lit(None).cast("double")))
    return models, blend(scored).select(*meta, "price_pred")


def blend(df: DataFrame, *, period: str = "period") -> DataFrame:
    """Anchor plus the weighted segment corrections; a missing segment model adds nothing."""
    shares = calendar.blend_weights(col(period))
    total = F.lit(0.0)
    for g in SEGMENTS:
        total = total + shares[f"w_{g}"] * F.coalesce(col(f"pred_{g}"), F.lit(0.0))
    return df.withColumn("price_pred", F.col("anchor") + total)


# --- guard -------------------------------------------------------------------

# fixed values: when recent errors make the baseline take over
GUARD_MIN_ROWS = 96
GUARD_IMPROVEMENT = 0.05
GUARD_MODEL_SHARE = 0.30


def guard_decision(scores: DataFrame) -> DataFrame:
    """Serving policy per season from `season, n, model_mae, anchor_mae, lag96_mae`."""
    anchor, lag = F.col("anchor_mae"), F.col("lag96_mae")
    best = F.when(anchor.isNull() & lag.isNull(), F.lit(None)).when(lag.isNull() | (anchor <= lag), "anchor").otherwise("lag96")
    best_mae = F.least(anchor, lag)
    need = best_mae * (1.0 - GUARD_IMPROVEMENT)
    lose = F.col("model_mae") > need
    reason = (
        F.when(F.col("season") != "wet", "only_wet_guarded")
        .when((F.col("n") < GUARD_MIN_ROWS) | F.col("model_mae").isNull(), "insufficient_rolling_test")
        .when(best.isNull(), "no_valid_baseline")
        .when(~lose, "model_beats_recent_baseline")
        .when(best == "lag96", "recent_lag96_baseline_wins")
        .otherwise("recent_baseline_wins_blend")
    )
    mode = F.when(F.col("reason") == "recent_lag96_baseline_wins", "lag96").when(
        F.col("reason") == "recent_baseline_wins_blend", "blend").otherwise("model")
    return (
        scores.withColumns({"best_baseline": best, "required_model_mae": F.round(need, 2), "reason": reason})
        .withColumns({"mode": mode, "enabled": mode != "model", "model_share": F.lit(GUARD_MODEL_SHARE)})
    )


def guard_apply(df: DataFrame, policy: DataFrame, *, predicted: str = "price_pred", out: str = "price_served") -> DataFrame:
    """Blend or replace predictions by the season's policy; the baseline also steps in for a missing prediction."""
    rules = F.broadcast(policy.select("season", "mode", "best_baseline", "model_share"))  # one row per season
    joined = df.join(rules, "season", "left")
    base = F.when((F.col("mode") == "lag96") | (F.col("best_baseline") == "lag96"), F.col("price_lag96")).otherwise(F.col("anchor"))
    share = F.when(F.col("mode") == "lag96", F.lit(0.0)).otherwise(F.col("model_share"))
    model = col(predicted)
    guarded = F.when(model.isNotNull() & base.isNotNull(), share * model + (1.0 - share) * base).otherwise(F.coalesce(model, base))
    active = F.coalesce(F.col("mode").isin("lag96", "blend"), F.lit(False))
    return joined.withColumn(out, F.when(active, guarded).otherwise(model)).drop("mode", "best_baseline", "model_share")


def rolling_scores(scored: DataFrame) -> DataFrame:
    """Recent model and baseline errors per season, the input of the guard."""
    recent = scored.where(F.col("is_rolling"))
    model = metrics.forecast_metrics(recent, actual="y_price", predicted="price_pred", by=["season"]).select(
        "season", "n", F.col("mae").alias("model_mae"))
    base = metrics.baseline_metrics(recent, actual="y_price", anchor="anchor", lag96="price_lag96", by=["season"]).select(
        "season", F.col("mae_anchor").alias("anchor_mae"), F.col("mae_lag96").alias("lag96_mae"))
    seasons = scored.select("season").distinct()
    return seasons.join(model, "season", "left").join(base, "season", "left").fillna({"n": 0})


# --- serving -----------------------------------------------------------------

def two_stage_predict(df: DataFrame, stage1: dict, stage2: dict, *, policy: DataFrame | None = None,
                      anchor_lags: Sequence[str] = ("price_lag96", "price_lag672")) -> DataFrame:
    """Price for every row.

    Stage 1, interactions, three segment models, blend, anchor, guard; a price that
    cannot be computed becomes 0, and `resid_pred` stays null there, as in months
    that belong to no season with models and for rows that lack an input of a model. `df` should be
    a stored feature table: the models are branches that would each rebuild it.
    """
    df = metrics.price_anchor(df.withColumn("season", calendar.serving_season(F.col("ts"))), anchor_lags)
    frames = []
    for season in SEASONS:
        rows = predict_stage1(df.where(F.col("season") == season), stage1, season)
        if unfitted := [f"oof_{t}" for t in TARGETS if (t, season) not in stage1]:
            rows = rows.fillna(0.0, unfitted)
        rows, names = stage2_inputs(rows)
        for g in SEGMENTS:
            model = stage2.get((season, g))
            if model is None:
                rows = rows.withColumn(f"pred_{g}", F.lit(0.0))
            else:
                rows = _score(model, rows, f"pred_{g}")
        known = reduce(lambda a, b: a & b, [F.col(f"pred_{g}").isNotNull() for g in SEGMENTS])
        rows = blend(rows).withColumn("price_pred", F.when(known, F.col("price_pred")))
        frames.append(rows.select("series_id", "ts", "season", "period", "anchor", "price_lag96", *OOF, "price_pred"))
    elsewhere = df.where(~F.coalesce(F.col("season").isin(SEASONS), F.lit(False)))
    unknown = [F.lit(None).cast("double").alias(c) for c in (*OOF, "price_pred")]
    frames.append(elsewhere.select("series_id", "ts", "season", "period", "anchor", "price_lag96", *unknown))
    out = _union(frames)
    out = guard_apply(out, policy) if policy is not None else out.withColumn("price_served", F.col("price_pred"))
    return out.select(
        "series_id", "ts", (F.col("ts") + F.expr("INTERVAL 24 HOURS")).alias("target_time"), "season", "period", "anchor", *OOF,
        (F.col("price_served") - F.col("anchor")).alias("resid_pred"), F.coalesce("price_served", F.lit(0.0)).alias("predicted_price"))


def feature_importance(models: Sequence[PipelineModel], n: int = 20) -> DataFrame:
    """Mean importance over models of the same inputs, the largest first."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    rows = []
    for model in models:
        inputs, tree = model.stages[0].getInputCols(), model.stages[-1]
        rows += [(name, float(v)) for name, v in zip(inputs, tree.featureImportances.toArray())]
    table = spark.createDataFrame(rows, "feature string, importance double")  # one row per input column
    return table.groupBy("feature").agg(F.avg("importance").alias("importance")).orderBy(F.desc("importance"), "feature").limit(n)


def save_models(models: dict[tuple[str, str], PipelineModel], path: str, suffix: str = "") -> None:
    for (a, b), model in models.items():
        model.write().overwrite().save(f"{path}/{a}_{b}{suffix}")


def load_models(path: str, keys: Sequence[tuple[str, str]], suffix: str = "") -> dict[tuple[str, str], PipelineModel]:
    return {(a, b): PipelineModel.load(f"{path}/{a}_{b}{suffix}") for a, b in keys}
