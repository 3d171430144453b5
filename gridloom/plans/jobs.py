"""The daily, weekly and back-fill jobs as functions an outside scheduler calls."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import dims
from gridloom.functions import calendar
from gridloom.operators import daily, quantiles, regular
from gridloom.plans import features, metrics, quality, splits, training
from gridloom.session import materialise
from gridloom.sources import payload, store
from gridloom.sources.tables import MONTH, month_of

SERIES = ["series_id"]
GAP_STEPS = 192


def _next_day(ts: str) -> Column:
    return F.col(ts) + F.expr("INTERVAL 24 HOURS")


def land_grid(spark: SparkSession, landed: str, table: str, *, series: Sequence[str] = tuple(SERIES), fetched: str = "fetched",
              lines: bool = False) -> None:
    """Unpack landed payloads and merge them into the stored grid, month by month.

    Payloads lie in folders by series and by `fetched`, the number or date of the
    fetch. Of several fetches of one step the latest stays, also where an older
    one is landed after it; only the months that the payloads name are rewritten.
    """
    keys = [*series, fetched]
    rows = payload.ingest_payloads(payload.read_payloads(spark, landed, keys, lines), keys=keys)
    store.write_upsert(rows.withColumn(MONTH, month_of(F.col("ts"))), table, [*series, "ts"], [MONTH], F.col(fetched), versioned=True)


def training_frame(grid: DataFrame, obs: DataFrame, *, series: Sequence[str] = tuple(SERIES)) -> tuple[DataFrame, DataFrame]:
    """Grid without rows lacking a price, made regular, and the observed weather."""
    known = grid.where(F.col("price").isNotNull())
    return regular.regularize(known, series=list(series)), obs.select("ts", "variables")


def inference_frame(grid: DataFrame, obs: DataFrame, runs: DataFrame, *, as_of, extend: int = 0,
                    series: Sequence[str] = tuple(SERIES)) -> tuple[DataFrame, DataFrame]:
    """Regular grid, optionally extended past its end, and weather continued by the newest forecasts.

    The weather keeps its hours after the end of the grid, so the rows to be
    served see the conditions of their target time.
    """
    known = regular.regularize(grid.where(F.col("price").isNotNull()), series=list(series))
    if extend:
        known = regular.forward_extend(known, extend, series=list(series))
    weather = regular.obs_over_forecast(obs, runs, as_of=as_of).select("ts", "variables")
    return known, weather


def _records(pred: DataFrame, version: str) -> DataFrame:
    target = F.col("target_time")
    return pred.select("series_id", "target_time", "predicted_price", F.lit(version).alias("model_version"), "season",
                       calendar.period(target).alias("period"))


def latest_predictions(feats: DataFrame, stage1: dict, stage2: dict, *, version: str, policy: DataFrame | None = None) -> DataFrame:
    """Predictions made from the last day of each series."""
    rows = daily.last_day(feats, series=SERIES)
    return _records(training.two_stage_predict(rows, stage1, stage2, policy=policy), version)


Predict = Callable[[DataFrame], DataFrame]


def by_models(stage1: dict, stage2: dict, *, policy: DataFrame | None = None,
              anchor_lags: Sequence[str] = ("price_lag96", "price_lag672")) -> Predict:
    """Feature rows to (series_id, target_time, predicted_price, season) by the two-stage models."""
    return lambda feats: training.two_stage_predict(feats, stage1, stage2, policy=policy, anchor_lags=anchor_lags)


def by_anchor(lags: Sequence[str]) -> Predict:
    """The same by the naive forecast, the mean of the lagged prices that exist; unknown if none does."""
    def predict(feats: DataFrame) -> DataFrame:
        named = metrics.price_anchor(feats, lags)
        return named.select(*SERIES, _next_day("ts").alias("target_time"), F.col("anchor").alias("predicted_price"),
                            F.lit(None).cast("string").alias("season"))
    return predict


def full_days(pred: DataFrame, version: str) -> DataFrame:
    """Prediction records of whole dates: every period of a date that has a row; what could not be predicted is 0."""
    target = F.col("target_time")
    days = pred.select(*SERIES, F.to_date(target).alias("_day")).distinct()
    slots = days.withColumn("period", F.explode(F.sequence(F.lit(0), F.lit(95))))
    slot = F.col("_day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("period") * 15)
    known = pred.select(*SERIES, "target_time", "predicted_price", "season")
    full = slots.select(*SERIES, slot.alias("target_time"), "period").join(known, [*SERIES, "target_time"], "left")
    season = F.when(F.month("target_time") <= 4, "dry").otherwise("wet")
    return full.select("series_id", "target_time", F.coalesce("predicted_price", F.lit(0.0)).alias("predicted_price"),
                       F.lit(version).alias("model_version"), F.coalesce("season", season).alias("season"), "period")


def gap_pass(feats: DataFrame, predict: Predict, *, version: str, normal: DataFrame) -> DataFrame:
    """Whole dates after the last one that `normal` covers, for each series; a series without normal rows gets all its dates."""
    pred = predict(feats)
    last = normal.groupBy(*SERIES).agg(F.max(F.to_date("target_time")).alias("_last"))
    later = quantiles.join_few(pred, last, SERIES, how="left", spread=["target_time"])
    return full_days(later.where(F.col("_last").isNull() | (F.to_date("target_time") > F.col("_last"))).drop("_last"), version)


def gap_predictions(feats: DataFrame, stage1: dict, stage2: dict, *, version: str, normal: DataFrame,
                    policy: DataFrame | None = None) -> DataFrame:
    """The gap pass of the lagged models."""
    lags = (f"price_lag{GAP_STEPS}", "price_lag672")
    return gap_pass(feats, by_models(stage1, stage2, policy=policy, anchor_lags=lags), version=version, normal=normal)


def daily_inference(grid: DataFrame, obs: DataFrame, runs: DataFrame, *, as_of, models: tuple[dict, dict],
                    gap_models: tuple[dict, dict] | None, path: str, version: str, policy: DataFrame | None = None) -> DataFrame:
    """Normal pass for the next day, then the gap-fill pass; both replace their (date, version) partitions."""
    frame, weather = inference_frame(grid, obs, runs, as_of=as_of)
    feats = materialise(features.build_features(frame, weather), "features")
    normal = materialise(latest_predictions(feats, *models, version=version, policy=policy), "normal")
    store.replace_predictions(normal, path)
    if gap_models:
        frame, weather = inference_frame(grid, obs, runs, as_of=as_of, extend=GAP_STEPS)
        lagged = materialise(features.build_features(frame, weather, lag_steps=GAP_STEPS), "features")
        gap = gap_predictions(lagged, *gap_models, version=f"{version}_lag{GAP_STEPS}", normal=normal, policy=policy)
        store.replace_predictions(materialise(gap, "gap"), path)
    return normal.sparkSession.read.parquet(path)


def backfill(feats: DataFrame, predict: Predict, *, path: str, ledger_path: str, run: str, version: str,
             after: str | None = None, step_days: int = 31) -> int:
    """Predict the whole history and replace it date by date; returns the number of steps done.

    `feats` is a stored table of feature rows. The dates are done in steps of
    `step_days`; each step reads its own rows, replaces its (date, version)
    partitions and is then entered in the ledger under the name `run`. A run that
    died goes on after its last entered step; the step it died in is written
    again with the same result. A new name does all dates anew.

    With `after`, the name of a version in the same table, only dates after the
    last one of that version are predicted, for each series, and rows of `version` up
    to it are removed.
    """
    spark = feats.sparkSession
    if after:
        store.drop_superseded(spark, path, version=after, gap_version=version, series=SERIES)
    rows = feats.where(F.col("ts").isNotNull())
    target = F.to_date(_next_day("ts"))
    dates = rows.select(*SERIES, target.alias("target_date")).distinct()
    normal = None
    if after:
        table = spark.read.parquet(path).where(F.col("model_version") == after)
        normal = materialise(table.groupBy(*SERIES).agg(F.max(F.col("target_date").cast("timestamp_ntz")).alias("target_time")), "normal")
        last = normal.select(*[F.col(k).alias(f"_{k}") for k in SERIES], F.to_date("target_time").alias("_last"))
        dates = dates.join(last, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in SERIES], "left").where(
            F.col("_last").isNull() | (F.col("target_date") > F.col("_last"))).select(*SERIES, "target_date")
    if store.exists(spark, ledger_path):
        done = spark.read.parquet(ledger_path).where((F.col("run") == run) & (F.col("model_version") == version))
        dates = dates.join(done.select(*[F.col(c).alias(f"_{c}") for c in (*SERIES, "target_date")]),
                           [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*SERIES, "target_date")], "left_anti")
    pending = materialise(dates, "pending")  # a row for each series and date
    first, end = pending.agg(F.min("target_date"), F.max("target_date")).first()  # two dates
    steps = 0
    while first is not None and first <= end:
        last_day = min(first + timedelta(days=step_days - 1), end)
        todo = pending.where(F.col("target_date").between(F.lit(first), F.lit(last_day)))
        if not todo.isEmpty():
            # the rows of the day before a date are its inputs
            near = rows.where((F.col("ts") >= F.lit(first - timedelta(days=1)).cast("timestamp_ntz")) & (F.col("ts") < F.lit(last_day).cast("timestamp_ntz")))
            wanted = todo.select(*[F.col(k).alias(f"_{k}") for k in SERIES], F.col("target_date").alias("_date"))
            mine = near.join(wanted, [target == F.col("_date"), *[F.col(k).eqNullSafe(F.col(f"_{k}")) for k in SERIES]], "left_semi")
            pred = gap_pass(mine, predict, version=version, normal=normal) if after else full_days(predict(mine), version)
            store.replace_predictions(materialise(pred, "backfill"), path)
            store.append_log(todo.select(F.lit(run).alias("run"), F.lit(version).alias("model_version"), *SERIES, "target_date",
                                         F.current_timestamp().alias("finished_at")), ledger_path)
            steps += 1
        first = last_day + timedelta(days=1)
    return steps


def retrain(grid: DataFrame, obs: DataFrame, *, windows: Sequence[dims.SplitWindow], lag_steps: int = 0,
            settings: training.Settings = training.Settings()) -> dict:
    """Features, splits, both stages, scores and the guard policy for one grid lag."""
    frame, weather = training_frame(grid, obs)
    feats = materialise(features.build_features(frame, weather, lag_steps=lag_steps), "features").drop("season")
    rows = materialise(splits.split_assign(feats, label="y_price_resid", windows=windows), "split")
    models1, oof = training.train_stage1(rows, settings=settings)
    lags = (f"price_lag{lag_steps}", "price_lag672") if lag_steps else ("price_lag96", "price_lag672")
    models2, scored = training.train_stage2(rows.join(oof, SERIES + ["ts"]), settings=settings, anchor_lags=lags)
    scored = materialise(scored, "scored")
    scores = training.rolling_scores(scored)
    return {"stage1": models1, "stage2": models2, "scored": scored, "oof": oof, "policy": training.guard_decision(scores),
            "report": report_table(scored)}


def report_table(scored: DataFrame) -> DataFrame:
    """Price scores by season, split and segment, with the naive baselines beside them."""
    rows = scored.withColumn("segment", calendar.segment_of(F.col("period")))
    scores = metrics.forecast_metrics(rows, actual="y_price", predicted="price_pred", by=["season", "split"], part="segment")
    base = metrics.baseline_metrics(scored, actual="y_price", anchor="anchor", lag96="price_lag96", by=["season", "split"])
    return scores.join(base.drop("n"), ["season", "split"], "left")


def validate(grid: DataFrame, obs: DataFrame | None, log_path: str, *, series: Sequence[str] = tuple(SERIES)) -> DataFrame:
    """Quality status of all days, appended to the log."""
    report = materialise(quality.quality_status(grid, obs, series=list(series)), "quality")
    store.append_log(quality.quality_log(report), log_path)
    return report
