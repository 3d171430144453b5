"""Shadow models: daily scores, winning streaks, promotion and rollback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.timegrid import col


def daily_scores(scored: DataFrame, *, keys: Sequence[str], actual: str = "actual", predicted: str = "predicted", ts: str = "target_time") -> DataFrame:
    """(keys, model_version, day, n, mae) of rows that have both values."""
    error = F.abs(col(actual) - col(predicted))
    return scored.where(error.isNotNull()).groupBy(*[col(k) for k in keys], "model_version", F.to_date(col(ts)).alias("day")).agg(
        F.count("*").alias("n"), F.avg(error).alias("mae"))


def streaks(scores: DataFrame, *, keys: Sequence[str], active: str, shadow: str, needed: int = 7, critical: DataFrame | None = None) -> DataFrame:
    """(keys, day, active_mae, shadow_mae, better, streak, promoted): how many days in a row the shadow was better.

    A day without both scores breaks a streak, as does a day in `critical` (keys,
    day) and a day on which the shadow was not better. `promoted` marks the day a
    streak reaches `needed`. Rows are days, so a window holds a calendar.
    """
    keys = list(keys)
    mae = lambda version: F.max(F.when(F.col("model_version") == version, F.col("mae")))
    days = scores.where(F.col("model_version").isin(active, shadow)).groupBy(*keys, "day").agg(mae(active).alias("active_mae"), mae(shadow).alias("shadow_mae"))
    days = days.where(F.col("active_mae").isNotNull() & F.col("shadow_mae").isNotNull())
    if critical is not None:
        bad = critical.select(*[col(k).alias(f"_c_{k}") for k in keys], F.col("day").alias("_c_day"), F.lit(True).alias("_critical")).distinct()
        on = [col(k).eqNullSafe(F.col(f"_c_{k}")) for k in keys] + [F.col("day") == F.col("_c_day")]
        days = days.join(bad, on, "left").withColumn("_critical", F.coalesce("_critical", F.lit(False))).drop("_c_day", *[f"_c_{k}" for k in keys])
    else:
        days = days.withColumn("_critical", F.lit(False))
    order = Window.partitionBy(*keys).orderBy("day")
    better = (F.col("shadow_mae") < F.col("active_mae")) & ~F.col("_critical")
    follows = F.lag("day").over(order) == F.date_sub("day", 1)
    marked = days.withColumn("better", better).withColumn("_break", (~F.coalesce(follows, F.lit(False)) | ~F.col("better")).cast("int"))
    island = marked.withColumn("_island", F.sum("_break").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*keys, "_island").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    # the day that opens an island counts only if it was won itself
    counted = island.withColumn("streak", F.sum(F.col("better").cast("long")).over(inside))
    return counted.withColumn("promoted", F.col("better") & (F.col("streak") == needed)).select(*keys, "day", "active_mae", "shadow_mae", "better", "streak", "promoted")


def promotions(found: DataFrame, *, keys: Sequence[str], watch_days: int = 3, worse_by: float = 0.2) -> DataFrame:
    """(keys, promoted_on, mae_before, rolled_back_on): the first promotion of each key, and the day it is taken back.

    It is taken back on the first of the `watch_days` days after it on which the
    promoted model's error is beyond `1 + worse_by` times that of the promotion day.
    """
    keys = list(keys)
    first = found.where("promoted").groupBy(*keys).agg(F.min("day").alias("promoted_on"), F.min_by("shadow_mae", "day").alias("mae_before"))
    named = found.select(*[col(k).alias(f"_w_{k}") for k in keys], F.col("day").alias("_day"), F.col("shadow_mae").alias("_mae"))
    on = [col(k).eqNullSafe(F.col(f"_w_{k}")) for k in keys] + [F.col("_day") > F.col("promoted_on"), F.col("_day") <= F.date_add("promoted_on", watch_days),
                                                               F.col("_mae") > F.col("mae_before") * (1.0 + worse_by)]
    return first.join(named, on, "left").groupBy(*keys, "promoted_on", "mae_before").agg(F.min("_day").alias("rolled_back_on"))


def apply_promotions(registry: DataFrame, promoted: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Registry after promotions: the shadow of a promoted key becomes active and the active one archived, unless it was taken back.

    `registry` has the keys, `version_name` and `status`.
    """
    stays = promoted.where(F.col("rolled_back_on").isNull()).select(*[col(k).alias(f"_p_{k}") for k in keys], F.lit(True).alias("_promoted"))
    joined = registry.join(stays, [col(k).eqNullSafe(F.col(f"_p_{k}")) for k in keys], "left")
    status = F.when(F.col("_promoted") & (F.col("status") == "active"), "archived").when(F.col("_promoted") & (F.col("status") == "shadow"), "active").otherwise(F.col("status"))
    return joined.withColumn("status", status).select(*[col(c) for c in registry.columns])
