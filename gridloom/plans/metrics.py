"""Forecast scores, baselines and comparisons between frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.derived import mean_of_available
from gridloom.functions.timegrid import col
from gridloom.operators.quantiles import exact_quantiles, join_few


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def r2(y: Column, p: Column) -> Column:
    """1 - residual sum of squares over total sum of squares; null for constant targets."""
    known = F.when(p.isNotNull(), y)
    return 1 - F.try_divide(F.sum((y - p) * (y - p)), F.nullif(F.var_pop(known) * F.count(known), F.lit(0.0)))


def forecast_metrics(df: DataFrame, *, actual: str, predicted: str, by: Sequence[str] = (), part: str | None = None) -> DataFrame:
    """MAE, R2 and row count; with `part` also per value of it, from the same pass.

    The row over all parts carries `part = 'all'`.
    """
    y, p = col(actual), col(predicted)
    rows = df.where(y.isNotNull() & p.isNotNull() & ~F.isnan(y) & ~F.isnan(p))
    aggs = [F.count("*").alias("n"), mae(y, p).alias("mae"), r2(y, p).alias("r2")]
    if part is None:
        return rows.groupBy(*by).agg(*aggs)
    keys = [col(b) for b in by]
    grouped = rows.groupingSets([keys, [*keys, col(part)]], *keys, col(part)).agg(*aggs, F.grouping(part).alias("_all"))
    label = F.when(F.col("_all") == 1, F.lit("all")).otherwise(col(part))
    return grouped.select(*by, label.alias(part), "n", "mae", "r2")


def baseline_metrics(df: DataFrame, *, actual: str, anchor: str, lag96: str, by: Sequence[str] = ()) -> DataFrame:
    """Errors of the naive forecasts on the rows where all three values exist."""
    rows = df.where(col(actual).isNotNull() & col(anchor).isNotNull() & col(lag96).isNotNull())
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), mae(col(actual), col(anchor)).alias("mae_anchor"), mae(col(actual), col(lag96)).alias("mae_lag96"))


def price_anchor(df: DataFrame, lags: Sequence[str] = ("price_lag96", "price_lag672"), out: str = "anchor") -> DataFrame:
    """Mean of the lagged prices that exist; null if none does."""
    return df.withColumn(out, mean_of_available([col(c) for c in lags]))


def robust_weights(df: DataFrame, target: str, *, by: Sequence[str] = (), out: str = "weight") -> DataFrame:
    """1 / (1 + |y| / p80(|y|)), the 80th percentile taken per group of any size."""
    sized = df.withColumn("_abs", F.abs(col(target)))
    cut = exact_quantiles(sized, "_abs", [0.8], by=by).select(*by, F.col("q0").alias("_p80"))
    joined = join_few(sized, cut, by, how="left")
    return joined.withColumn(out, 1.0 / (1.0 + F.col("_abs") / (F.col("_p80") + 1e-6))).drop("_abs", "_p80")


def residual_histogram(df: DataFrame, residual: str, *, bins: int = 60, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins between the extremes of each group, as a histogram chart counts them.

    Two small aggregates; `mean` and `sigma` of the group are repeated on its rows.
    """
    r = col(residual)
    rows = df.where(r.isNotNull())
    ends = rows.groupBy(*by).agg(F.min(r).alias("_lo"), F.max(r).alias("_hi"), F.avg(r).alias("mean"), F.stddev_pop(r).alias("sigma"))
    joined = join_few(rows, ends, by)
    width = (F.col("_hi") - F.col("_lo")) / bins
    index = F.when(width > 0, F.least(F.floor((r - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    return joined.groupBy(*by, "mean", "sigma", index.alias("bin")).agg(F.count("*").alias("n"))


def frame_diff(a: DataFrame, b: DataFrame, *, keys: Sequence[str], cols: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """Per column: rows compared, largest and mean absolute difference, rows beyond the tolerance
    and rows null on one side only."""
    left = a.select(*keys, *[col(c).cast("double").alias(f"_a_{c}") for c in cols])
    right = b.select(*keys, *[col(c).cast("double").alias(f"_b_{c}") for c in cols])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), col(f"_a_{c}").alias("a"), col(f"_b_{c}").alias("b")) for c in cols])
    long = left.join(right, list(keys)).select(F.explode(pairs).alias("d")).select("d.*")
    gap = F.abs(F.col("a") - F.col("b"))
    return long.groupBy("column").agg(
        F.count(gap).alias("n"), F.max(gap).alias("max_diff"), F.avg(gap).alias("mean_diff"),
        F.count(F.when(gap > tolerance, 1)).alias("n_beyond"),
        F.count(F.when(F.col("a").isNull() != F.col("b").isNull(), 1)).alias("n_null_mismatch"))


def worst_columns(diff: DataFrame, n: int = 5) -> DataFrame:
    return diff.orderBy(F.desc_nulls_last("max_diff"), "column").limit(n)
