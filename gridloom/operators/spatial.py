"""Weather maps: unpack, cluster means, weighted fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom import dims
from gridloom.functions.timegrid import col, finite

MAP_TYPE = "map<string,double>"


def as_map(df: DataFrame, c: str = "variables") -> DataFrame:
    """JSON text to a map; a map column is kept as it is. Numbers that are not finite are null."""
    kind = df.schema[c].dataType.typeName()
    return df if kind == "map" else df.withColumn(c, F.transform_values(F.from_json(col(c), MAP_TYPE), lambda _, v: finite(v)))


def unpack_map(df: DataFrame, c: str = "variables", keys: Sequence[str] | None = None) -> DataFrame:
    """One column per declared key; the key set never depends on the data."""
    keys = list(keys) if keys is not None else dims.weather_keys()
    df = as_map(df, c)
    rest = [f"`{x}`" for x in df.columns if x != c]
    return df.selectExpr(*rest, *[f"try_element_at(`{c}`, '{k}') AS `{k}`" for k in keys])


def long_to_map(df: DataFrame, *, keys: Sequence[str] = ("ts",), key: str = "key", value: str = "value") -> DataFrame:
    """Rows (time, key, value) to one JSON object per time; missing values are left out.

    There is one row per time and key, so an object is as large as the key set.
    """
    pairs = F.sort_array(F.collect_list(F.when(col(value).isNotNull(), F.struct(col(key), col(value)))))
    return (
        df.groupBy(*[col(k) for k in keys]).agg(F.map_from_entries(pairs).alias("variables"))
        .withColumn("variables", F.to_json("variables"))
    )


def map_to_long(df: DataFrame, c: str = "variables") -> DataFrame:
    """One row per (row, variable, node)."""
    df = as_map(df, c)
    rest = [col(x) for x in df.columns if x != c]
    parts = df.select(*rest, F.explode(col(c)).alias("key", "value"))
    return parts.select(
        *rest,
        F.substring_index("key", "_", 1).alias("variable"),
        F.regexp_replace("key", "^[^_]*_", "").alias("node"),
        "value",
    )


def cluster_mean_expr(variable: str, cluster: str, present: Sequence[str], zero_missing: bool = False) -> Column:
    """Equal-weight mean over the nodes of a cluster whose columns exist."""
    names = [f"`{variable}_{n}`" for n in dims.CLUSTERS[cluster] if f"{variable}_{n}" in present]
    if not names:
        return F.lit(None).cast("double")
    total = " + ".join(f"coalesce({n}, 0D)" for n in names)
    known = " + ".join(f"CAST({n} IS NOT NULL AS INT)" for n in names)
    return F.expr(f"({total}) / {len(names)}D" if zero_missing else f"try_divide({total}, CAST({known} AS DOUBLE))")


def fused_expr(variable: str, cluster_columns: dict[tuple[str, str], Column]) -> Column:
    """Weighted sum of the cluster means of a variable."""
    total = None
    for cluster, weight in dims.REGION_WEIGHTS[variable].items():
        part = cluster_columns[(variable, cluster)] * F.lit(weight)
        total = part if total is None else total + part
    return total


def cluster_mean(long_df: DataFrame, *, keys: Sequence[str] = ("ts",), zero_missing: bool = False,
                 clusters: DataFrame | None = None) -> DataFrame:
    """Long form: mean per (time, variable, cluster).

    With `zero_missing` an absent node value counts as zero, provided the node
    reports that variable at all.
    """
    clusters = clusters if clusters is not None else dims.cluster_dim(long_df.sparkSession)
    joined = long_df.join(F.broadcast(clusters), "node")  # fixed 19-row dimension
    if not zero_missing:
        return joined.groupBy(*keys, "variable", "cluster").agg(F.avg("value").alias("value"))
    reporting = joined.groupBy("variable", "cluster").agg(F.count_distinct("node").alias("_nodes"))
    sums = joined.groupBy(*keys, "variable", "cluster").agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("_sum"))
    return sums.join(F.broadcast(reporting), ["variable", "cluster"]).select(  # at most 6 x 7 rows
        *keys, "variable", "cluster", (F.col("_sum") / F.col("_nodes")).alias("value"))


def cluster_fusion(means: DataFrame, *, keys: Sequence[str] = ("ts",), weights: DataFrame | None = None) -> DataFrame:
    """Weighted fusion over clusters; null unless every weighted cluster has a mean."""
    weights = weights if weights is not None else dims.weight_dim(means.sparkSession)
    need = weights.groupBy("variable").agg(F.count("*").alias("_need"))
    joined = means.join(F.broadcast(weights), ["variable", "cluster"])  # fixed 15-row dimension
    return (
        joined.groupBy(*keys, "variable")
        .agg(F.sum(F.col("value") * F.col("weight")).alias("_sum"), F.count("value").alias("_have"))
        .join(F.broadcast(need), "variable")
        .select(*keys, "variable", F.when(F.col("_have") == F.col("_need"), F.col("_sum")).alias("value"))
    )
