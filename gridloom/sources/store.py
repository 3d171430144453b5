"""Keyed tables on Parquet: upsert, replace, prune, append.

Parquet has no MERGE. A batch is merged with the partitions it touches, staged
in the shared folder, and written with dynamic partition overwrite, so a rerun
of the same batch gives the same table.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.timegrid import col
from gridloom.session import materialise


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Whole row with the greatest `order` per key.

    An aggregate, not a ranking window: each task reduces its rows to one per
    key before the shuffle, so a key with very many rows costs nothing extra.
    """
    rest = [c for c in df.columns if c not in set(keys)]
    best = df.groupBy(*[col(k) for k in keys]).agg(
        F.max_by(F.struct(*[col(c) for c in rest]), order).alias("_row"))
    return best.select(*[col(k) for k in keys], *[F.col("_row").getField(c).alias(c) for c in rest]).select(
        *[col(c) for c in df.columns])


def upsert_latest(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Column | None = None) -> DataFrame:
    """Rows of both, the incoming row replacing an existing one of the same key.

    `order` decides between incoming rows of one key (the greatest wins).
    """
    rank = F.struct(F.lit(1).alias("batch"), order if order is not None else F.lit(0))
    old = F.struct(F.lit(0).alias("batch"), (F.lit(None) if order is not None else F.lit(0)))
    fields = incoming.withColumn("_order", rank)
    base = existing.withColumn("_order", old.cast(fields.schema["_order"].dataType))
    both = base.unionByName(fields, allowMissingColumns=True)
    return latest_per_key(both, keys, F.col("_order")).drop("_order").select(*[col(c) for c in existing.columns])


def upsert_versions(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Rows of both, the greatest `order` of a key winning wherever it comes from; among equals the incoming row.

    The columns of `order` are stored with the table, so a late older version loses.
    """
    both = existing.withColumn("_batch", F.lit(0)).unionByName(incoming.withColumn("_batch", F.lit(1)))
    return latest_per_key(both, keys, F.struct(order, F.col("_batch"))).drop("_batch").select(*[col(c) for c in existing.columns])


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema
        return True
    except Exception as error:  # no table yet
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return False
        raise


def overwrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Rows of a partition lie together, and a large partition is split over tasks and files."""
    (df.hint("rebalance", *[col(p) for p in partition_by]).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path))


def write_upsert(incoming: DataFrame, path: str, keys: Sequence[str], partition_by: Sequence[str],
                 order: Column | None = None, versioned: bool = False) -> None:
    """Merge a batch into a partitioned table, touching only the partitions of the batch.

    With `versioned`, `order` is compared with that of the stored rows too.
    """
    spark = incoming.sparkSession
    if exists(spark, path):
        touched = incoming.select(*partition_by).distinct()
        table = spark.read.parquet(path)
        existing = table.join(touched, list(partition_by), "left_semi").select(*incoming.columns)
    else:
        existing = incoming.limit(0)
    merged = upsert_versions(existing, incoming, keys, order) if versioned else upsert_latest(existing, incoming, keys, order)
    merged = materialise(merged, "upsert")
    overwrite_partitions(merged, path, partition_by)


PREDICTION_PARTITION = ("target_date", "model_version")


def replace_predictions(df: DataFrame, path: str, series: Sequence[str] = ("series_id",)) -> None:
    """Replace the predictions of the (date, version, series) that the new ones name; other series of such a date stay."""
    dated = df.withColumn("target_date", F.to_date("target_time"))
    names = [c for c in series if c in df.columns]
    if names and exists(df.sparkSession, path):
        table, named = df.sparkSession.read.parquet(path), [*PREDICTION_PARTITION, *names]
        new = dated.select(*[col(c).alias(f"_new_{c}") for c in named]).distinct()
        same = [col(c).eqNullSafe(F.col(f"_new_{c}")) for c in named]
        touched = table.join(dated.select(*PREDICTION_PARTITION).distinct(), list(PREDICTION_PARTITION), "left_semi")
        kept = touched.join(new, reduce(and_, same), "left_anti").select(*[col(c) for c in dated.columns])
        dated = materialise(dated.unionByName(kept), "replace")
    overwrite_partitions(dated, path, PREDICTION_PARTITION)


def _with_last(rows: DataFrame, pred: DataFrame, version: str, keys: Sequence[str]) -> DataFrame:
    """`_last`: the last date the version covers, for each series named by `keys`; a table without these columns is one series."""
    keys = [k for k in keys if k in pred.columns]
    normal = pred.where(col("model_version") == version)
    if not keys:
        return rows.crossJoin(F.broadcast(normal.agg(F.max(F.to_date("target_time")).alias("_last"))))  # one row
    last = normal.groupBy(*[col(k).alias(f"_key_{i}") for i, k in enumerate(keys)]).agg(F.max(F.to_date("target_time")).alias("_last"))
    same = [col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)]
    return rows.join(last, same, "left").drop(*[f"_key_{i}" for i in range(len(keys))])


def prune_superseded(pred: DataFrame, *, version: str, gap_version: str, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Drop gap-fill rows up to the last date the normal version covers, for each series named by `keys`."""
    joined = _with_last(pred, pred, version, keys)
    superseded = (col("model_version") == gap_version) & (F.to_date("target_time") <= F.col("_last"))
    return joined.where(~F.coalesce(superseded, F.lit(False))).drop("_last")


def drop_partitions(spark: SparkSession, path: str, partitions: Sequence[dict[str, str]]) -> None:
    """Remove whole partitions of a table, each given by its column values; one that is not there is left out.

    Overwriting by partition cannot empty one.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for values in partitions:
        folder = jvm.org.apache.hadoop.fs.Path("/".join([path.rstrip("/"), *(f"{k}={v}" for k, v in values.items())]))
        folder.getFileSystem(conf).delete(folder, True)


def drop_superseded(spark: SparkSession, path: str, *, version: str, gap_version: str, series: Sequence[str] = ("series_id",)) -> None:
    """Remove stored gap-fill rows up to the last date the normal version covers, for each series.

    Only the gap version's partitions up to the newest such date are read and written. Those that keep rows of
    other series are overwritten, emptied ones removed; their number is that of dates.
    """
    if not exists(spark, path):
        return
    table, day = spark.read.parquet(path), F.col("target_date")
    normal = table.where(F.col("model_version") == version)
    newest = normal.agg(F.max(day)).first()[0]  # one date
    if newest is None:
        return
    last = normal.groupBy(*[col(c).alias(f"_key_{i}") for i, c in enumerate(series)]).agg(F.max(day).alias("_last"))
    same = [col(c).eqNullSafe(F.col(f"_key_{i}")) for i, c in enumerate(series)]
    gap = table.where((F.col("model_version") == gap_version) & (day <= F.lit(newest)))
    kept = materialise(gap.join(last, [*same, day <= F.col("_last")], "left_anti"), "kept")
    emptied = gap.select(day).distinct().join(kept.select(day).distinct(), "target_date", "left_anti").collect()  # dates
    overwrite_partitions(kept, path, PREDICTION_PARTITION)
    drop_partitions(spark, path, [{"target_date": str(r[0]), "model_version": gap_version} for r in emptied])


def gap_fill_days(pred: DataFrame, *, version: str, gap_version: str, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Gap-fill rows of dates after normal coverage, for each series named by `keys`."""
    joined = _with_last(pred.where(col("model_version") == gap_version), pred, version, keys)
    return joined.where(F.col("_last").isNull() | (F.to_date("target_time") > F.col("_last"))).drop("_last")


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def full_refresh(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a whole table."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_features(df: DataFrame, path: str) -> None:
    """Feature store, one directory per season; a season is replaced as a whole."""
    seasons = df.withColumn("season", F.coalesce("season", F.lit("none")))
    (seasons.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("season").parquet(path))


def read_predictions(spark: SparkSession, path: str, versions: Sequence[str] | None = None, *, first: date | None = None,
                     last: date | None = None, days: DataFrame | None = None) -> DataFrame:
    """Stored predictions; the partitions of other versions and dates are not listed or read.

    `first` and `last` bound the dates, both included. `days` (a column `day`)
    selects dates by a join on the partition column, which Spark prunes at run time;
    it is reduced to its distinct dates, which a calendar bounds, before it is broadcast.
    """
    table, target = spark.read.parquet(path), F.col("target_date")
    if days is not None:
        dates = materialise(days.select("day").where("day is not null").distinct(), "dates")
        lo, hi = dates.agg(F.min("day"), F.max("day")).first()  # two dates
        if lo is None:
            return table.where("false")
        first, last = max(lo, first or lo), min(hi, last or hi)
        chosen = dates.where(F.col("day").between(F.lit(first), F.lit(last)))
        table = table.join(F.broadcast(chosen), target == F.col("day"), "left_semi")
    if versions is not None:
        table = table.where(F.col("model_version").isin(list(versions)))
    if first is not None:
        table = table.where(target >= F.lit(first))
    return table.where(target <= F.lit(last)) if last is not None else table


def read_features(spark: SparkSession, path: str, season: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.col("season") == season) if season else df


def register_models(existing: DataFrame | None, metrics: DataFrame, *, version_tag: str, suffix: str = "") -> DataFrame:
    """Registry rows for new models; rows of the same model type that were active become archived.

    `metrics` has `season`, `segment` and the metric columns, one row per model.
    """
    values = [c for c in metrics.columns if c not in {"season", "segment"}]
    fresh = metrics.select(
        F.concat_ws("_", F.lit("stage2"), "season", "segment", F.lit(version_tag)).alias("version_name"),
        F.concat(F.lit("stage2_price_"), F.col("segment"), F.lit(suffix)).alias("model_type"),
        F.concat(F.lit("models/price_"), F.col("segment"), F.lit("_"), F.col("season"), F.lit(suffix)).alias("file_path"),
        F.to_json(F.struct(*[col(v) for v in values])).alias("metrics"),
        F.lit("active").alias("status"),
    )
    if existing is None:
        return fresh
    new_types = fresh.select(F.col("file_path").alias("_fp")).distinct()
    old = existing.join(new_types, existing["file_path"] == F.col("_fp"), "left").withColumn(
        "status", F.when(F.col("_fp").isNotNull() & (F.col("status") == "active"), "archived").otherwise(F.col("status"))
    ).drop("_fp")
    return old.unionByName(fresh)


def active_models(registry: DataFrame) -> DataFrame:
    return registry.where(F.col("status") == "active")
