"""Streaming counterparts of binning, de-duplication, correction and completeness.

Results that may still change are kept as a change log: every micro-batch owns
the partition `batch_id`, and writing it again replaces it, so a replay after a
failure leaves the same table. Readers take the newest row per key.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from gridloom.functions.calendar import period
from gridloom.functions.timegrid import col
from gridloom.operators.runs import sessions
from gridloom.session import materialise
from gridloom.sources.store import latest_per_key, write_upsert


def read_landing(spark: SparkSession, path: str, schema: StructType, *, fmt: str = "parquet", glob: str | None = None,
                 files_per_batch: int | None = None) -> DataFrame:
    """Stream over files that land in a folder; the schema is declared, never inferred."""
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def start_append(stream: DataFrame, path: str, checkpoint: str, *, partition_by: Sequence[str] = ()) -> StreamingQuery:
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.trigger(availableNow=True).start(path)


def _write_batch(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))
    return write


def start_changelog(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the groups each micro-batch changed."""
    return (stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .foreachBatch(_write_batch(path)).trigger(availableNow=True).start())


def read_changelog(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    return latest_per_key(spark.read.parquet(path), keys, F.col("batch_id")).drop("batch_id")


def compact_changelog(spark: SparkSession, path: str, keys: Sequence[str]) -> int:
    """Keep the newest row of each key, under the newest batch; returns the batches removed.

    The newest batch is rewritten first. Should the job end before the older ones are gone, readers still take the same rows.
    """
    newest = spark.read.parquet(path).agg(F.max("batch_id")).first()[0]  # one number
    if newest is None:
        return 0
    kept = materialise(read_changelog(spark, path, keys), "changelog")
    _write_batch(path)(kept, newest)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    older = [d.getPath() for d in files.listStatus(root) if d.getPath().getName().startswith("batch_id=") and int(d.getPath().getName()[9:]) < newest]
    for folder in older:
        files.delete(folder, True)
    return len(older)


EVENT_TIME = "_event_time"


def _timed(stream: DataFrame, ts: str, late: str) -> DataFrame:
    """Watermark on the wall-clock column. Spark wants TIMESTAMP there; with the session
    zone pinned to UTC the cast changes nothing."""
    return stream.withColumn(EVENT_TIME, col(ts).cast("timestamp")).withWatermark(EVENT_TIME, late)


def bins(stream: DataFrame, aggs: Mapping[str, Column], *, keys: Sequence[str], ts: str = "ts", width: str = "15 minutes",
         late: str = "1 day") -> DataFrame:
    """Tumbling bins per key; rows later than `late` are left out."""
    grouped = _timed(stream, ts, late).groupBy(F.window(EVENT_TIME, width), *[col(k) for k in keys])
    return grouped.agg(*[a.alias(n) for n, a in aggs.items()]).select(
        *keys, F.col("window.start").cast("timestamp_ntz").alias(ts), *[col(n) for n in aggs])


def deduplicated(stream: DataFrame, keys: Sequence[str], *, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """First delivery of each row within the watermark."""
    return _timed(stream, ts, late).dropDuplicatesWithinWatermark(list(keys)).drop(EVENT_TIME)


def day_completeness(stream: DataFrame, *, keys: Sequence[str], ts: str = "ts", late: str = "2 days", expected: int = 96) -> DataFrame:
    """Distinct periods seen so far per key and day; state is at most 96 numbers per group."""
    seen = _timed(stream, ts, late).groupBy(F.window(EVENT_TIME, "1 day"), *[col(k) for k in keys]).agg(
        F.size(F.collect_set(period(col(ts)))).cast("bigint").alias("present"))
    return seen.select(
        *keys, F.to_date("window.start").alias("day"), "present", (F.lit(expected) - F.col("present")).alias("missing"),
        F.round(F.col("present") / expected * 100, 2).alias("completeness_pct"))


def start_upsert(stream: DataFrame, path: str, checkpoint: str, *, keys: Sequence[str], partition_by: Sequence[str],
                 order: Column | None = None, versioned: bool = False) -> StreamingQuery:
    """Late corrections: each micro-batch is merged into the partitions it touches; with `versioned` an older version that arrives last loses."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        write_upsert(batch, path, keys, partition_by, order, versioned)

    return (stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
            .foreachBatch(merge).trigger(availableNow=True).start())


def arrival_sessions(stream: DataFrame, *, keys: Sequence[str], ts: str = "fetch_time", gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Sessions of a stream, each given out when the watermark has passed its end."""
    return sessions(_timed(stream, ts, late), keys=keys, gap=gap, event_time=EVENT_TIME)
