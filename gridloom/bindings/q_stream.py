"""Structured Streaming twins of the batch ingest; each is compared with the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.bindings import tables as t
from gridloom.bindings.ctes import DAY, PERIOD, ora
from gridloom.bindings.registry import query
from gridloom.session import work_path
from gridloom.streaming import ingest


def _landing(spark, sf):
    schema = t.table(spark, sf, "events").schema
    return ingest.read_landing(spark, sf, schema, glob="events.parquet")


def _keyed(df):
    return df.withColumn("series_id", (F.col("user_id") % 4).cast("int"))


def _finish(q):
    q.awaitTermination()


@query("stream_ingest", "SELECT event_id, ts, user_id, event_type, value FROM events")
def stream_ingest(spark, sf):
    path = work_path(spark, "stream")
    rows = _landing(spark, sf).select("event_id", "ts", "user_id", "event_type", "value", F.to_date("ts").alias("day"))
    _finish(ingest.start_append(rows, f"{path}/data", f"{path}/state", partition_by=["day"]))
    return spark.read.parquet(f"{path}/data").drop("day")


@query("stream_bin15", ora(
    "SELECT CAST(user_id % 4 AS INTEGER) AS series_id, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, count(*) AS n, sum(cents) AS cents FROM ev GROUP BY 1, 2", "ev"))
def stream_bin15(spark, sf):
    path = work_path(spark, "stream")
    binned = ingest.bins(_keyed(_landing(spark, sf)), {"n": F.count("*"), "cents": F.sum(F.round(F.col("value") * 100))}, keys=["series_id"])
    _finish(ingest.start_changelog(binned, f"{path}/data", f"{path}/state"))
    return ingest.read_changelog(spark, f"{path}/data", ["series_id", "ts"])


@query("stream_dedup", "SELECT event_id, ts, event_type FROM events")
def stream_dedup(spark, sf):
    """Every row is delivered twice, in different files; one copy arrives."""
    path = work_path(spark, "stream")
    e = t.table(spark, sf, "events").select("event_id", "ts", "event_type")
    e.write.parquet(f"{path}/landed")
    e.write.mode("append").parquet(f"{path}/landed")
    landed = ingest.read_landing(spark, f"{path}/landed", e.schema)
    _finish(ingest.start_append(ingest.deduplicated(landed, ["event_id"]), f"{path}/data", f"{path}/state"))
    return spark.read.parquet(f"{path}/data")


@query("stream_upsert", "SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN -value ELSE value END AS value FROM events")
def stream_upsert(spark, sf):
    """Corrections for every third row arrive in a later micro-batch."""
    path = work_path(spark, "stream")
    e = t.table(spark, sf, "events").select("event_id", "ts", "value", F.date_format("ts", "yyyy-MM").alias("month"), F.lit(0).alias("version"))
    e.write.parquet(f"{path}/landed")
    fixed = e.where(F.col("event_id") % 3 == 0).withColumns({"value": -F.col("value"), "version": F.lit(1)})
    fixed.write.mode("append").parquet(f"{path}/landed")
    landed = ingest.read_landing(spark, f"{path}/landed", e.schema)
    _finish(ingest.start_upsert(landed, f"{path}/data", f"{path}/state", keys=["event_id", "month"], partition_by=["month"], order=F.col("version")))
    return spark.read.parquet(f"{path}/data").select("event_id", "ts", "value")


@query("stream_completeness", ora(
    f"SELECT CAST(user_id % 4 AS INTEGER) AS series_id, {DAY} AS day, count(DISTINCT {PERIOD}) AS present, 96 - count(DISTINCT {PERIOD}) AS missing, "
    f"round(count(DISTINCT {PERIOD}) / 96.0::DOUBLE * 100, 2) AS completeness_pct FROM ev GROUP BY 1, 2", "ev"))
def stream_completeness(spark, sf):
    path = work_path(spark, "stream")
    seen = ingest.day_completeness(_keyed(_landing(spark, sf)), keys=["series_id"])
    _finish(ingest.start_changelog(seen, f"{path}/data", f"{path}/state"))
    return ingest.read_changelog(spark, f"{path}/data", ["series_id", "day"])
