"""Landed multi-series JSON payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom import dims
from gridloom.functions import labels
from gridloom.functions.calendar import day_type
from gridloom.functions.timegrid import QUARTER

POINT_SCHEMA = (
    "legendCode string, legendName string, xAxisYYList array<string>, yAxisList array<double>"
)
PAYLOAD_SCHEMA = f"code int, data map<string, array<struct<{POINT_SCHEMA}>>>"


def read_payloads(spark, path: str, keys: Sequence[str] = (), lines: bool = False) -> DataFrame:
    """JSON files with a declared schema: a payload a file, or with `lines` a payload a line.

    A member of `data` that is no list makes that member null and is skipped
    later. `keys` are kept columns: the folders (`series_id=1`) files lie in.
    """
    raw = spark.read.schema("code int, data map<string, string>").option("multiLine", str(not lines).lower()).json(path)
    lists = F.transform_values("data", lambda _, v: F.from_json(v, f"array<struct<{POINT_SCHEMA}>>"))
    return raw.where(F.col("code") == 200).select(*keys, "code", lists.alias("data"))


def _is_day_ahead(code: Column, name: Column) -> Column:
    return name.contains("D-1") | name.contains("预测") | code.endswith("1")


def series_points(payload: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per (payload, series code, point)."""
    groups = payload.select(*keys, F.explode("data").alias("list", "series")).where(
        F.col("list").endswith("EchartsDataList"))
    series = groups.select(*keys, F.explode("series").alias("s"))
    code, name = F.coalesce("s.legendCode", F.lit("")), F.coalesce("s.legendName", F.lit(""))
    return series.select(
        *keys, code.alias("code"), _is_day_ahead(code, name).alias("is_d1"),
        F.posexplode(F.arrays_zip(F.col("s.xAxisYYList").alias("x"), F.col("s.yAxisList").alias("y"))).alias("pos", "p"),
    ).select(*keys, "code", "is_d1", "pos", F.col("p.x").alias("label"), F.col("p.y").alias("value"))


def fallback(value: Column, d1: Column, has_series: Column, treat_zero_as_missing: bool = True) -> Column:
    """Measured value, or a positive day-ahead value where the measured one is missing."""
    missing = value.isNull() | (value == 0) if treat_zero_as_missing else value.isNull()
    return F.when(has_series & missing & (d1 > 0), d1).otherwise(value)


def unnest_payload(payload: DataFrame, *, keys: Sequence[str] = (), codes: dict[str, str] | None = None,
                   treat_zero_as_missing: bool = True, target_day: Column | None = None,
                   use_fallback: bool = True) -> DataFrame:
    """Payloads to one row per interval start and a column per channel.

    Measured and day-ahead series are pivoted side by side in one aggregation,
    so the pairing needs no self-join. Labels are interval ends.
    """
    codes = codes or dims.PAYLOAD_CODES
    keys = list(keys)
    points = series_points(payload, keys)
    ts = labels.interval_start(labels.parse_time_label(F.col("label")), QUARTER)
    points = points.withColumn("ts", ts).where(F.col("ts").isNotNull())
    if target_day is not None:
        points = points.where(F.to_date("ts") == target_day)
    value = F.col("value")
    aggs: list[Column] = []
    for code, channel in codes.items():
        own = (F.col("code") == code) & ~F.col("is_d1")
        pair = (F.col("code") == dims.paired_code(code)) & F.col("is_d1")
        aggs += [
            F.max(F.when(own, value)).alias(f"_v_{channel}"),
            F.max(F.when(pair, value)).alias(f"_d_{channel}"),
            F.coalesce(F.max(own), F.lit(False)).alias(f"_h_{channel}"),
        ]
    wide = points.groupBy(*keys, "ts").agg(*aggs)
    pick = lambda ch: (
        fallback(F.col(f"_v_{ch}"), F.col(f"_d_{ch}"), F.col(f"_h_{ch}"), treat_zero_as_missing)
        if use_fallback else F.col(f"_v_{ch}")
    )
    return wide.select(*keys, "ts", *[pick(ch).alias(ch) for ch in codes.values()])


def valid_rows(df: DataFrame) -> DataFrame:
    """Rows with unknown or positive load."""
    return df.where(F.col("load").isNull() | (F.col("load") > 0))


def ingest_payloads(payload: DataFrame, *, keys: Sequence[str] = (), target_day: Column | None = None,
                    treat_zero_as_missing: bool = True) -> DataFrame:
    rows = valid_rows(unnest_payload(payload, keys=keys, target_day=target_day,
                                     treat_zero_as_missing=treat_zero_as_missing))
    return rows.withColumn("day_type", day_type(F.col("ts")))
