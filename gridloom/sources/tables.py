"""Reading measured and weather tables, sheets and map columns."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import dims
from gridloom.functions import labels
from gridloom.functions.calendar import day_type
from gridloom.functions.timegrid import col, finite


def cast_channels(df: DataFrame, cols: Sequence[str] = tuple(dims.CHANNELS)) -> DataFrame:
    """Stored decimals to the doubles all operators compute with."""
    return df.withColumns({c: col(c).cast("double") for c in cols if c in df.columns})


#: Partition of a stored grid: year and month as a number such as 202401.
MONTH = "month"


def month_of(ts: Column) -> Column:
    return F.year(ts) * 100 + F.month(ts)


def read_grid(spark: SparkSession, path: str, *, extra: Sequence[str] = (), start: str | None = None, end: str | None = None) -> DataFrame:
    """Quarter-hour table with the declared channels only; nothing is sorted.

    Of a range (`start` included, `end` not) only the months of the range are
    opened where the table is partitioned by month.
    """
    df = spark.read.parquet(path)
    bound = lambda x: F.lit(x).cast("timestamp_ntz")
    for limit, cut in ((start, lambda c, x: c >= x), (end, lambda c, x: c <= x)):
        if limit is not None and MONTH in df.columns:
            df = df.where(cut(F.col(MONTH), month_of(bound(limit))))
    df = df if start is None else df.where(F.col("ts") >= bound(start))
    df = df if end is None else df.where(F.col("ts") < bound(end))
    wanted = ["ts", *extra, *dims.CHANNELS, "day_type"]
    return cast_channels(df.select(*[col(c) for c in wanted if c in df.columns]))


def scan_range(df: DataFrame, start: str | Column, end: str | Column, *, ts: str = "ts") -> DataFrame:
    """Half-open range on the stored column, so the filter reaches the file scan."""
    as_ts = lambda x: F.lit(x).cast("timestamp_ntz") if isinstance(x, str) else x
    return df.where((col(ts) >= as_ts(start)) & (col(ts) < as_ts(end)))


def columns_matching(columns: Iterable[str], patterns: Sequence[str]) -> list[str]:
    """Names that match any pattern, in their own order; works on the schema only."""
    found = [re.compile(p) for p in patterns]
    return [c for c in columns if any(p.search(c.strip()) for p in found)]


def select_by_pattern(df: DataFrame, patterns: Sequence[str], *, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*[col(k) for k in keep], *[col(c).alias(c.strip()) for c in columns_matching(df.columns, patterns)])


def pack_json(df: DataFrame, cols: Sequence[str], *, keep: Sequence[str] = ("ts",), out: str = "variables") -> DataFrame:
    """One JSON object per row; a null keeps its key."""
    packed = F.to_json(F.struct(*[col(c) for c in cols]), {"ignoreNullFields": "false"})
    return df.select(*[col(k) for k in keep], packed.alias(out))


def try_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text to double; what is not a finite number becomes null."""
    return df.withColumns({c: finite(F.trim(col(c)).try_cast("double")) for c in cols})


def fill_constant(df: DataFrame, cols: Sequence[str], value: float = 0.0) -> DataFrame:
    return df.withColumns({c: F.coalesce(col(c), F.lit(value)) for c in cols})


def read_base_table(sheet: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Base sheet to a channel table and a packed weather table."""
    sheet = sheet.select(*[col(c).alias(c.strip()) for c in sheet.columns])
    timed = sheet.withColumn("ts", F.try_to_timestamp("datetime_bj").cast("timestamp_ntz"))
    known = {h: c for h, c in dims.BASE_SHEET_COLUMNS.items() if h in sheet.columns}
    numeric = [c for c in known.values() if c != "day_type"]
    grid = timed.select("ts", *[col(h).cast("string").alias(c) for h, c in known.items()])
    grid = try_numeric(grid, numeric)
    if "day_type" in known.values():
        grid = grid.withColumn("day_type", F.trim("day_type"))
    weather_cols = columns_matching(sheet.columns, dims.WEATHER_HEADER_PATTERNS)
    return grid, pack_json(timed, weather_cols)


def read_disclosure(sheet: DataFrame) -> DataFrame:
    """Disclosure sheet: interval-end times to interval starts, positive load only."""
    known = {h: c for h, c in dims.DISCLOSURE_COLUMNS.items() if h in sheet.columns}
    end = labels.parse_sheet_time(col("日期").cast("string"), col("时点").cast("string"))
    df = sheet.select(labels.interval_start(end).alias("ts"), *[col(h).cast("string").alias(c) for h, c in known.items()])
    df = try_numeric(df, list(known.values()))
    if "load" in df.columns:
        df = df.where(F.col("load") > 0)
    return df.withColumn("day_type", day_type(F.col("ts")))


def hourly_response(df: DataFrame, *, zone: str = "Asia/Shanghai") -> DataFrame:
    """Hourly provider response (node, arrays per variable) to rows (time, key, value).

    Columns: `node`, `time` (array of epoch seconds) and one array per variable.
    """
    variables = [v for v in dims.VARIABLES if v in df.columns]
    zipped = F.arrays_zip("time", *variables)
    rows = df.select("node", F.explode(zipped).alias("r"))
    pairs = F.array(*[F.struct(F.concat_ws("_", F.lit(v), "node").alias("key"), F.col(f"r.{v}").cast("double").alias("value"))
                      for v in variables])
    long = rows.select(labels.local_from_epoch(F.col("r.time"), zone).alias("ts"), F.explode(pairs).alias("p"))
    value = F.col("p.value")
    return long.select("ts", "p.key", value.alias("value")).where(value.isNotNull() & ~F.isnan(value))
