"""The sample tables as engine inputs.

Every input is a deterministic view of the given Parquet tables; the same views
are written once more as SQL in `ctes.py`. Money is counted in whole cents, so
that sums are exact and do not depend on the order of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import dims
from gridloom.operators import regular
from gridloom.operators.shift import lag_by
from gridloom.operators.spatial import long_to_map
from gridloom.functions.timegrid import HOUR, floor_time

SERIES = ["series_id"]
FAR_FUTURE = "2100-01-01 00:00:00"
VERSION, GAP_VERSION = "v", "v_lag192"
CHANNEL_EVENTS = {"price": "purchase", "load": "view", "solar": "click", "wind": "error", "hydro": "signup"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.round(F.col("value") * 100).alias("cents"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def _channel_aggs() -> dict[str, Column]:
    kind = F.col("event_type")
    of = lambda which, x: F.sum(F.when(kind.isin(which), x)).cast("double")
    aggs = {c: of([e], F.col("cents")) for c, e in CHANNEL_EVENTS.items()}
    aggs["renewable_total"] = of(["click", "error"], F.col("cents"))
    aggs["bidspace"] = of(["purchase"], F.col("k"))
    aggs["reserve"] = of(["error"], F.col("k"))
    aggs["nonmarket"] = of(["click"], F.col("k"))
    aggs["tieline"] = of(["signup"], -F.col("k"))
    aggs["load_tie"] = of(["view"], F.col("cents") + F.col("k"))
    return aggs


def raw_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarter-hour bins of the event stream, four series, with real gaps."""
    e = events(spark, sf_dir).withColumn("series_id", (F.col("user_id") % 4).cast("int"))
    return regular.bin_rows(e, _channel_aggs(), series=SERIES)


def raw_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarter-hour bins in fifty series, sparse at every scale of the samples."""
    e = events(spark, sf_dir).withColumn("series_id", (F.col("user_id") % 50).cast("int"))
    return regular.bin_rows(e, {"n": F.count("*")}, series=SERIES)


def raw_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events spread over twelve 30-day blocks by user, two series: all seasons occur."""
    e = events(spark, sf_dir).withColumns({
        "series_id": (F.col("user_id") % 2).cast("int"),
        "ts": F.col("ts") + F.make_dt_interval((F.floor(F.col("user_id") / 2) % 12 * 30).cast("int")),
    })
    return regular.bin_rows(e, _channel_aggs(), series=SERIES)


def gap_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regular grid, absent bins null."""
    return regular.regularize(raw_grid(spark, sf_dir), series=SERIES)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regular grid, carried forward."""
    return regular.densify(raw_grid(spark, sf_dir), series=SERIES)


def year_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regular.densify(raw_year(spark, sf_dir), series=SERIES)


def _weather_key() -> Column:
    names = F.array(*[F.lit(v) for v in dims.VARIABLES])
    nodes = F.array(*[F.lit(n) for n, _, _ in dims.NODES])
    return F.concat(
        names[(F.col("event_id") % len(dims.VARIABLES)).cast("int")], F.lit("_"),
        nodes[(F.col("user_id") % len(dims.NODES)).cast("int")])


def weather_long(spark: SparkSession, sf_dir: str, *, year: bool = False) -> DataFrame:
    """Hourly mean per weather key."""
    e = events(spark, sf_dir)
    if year:
        e = e.withColumn("ts", F.col("ts") + F.make_dt_interval((F.floor(F.col("user_id") / 2) % 12 * 30).cast("int")))
    return (
        e.groupBy(floor_time(F.col("ts"), HOUR).alias("ts"), _weather_key().alias("key"))
        .agg(F.avg("k").alias("value"))
    )


def weather_obs(spark: SparkSession, sf_dir: str, *, year: bool = False) -> DataFrame:
    return long_to_map(weather_long(spark, sf_dir, year=year))


def forecast_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs every half day; most target hours are covered by two of them."""
    e = events(spark, sf_dir)
    hour = floor_time(F.col("ts"), HOUR)
    long = e.groupBy(
        floor_time(F.col("ts"), 720).alias("fetch_time"),
        (hour + F.make_dt_interval((1 + F.col("event_id") % 2).cast("int"))).alias("target_time"),
        _weather_key().alias("key"),
    ).agg(F.avg("k").alias("value"))
    return long_to_map(long, keys=["fetch_time", "target_time"])


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations, continued by the newest forecasts."""
    merged = regular.obs_over_forecast(
        weather_obs(spark, sf_dir), forecast_runs(spark, sf_dir), as_of=F.lit(FAR_FUTURE).cast("timestamp_ntz"))
    return merged.select("ts", "variables")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping versions: a lag blend on even days, a plain lag on all days."""
    g = lag_by(grid(spark, sf_dir).select(*SERIES, "ts", "price"),
               {"l96": ("price", 96), "l192": ("price", 192), "l672": ("price", 672)}, series=SERIES)
    even = F.unix_date(F.to_date("ts")) % 2 == 0
    blend = g.where(even).select(
        *SERIES, F.col("ts").alias("target_time"), (F.col("l96") * 0.7 + F.col("l672") * 0.3).alias("predicted_price"),
        F.lit(VERSION).alias("model_version"))
    plain = g.select(*SERIES, F.col("ts").alias("target_time"), F.col("l192").alias("predicted_price"),
                     F.lit(GAP_VERSION).alias("model_version"))
    return blend.unionByName(plain).where(F.col("predicted_price").isNotNull())


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One landed payload per series and day, holding measured and day-ahead series of all channels.

    A bin with events of other kinds measures 0, a bin without events is null.
    The lists of one payload have at most 96 points.
    """
    raw = raw_grid(spark, sf_dir)
    full = regular.regularize(raw.withColumn("seen", F.lit(1)), series=SERIES)
    end = F.col("ts") + F.expr("INTERVAL 15 MINUTES")
    midnight = F.date_format(end, "HHmm") == "0000"
    label = F.concat_ws(" ", F.date_format("ts", "yyMMdd"), F.when(midnight, "2400").otherwise(F.date_format(end, "HHmm")))
    measured = lambda c: F.when(F.col("seen").isNotNull(), F.coalesce(F.col(c), F.lit(0.0)))
    codes = {v: k for k, v in dims.PAYLOAD_CODES.items()}
    series = []
    for c, code in codes.items():
        series.append((code, "realtime", measured(c)))
        series.append((dims.paired_code(code), "D-1", F.col("renewable_total")))
    one = lambda code, name, v: F.struct(
        F.lit(code).alias("code"), F.lit(name).alias("name"), label.alias("label"), v.alias("value"), F.col("ts"))
    long = full.select(*SERIES, F.to_date("ts").alias("day"),
                       F.explode(F.array(*[one(*s) for s in series])).alias("p")).select(*SERIES, "day", "p.*")
    lists = long.groupBy(*SERIES, "day", "code", "name").agg(
        F.array_sort(F.collect_list(F.struct("ts", "label", "value"))).alias("pts"))
    packed = lists.groupBy(*SERIES, "day").agg(F.collect_list(F.struct(
        F.col("code").alias("legendCode"), F.col("name").alias("legendName"),
        F.col("pts.label").alias("xAxisYYList"), F.col("pts.value").alias("yAxisList"))).alias("list"))
    return packed.select(*SERIES, "day", F.create_map(F.lit("gridEchartsDataList"), F.col("list")).alias("data"))


def split_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year grid with the day-ahead target and the lag anchors."""
    return lag_by(year_grid(spark, sf_dir).select(*SERIES, "ts", "price"),
                  {"y_price": ("price", -96), "price_lag96": ("price", 96), "price_lag192": ("price", 192),
                   "price_lag672": ("price", 672)}, series=SERIES)
