"""Calendar rules, landed feeds, keyed tables."""

import json
from datetime import date, datetime

from grid_helpers import START, at, column
from pyspark.sql import functions as F

from gridloom import dims
from gridloom.functions import calendar, derived, labels
from gridloom.operators import spatial
from gridloom.session import work_path
from gridloom.sources import payload, store
from gridloom.sources import tables as src


def periods(spark):
    return spark.range(96).select(F.col("id").cast("int").alias("p"))


def test_blend_weights_sum_to_one_and_ramp(spark):
    rows = {r.p: r for r in periods(spark).select("p", *[e.alias(n) for n, e in calendar.blend_weights(F.col("p")).items()]).collect()}
    assert all(abs(r.w_valley + r.w_peak + r.w_base - 1) < 1e-12 for r in rows.values())
    assert [rows[p].w_valley for p in (31, 32, 33, 35, 36, 63, 64, 67, 68)] == [0.0, 0.0, 0.25, 0.75, 1.0, 1.0, 1.0, 0.25, 0.0]
    assert [rows[p].w_peak for p in (64, 67, 68, 83, 84, 87, 88)] == [0.0, 0.75, 1.0, 1.0, 1.0, 0.25, 0.0]


def test_segments_cover_the_day(spark):
    rows = periods(spark).select("p", calendar.segment_of(F.col("p")).alias("s"), calendar.period_to_time(F.col("p")).alias("t"),
                                 *[e.alias(n) for n, e in calendar.segment_masks(F.col("p")).items()]).collect()
    for r in rows:
        assert [r.valley_infer, r.peak_infer, r.base_infer].count(True) == 1 and r[f"{r.s}_infer"]
        assert r.t == f"{r.p // 4:02d}:{r.p % 4 * 15:02d}"


def test_season_edges(spark):
    df = spark.createDataFrame([(datetime(2024, m, 1),) for m in range(1, 13)], "ts timestamp_ntz")
    rows = df.select(calendar.season(F.col("ts")).alias("t"), calendar.serving_season(F.col("ts")).alias("s")).collect()
    assert [r.t for r in rows] == ["dry"] * 4 + ["wet"] * 2 + [None] * 6
    assert [r.s for r in rows] == ["dry"] * 4 + ["wet"] * 5 + [None] * 3


def test_day_type_holiday_before_weekend(spark):
    days = [datetime(2026, 1, 3), datetime(2026, 1, 4), datetime(2026, 1, 5), datetime(2026, 2, 15), datetime(2026, 5, 5), datetime(2026, 5, 6)]
    df = spark.createDataFrame([(d,) for d in days], "ts timestamp_ntz")
    assert [r.k for r in df.select(calendar.day_type(F.col("ts")).alias("k")).collect()] == ["节假日", "周末", "工作日", "节假日", "节假日", "工作日"]


def test_event_distance_is_signed(spark):
    df = spark.createDataFrame([(datetime(2026, 2, 16, 23, 45),), (datetime(2026, 2, 28),)], "ts timestamp_ntz")
    rows = df.select(calendar.days_from(F.col("ts"), dims.SPRING_FESTIVAL).alias("d"), calendar.near_event(F.col("ts"), dims.SPRING_FESTIVAL).alias("n")).collect()
    assert [(r.d, r.n) for r in rows] == [(-1, True), (11, False)]


def test_unknown_values_never_raise_a_flag(spark):
    df = spark.createDataFrame([(None,), (11.0,)], "x double")
    rows = df.select(derived.is_daytime(F.col("x")).alias("d"), derived.cooling_degrees(F.col("x")).alias("c"), derived.share(F.col("x"), F.lit(-1.0)).alias("s")).collect()
    assert [(r.d, r.c, r.s) for r in rows] == [(0.0, None, None), (1.0, 0.0, None)]


def test_time_labels(spark):
    df = spark.createDataFrame([("260622 0015",), (" 260622 2400 ",), ("260630 2400",), ("2606 15",), ("269922 0015",), (None,)], "l string")
    got = [r.t for r in df.select(labels.parse_time_label(F.col("l")).alias("t")).collect()]
    assert got == [datetime(2026, 6, 22, 0, 15), datetime(2026, 6, 23), datetime(2026, 7, 1), None, None, None]
    start = df.limit(2).select(labels.interval_start(labels.parse_time_label(F.col("l"))).alias("t")).collect()
    assert start[1].t == datetime(2026, 6, 22, 23, 45)


def test_epoch_to_local(spark):
    df = spark.createDataFrame([(1767225600,)], "s long")
    assert df.select(labels.local_from_epoch(F.col("s")).alias("t")).first().t == datetime(2026, 1, 1, 8)


def feed(code, name, labels_, values):
    return {"legendCode": code, "legendName": name, "xAxisYYList": labels_, "yAxisList": values}


def test_payload_file_fallback_and_filters(spark, tmp_path):
    x = ["260622 0015", "260622 0030", "260622 0045", "260622 2400", "260623 0015"]
    body = {"code": 200, "data": {
        "solarEnergyEchartsDataList": [feed("solarEnergy0", "realtime", x, [0.0, None, 7.0, 0.0, 1.0]), feed("solarEnergy1", "D-1", x, [1.0, 2.0, 3.0, -4.0, 9.0])],
        "provincialLoadEchartsDataList": [feed("provincialLoad0", "realtime", x, [10.0, 10.0, 0.0, None, 5.0])],
        "windEnergyEchartsDataList": [feed("windEnergy1", "D-1", x, [5.0] * 5)],
        "noteEchartsDataList": "not a list", "other": [feed("hydroPower0", "realtime", x, [1.0] * 5)]}}
    (tmp_path / "a.json").write_text(json.dumps(body), encoding="utf-8")
    df = payload.read_payloads(spark, str(tmp_path))
    rows = payload.ingest_payloads(df, target_day=F.lit("2026-06-22").cast("date")).orderBy("ts").collect()
    assert [r.ts for r in rows] == [datetime(2026, 6, 22, 0, 0), datetime(2026, 6, 22, 0, 15), datetime(2026, 6, 22, 23, 45)]  # load 0 left out
    assert [r.solar for r in rows] == [1.0, 2.0, 0.0]
    assert [r.wind for r in rows] == [None] * 3       # no measured wind series, so no fallback
    assert [r.hydro for r in rows] == [None] * 3      # not in a *EchartsDataList member
    strict = payload.unnest_payload(df, treat_zero_as_missing=False).orderBy("ts").collect()
    assert [r.solar for r in strict] == [0.0, 2.0, 7.0, 0.0, 1.0]


def test_disclosure_sheet(spark):
    df = spark.createDataFrame([("2026/6/22", 15, "10", "x"), ("2026-06-22", 2400, "11", "3.5"), ("2026-06-22", 30, "0", "1")],
                               "`日期` string, `时点` int, `省内负荷（MW）-实时` string, `联络线-实时` string")
    rows = src.read_disclosure(df).orderBy("ts").collect()
    assert [(r.ts, r.load, r.tieline) for r in rows] == [(datetime(2026, 6, 22), 10.0, None), (datetime(2026, 6, 22, 23, 45), 11.0, 3.5)]


def test_base_sheet_selects_weather_by_header(spark):
    df = spark.createDataFrame([("2026-01-01 00:00:00", "5", "1.5", None, "9")],
                               "datetime_bj string, `出清价格(元/MWh)` string, `成都_气温(℃)` string, `成都_HDD` string, `成都_湿度(%)` string")
    grid, weather = src.read_base_table(df)
    assert grid.first().price == 5.0
    assert json.loads(weather.first().variables) == {"成都_气温(℃)": "1.5", "成都_HDD": None}


def test_hourly_response(spark):
    df = spark.createDataFrame([("n1", [1767225600, 1767229200], [1.0, float("nan")], [None, 4.0])], "node string, time array<long>, temp array<double>, rh array<double>")
    rows = sorted((r.ts, r.key, r.value) for r in src.hourly_response(df).collect())
    assert rows == [(datetime(2026, 1, 1, 8), "temp_n1", 1.0), (datetime(2026, 1, 1, 9), "rh_n1", 4.0)]
    packed = spatial.long_to_map(src.hourly_response(df)).orderBy("ts").collect()
    assert [json.loads(r.variables) for r in packed] == [{"temp_n1": 1.0}, {"rh_n1": 4.0}]


def test_cluster_mean_modes(spark):
    obs = spark.createDataFrame([(at(0), '{"temp_cd_center": 4.0, "temp_cd_west": 8.0}'), (at(4), '{"temp_cd_center": 6.0}')], "ts timestamp_ntz, variables string")
    long = spatial.map_to_long(obs)
    mean = {r.ts: r.value for r in spatial.cluster_mean(long).collect()}
    zero = {r.ts: r.value for r in spatial.cluster_mean(long, zero_missing=True).collect()}
    assert mean == {at(0): 6.0, at(4): 6.0}
    # the third node never reports; a node without a row at a time adds nothing to the sum
    assert zero == {at(0): 6.0, at(4): 3.0}
    wide = spatial.unpack_map(obs, keys=["temp_cd_center", "temp_cd_west"])
    expr = spatial.cluster_mean_expr("temp", "chengdu", wide.columns, zero_missing=True)
    assert column(wide.withColumn("m", expr), "m", ["ts"]) == [6.0, 3.0]


def test_upsert_is_idempotent_and_ordered(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, v string, x double")
    new = spark.createDataFrame([(2, "c", None, 1), (2, "d", 5.0, 2), (3, "e", 6.0, 1)], "k int, v string, x double, seq int")
    merged = store.upsert_latest(old.withColumn("seq", F.lit(0)), new, ["k"], F.col("seq"))
    rows = lambda df: sorted((r.k, r.v, r.x) for r in df.collect())
    assert rows(merged) == [(1, "a", 1.0), (2, "d", 5.0), (3, "e", 6.0)]
    assert rows(store.upsert_latest(merged, new, ["k"], F.col("seq"))) == rows(merged)
    whole_row = store.upsert_latest(old, new.where("v = 'c'").drop("seq"), ["k"])
    assert rows(whole_row) == [(1, "a", 1.0), (2, "c", None)]   # nulls replace, too


def test_replaced_predictions_leave_other_series(spark):
    path = work_path(spark, "pred")
    schema = "series_id string, target_time timestamp_ntz, predicted_price double, model_version string"
    store.replace_predictions(spark.createDataFrame([(s, at(k), 1.0, "v") for s in ("a", "b", None) for k in (0, 1, 96)], schema), path)
    store.replace_predictions(spark.createDataFrame([("a", at(0), 2.0, "v"), ("c", at(0), 3.0, "v")], schema), path)
    got = sorted((r.series_id or "", r.target_time, r.predicted_price) for r in spark.read.parquet(path).collect())
    assert got == [("", at(0), 1.0), ("", at(1), 1.0), ("", at(96), 1.0), ("a", at(0), 2.0), ("a", at(96), 1.0),
                   ("b", at(0), 1.0), ("b", at(1), 1.0), ("b", at(96), 1.0), ("c", at(0), 3.0)]


def test_partition_writes_touch_only_their_dates(spark):
    path = work_path(spark, "pred")
    rows = [(at(i * 96), float(i), v) for i in range(3) for v in ("v", "w")]
    pred = spark.createDataFrame(rows, "target_time timestamp_ntz, predicted_price double, model_version string")
    store.replace_predictions(pred, path)
    store.replace_predictions(pred.where((F.col("model_version") == "v") & (F.col("predicted_price") == 1.0)).withColumn("predicted_price", F.lit(9.0)), path)
    got = sorted((r.model_version, r.predicted_price) for r in spark.read.parquet(path).collect())
    assert got == [("v", 0.0), ("v", 2.0), ("v", 9.0), ("w", 0.0), ("w", 1.0), ("w", 2.0)]
    kept = store.prune_superseded(pred, version="v", gap_version="w")
    assert sorted(r.model_version for r in kept.collect()) == ["v"] * 3
    short = pred.where((F.col("model_version") == "w") | (F.col("predicted_price") < 1))
    assert [r.predicted_price for r in store.gap_fill_days(short, version="v", gap_version="w").orderBy("target_time").collect()] == [1.0, 2.0]


def test_registry_archives_the_previous_model(spark):
    m = spark.createDataFrame([("dry", "peak", 1.5), ("wet", "base", 2.5)], "season string, segment string, mae double")
    first = store.register_models(None, m, version_tag="a")
    lagged = store.register_models(first, m, version_tag="b", suffix="_lag192")
    second = store.register_models(lagged, m.where("season = 'dry'"), version_tag="c")
    status = {r.version_name + r.model_type: r.status for r in second.collect()}
    assert status["stage2_dry_peak_astage2_price_peak"] == "archived" and status["stage2_wet_base_astage2_price_base"] == "active"
    assert status["stage2_dry_peak_bstage2_price_peak_lag192"] == "active"
    assert store.active_models(second).count() == 4


def test_numbers_that_are_not_finite_are_missing(spark):
    from gridloom.operators import spatial
    from gridloom.sources import tables

    df = spark.createDataFrame([("1.5",), ("NaN",), (" nan",), ("inf",), ("-Infinity",), ("x",), (None,)], "v string")
    assert [r.v for r in tables.try_numeric(df, ["v"]).collect()] == [1.5] + [None] * 6
    packed = spark.createDataFrame([('{"a": "NaN", "b": 2.0}',)], "variables string")
    assert spatial.as_map(packed).first().variables == {"a": None, "b": 2.0}


def test_each_series_is_pruned_by_its_own_last_day(spark):
    from gridloom.sources import store

    rows = [("a", f"2024-01-0{d} 00:00:00", "normal") for d in (1, 2, 3)] + [("b", "2024-01-01 00:00:00", "normal")]
    rows += [("b", f"2024-01-0{d} 00:00:00", "gap") for d in (1, 2, 3)]
    pred = spark.createDataFrame(rows, "series_id string, target_time string, model_version string").selectExpr(
        "series_id", "cast(target_time as timestamp_ntz) target_time", "model_version")
    how = dict(version="normal", gap_version="gap", keys=["series_id"])
    assert store.prune_superseded(pred, **how).where("model_version = 'gap'").count() == 2
    assert store.gap_fill_days(pred, **how).count() == 2


def test_series_are_pruned_by_their_own_last_day_unless_told_otherwise(spark):
    from gridloom.sources import store

    rows = [("a", f"2024-01-0{d} 00:00:00", "normal") for d in (1, 2, 3)] + [("b", "2024-01-01 00:00:00", "normal")]
    rows += [("b", f"2024-01-0{d} 00:00:00", "gap") for d in (1, 2, 3)]
    pred = spark.createDataFrame(rows, "series_id string, target_time string, model_version string").selectExpr(
        "series_id", "cast(target_time as timestamp_ntz) target_time", "model_version")
    how = dict(version="normal", gap_version="gap")
    assert store.prune_superseded(pred, **how).where("model_version = 'gap'").count() == 2
    assert store.gap_fill_days(pred, **how).count() == 2
    assert store.gap_fill_days(pred, **how, keys=()).count() == 0
