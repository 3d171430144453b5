"""Day shapes, weather clusters, quantile flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import dims
from gridloom.bindings import tables as t
from gridloom.bindings.ctes import DAY, PERIOD, ora
from gridloom.bindings.registry import query
from gridloom.operators import daily, quantiles, spatial
from gridloom.sources import tables as src

S = t.SERIES
CORE = ["solar", "hydro", "wind", "load"]


def _part(fn: str, c: str, cond: str, n: int) -> str:
    return f"CASE WHEN count(CASE WHEN {cond} THEN {c} END) = {n} THEN {fn}(CASE WHEN {cond} THEN {c} END) END"


def _morning_sql(c: str) -> str:
    at = lambda p: f"max(CASE WHEN p = {p} THEN {c} END)"
    return (f"{_part('avg', c, 'p <= 34', 35)} AS morning_mean_{c}, {at(34)} AS morning_last_{c}, {at(34)} - {at(24)} AS morning_ramp_{c}, "
            f"round({_part('stddev_pop', c, 'p <= 34', 35)}, 3) AS morning_std_{c}")


@query("morning_snapshot", ora(
    "SELECT series_id, day, " + ", ".join(_morning_sql(c) for c in CORE) + f" FROM (SELECT *, {PERIOD} AS p, {DAY} AS day FROM grid) GROUP BY 1, 2", "grid"))
def morning_snapshot(spark, sf):
    out = daily.morning_snapshot(t.grid(spark, sf), CORE, series=S)
    return out.withColumns({f"morning_std_{c}": F.round(f"morning_std_{c}", 3) for c in CORE})


def _curve_sql(c: str, op: str) -> str:
    hi = lambda a, b: _part("max", c, f"p BETWEEN {a} AND {b}", b - a + 1)
    full = lambda fn: _part(fn, c, "p >= 0", 96)
    return {
        "peak": full("max"), "mean": full("avg"), "range": f"{full('max')} - {full('min')}", "std": f"round({full('stddev_pop')}, 3)", "total": full("sum"),
        "night_mean": _part("avg", c, "(p < 20 OR p >= 88)", 28), "daytime_mean": _part("avg", c, "p BETWEEN 28 AND 75", 48),
        "ramp_up": f"{hi(28, 75)} - max(CASE WHEN p = 28 THEN {c} END)",
        "duration": f"CASE WHEN count({c}) = 96 THEN CAST(count(CASE WHEN {c} > 100 THEN 1 END) AS DOUBLE) END",
        "morning_peak": hi(20, 35), "evening_peak": hi(68, 87), "valley": _part("min", c, "p BETWEEN 40 AND 67", 28),
        "peak_ratio": f"CASE WHEN {hi(20, 35)} > 0 THEN {hi(68, 87)} / ({hi(20, 35)} + 1) WHEN {hi(20, 35)} <= 0 AND {hi(68, 87)} IS NOT NULL THEN 0 END",
    }[op]


SPECS = {"solar": daily.CURVE_OPS, "load": daily.CURVE_OPS}


@query("prev_day_curve", ora(
    "SELECT d.series_id, d.day, " + ", ".join(f"b.{c}_{op} AS d2_{c}_{op}" for c, ops in SPECS.items() for op in ops) +
    " FROM per d LEFT JOIN per b ON b.series_id = d.series_id AND b.day = d.day - INTERVAL 1 DAY", "grid",
    per="SELECT series_id, day, " + ", ".join(f"{_curve_sql(c, op)} AS {c}_{op}" for c, ops in SPECS.items() for op in ops) +
        f" FROM (SELECT *, {PERIOD} AS p, {DAY} AS day FROM grid) GROUP BY 1, 2"))
def prev_day_curve(spark, sf):
    out = daily.prev_day_curve(t.grid(spark, sf), SPECS, series=S)
    return out.withColumns({f"d2_{c}_std": F.round(f"d2_{c}_std", 3) for c in SPECS})


@query("diurnal_range", ora(
    f"SELECT series_id, ts, load, max(load) OVER d - min(load) OVER d AS load_range FROM (SELECT *, {DAY} AS day FROM grid) WINDOW d AS (PARTITION BY series_id, day)", "grid"))
def diurnal_range(spark, sf):
    return daily.diurnal_range(t.grid(spark, sf).select("series_id", "ts", "load"), "load", "load_range", series=S)


_CLUSTER_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{n}')" for c, ns in dims.CLUSTERS.items() for n in ns) + ") v(cluster, node)"
_WEIGHT_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{v}', '{c}', {w}::DOUBLE)" for v, ws in dims.REGION_WEIGHTS.items() for c, w in ws.items()) + ") v(variable, cluster, weight)"
_PARTS = "SELECT ts, split_part(key, '_', 1) AS variable, substr(key, strpos(key, '_') + 1) AS node, value FROM wx_long"


@query("cluster_mean", ora(
    "SELECT p.ts, p.variable, c.cluster, round(avg(value), 9) AS value, round(sum(value) / max(r.n), 9) AS zero_filled FROM parts p JOIN cl c ON c.node = p.node "
    "JOIN (SELECT variable, cluster, count(DISTINCT p.node) AS n FROM parts p JOIN cl c ON c.node = p.node GROUP BY 1, 2) r ON r.variable = p.variable AND r.cluster = c.cluster GROUP BY 1, 2, 3",
    "wx_long", parts=_PARTS, cl=_CLUSTER_SQL))
def cluster_mean(spark, sf):
    long = spatial.map_to_long(t.weather_obs(spark, sf))
    keys = ["ts", "variable", "cluster"]
    zero = spatial.cluster_mean(long, zero_missing=True).select(*keys, F.round("value", 9).alias("zero_filled"))
    return spatial.cluster_mean(long).select(*keys, F.round("value", 9).alias("value")).join(zero, keys)


@query("cluster_fusion", ora(
    "SELECT m.ts, m.variable, CASE WHEN count(m.value) = max(n.need) THEN round(sum(m.value * w.weight), 6) END AS value FROM means m "
    "JOIN wt w ON w.variable = m.variable AND w.cluster = m.cluster JOIN (SELECT variable, count(*) AS need FROM wt GROUP BY 1) n ON n.variable = m.variable GROUP BY 1, 2",
    "wx_long", parts=_PARTS, cl=_CLUSTER_SQL, wt=_WEIGHT_SQL,
    means="SELECT p.ts, p.variable, c.cluster, avg(value) AS value FROM parts p JOIN cl c ON c.node = p.node GROUP BY 1, 2, 3"))
def cluster_fusion(spark, sf):
    means = spatial.cluster_mean(spatial.map_to_long(t.weather_obs(spark, sf)))
    return spatial.cluster_fusion(means).withColumn("value", F.round("value", 6))


@query("unpack_json", ora(
    "SELECT ts, " + ", ".join(f"CAST(json_extract(variables, '$.{k}') AS DOUBLE) AS {k}" for k in dims.weather_keys()) + " FROM wx_obs", "wx_obs"))
def unpack_json(spark, sf):
    return spatial.unpack_map(t.weather_obs(spark, sf))


@query("long_to_map", ora("SELECT ts, variables FROM wx_obs", "wx_obs"))
def long_to_map(spark, sf):
    return spatial.long_to_map(t.weather_long(spark, sf))


_PACKED = ["price", "load", "solar"]


@query("pack_json", ora(
    "SELECT series_id, ts, '{' || " + " || ',' || ".join(f"'\"{c}\":' || coalesce(CAST({c} AS VARCHAR), 'null')" for c in _PACKED) + " || '}' AS variables FROM raw_grid", "raw_grid"))
def pack_json(spark, sf):
    return src.pack_json(t.raw_grid(spark, sf), _PACKED, keep=["series_id", "ts"])


@query("select_by_pattern", ora("SELECT series_id, ts, load, load_tie, tieline, solar FROM raw_grid", "raw_grid"))
def select_by_pattern(spark, sf):
    return src.select_by_pattern(t.raw_grid(spark, sf), [r"^load", r"tieline$", r"^sol"], keep=S + ["ts"])


def _flag_sql(c: str, lo: float, hi: float) -> str:
    return (f"CASE WHEN n > 100 AND {c} > quantile_cont({c}, {hi}) OVER m THEN 1.0::DOUBLE WHEN n > 100 AND {c} < quantile_cont({c}, {lo}) OVER m THEN -1.0::DOUBLE "
            f"ELSE 0.0::DOUBLE END AS extreme_{c}")


FLAGS = {"load": (0.1, 0.9), "price": (0.05, 0.95), "solar": (0.1, 0.9), "wind": (0.1, 0.9)}


@query("month_quantile_flag", ora(
    "SELECT series_id, ts, " + ", ".join(_flag_sql(c, lo, hi) for c, (lo, hi) in FLAGS.items()) +
    " FROM (SELECT *, month(ts) AS mon, count(*) OVER (PARTITION BY series_id, month(ts)) AS n FROM raw_year) WINDOW m AS (PARTITION BY series_id, mon)", "raw_year"))
def month_quantile_flag(spark, sf):
    g = t.raw_year(spark, sf).select("series_id", "ts", *FLAGS)
    return quantiles.quantile_flag(g, FLAGS, series=S).drop(*FLAGS)


@query("joint_extreme_flag", ora(
    "SELECT g.series_id, g.ts, g.load > q.l AND g.solar < q.s AS high_load_low_solar FROM (SELECT series_id, ts, load, solar FROM raw_year WHERE load IS NOT NULL AND solar IS NOT NULL) g, "
    "(SELECT quantile_cont(load, 0.7) AS l, quantile_cont(solar, 0.3) AS s FROM raw_year) q", "raw_year"))
def joint_extreme_flag(spark, sf):
    """Cut-offs over the whole table, from the distributed exact quantile."""
    g = t.raw_year(spark, sf).select("series_id", "ts", "load", "solar")
    high = quantiles.exact_quantiles(g, "load", [0.7]).select(F.col("q0").alias("l"))
    low = quantiles.exact_quantiles(g, "solar", [0.3]).select(F.col("q0").alias("s"))
    known = g.where(F.col("load").isNotNull() & F.col("solar").isNotNull())
    cuts = F.broadcast(high.crossJoin(low))  # one row
    return known.crossJoin(cuts).select("series_id", "ts", ((F.col("load") > F.col("l")) & (F.col("solar") < F.col("s"))).alias("high_load_low_solar"))


@query("exact_quantiles", "SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.1), 4) AS q0, round(quantile_cont(l_extendedprice, 0.5), 4) AS q1, "
                          "round(quantile_cont(l_extendedprice, 0.9), 4) AS q2 FROM (SELECT l_returnflag, round(l_extendedprice * 100) AS l_extendedprice FROM lineitem) GROUP BY 1")
def exact_quantiles(spark, sf):
    li = t.table(spark, sf, "lineitem").select("l_returnflag", F.round(F.col("l_extendedprice") * 100).alias("cents"))
    out = quantiles.exact_quantiles(li, "cents", [0.1, 0.5, 0.9], by=["l_returnflag"])
    return out.withColumns({q: F.round(q, 4) for q in ("q0", "q1", "q2")})
