"""Exact quantiles and the flags built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.timegrid import col
from gridloom.session import materialise

ACCURACY = 20_000
#: Values of a bracket that one task sorts.
SORT_ROWS = 1_000_000
#: Parts of a bracket that is split again.
PARTS = 64


def exact_quantiles(df: DataFrame, c: str, probs: Sequence[float], *, by: Sequence[str] = (), accuracy: int = ACCURACY,
                    sort_rows: int = SORT_ROWS) -> DataFrame:
    """Linear-interpolated quantiles of groups of any size.

    `percentile` keeps all distinct values of a group in one task. Here equal
    values are counted first, and the counts written. Approximate quantiles just
    below and above each wanted one bracket it, about 6 / `accuracy` of a group
    lies between them; a bracket of more than `sort_rows` values is split again
    until it has fewer, and only then sorted. The brackets decide which rows share
    a task, never the result: counts and extremes of every bracket are taken from
    the data. Values meet their group's brackets by group and a share of the
    value's hash, so a group of a third of all rows is spread over all tasks.

    Returns one row per group: the keys, `n`, and `q0`, `q1`, ... in the order of `probs`.
    A null key is a group; null values count in none, and a group without values has no row.
    """
    names = [f"_k{i}" for i in range(len(by))]
    known = df.where(col(c).isNotNull()).select(*[col(b).alias(k) for b, k in zip(by, names)], col(c).alias("_v"))
    counts = materialise(known.groupBy(*names, "_v").agg(F.count("*").alias("_cnt")), "value-counts")
    margin = 2.0 / accuracy
    grid = sorted({min(1.0, max(0.0, q + d)) for q in probs for d in (-margin, margin)})
    edges = known.groupBy(*names).agg(F.percentile_approx("_v", grid, accuracy).alias("_edges"))
    buckets = _buckets(counts, edges, names)
    ordered = Window.partitionBy(*names).orderBy("_from")  # two rows per wanted quantile and one more
    buckets = buckets.withColumns({
        "_below": F.coalesce(F.sum("_in").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_n": F.sum("_in").over(Window.partitionBy(*names)),
    })
    ranks = F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(float(q)).alias("_q")) for i, q in enumerate(probs)])
    wanted = buckets.withColumn("_p", F.explode(ranks)).withColumn("_pos", F.col("_p._q") * (F.col("_n") - 1)).select(
        *names, "_n", "_below", "_in", "_from", "_to", F.col("_p._i").alias("_i"), "_pos",
        F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))).alias("_rank"))
    # the ranks of each wanted quantile, with their brackets
    wanted = materialise(wanted.where((F.col("_rank") >= F.col("_below")) & (F.col("_rank") < F.col("_below") + F.col("_in"))), "ranks")
    picked = _within(counts, wanted, names)
    if counts.count() > sort_rows:  # else no bracket can have more
        wanted, picked = _narrow(wanted, counts, names, sort_rows)
    keys = [*names, "_from"]
    inside = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = picked.withColumn("_upto", F.col("_below") + F.sum("_cnt").over(inside)).drop("_below")
    values = _meet(ranked, wanted, keys).where(
        (F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_cnt")))
    low, high = F.min("_v"), F.max("_v")
    share = F.max(F.col("_pos") - F.floor("_pos"))
    per = values.groupBy(*names, "_i").agg(F.max("_n").alias("n"), (low + (high - low) * share).alias("_q"))
    return per.groupBy(*[F.col(k).alias(b) for b, k in zip(by, names)]).agg(
        F.max("n").alias("n"), *[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(f"q{i}") for i in range(len(probs))])


def join_few(rows: DataFrame, few: DataFrame, keys: Sequence[str], *, how: str = "inner", spread: Sequence[str] = ()) -> DataFrame:
    """Join rows with a few rows per key, null keys included, without bringing a key's rows together.

    The rows of one key are dealt by a hash over as many shares as the session has
    shuffle partitions, the few rows are repeated for each share. The hash is that
    of the columns `spread`, of all but maps if none are named; rows alike in them
    share a task. Without keys `few` must be one row, which is broadcast.
    """
    keys = list(keys)
    if not keys:
        return rows.join(F.broadcast(few.limit(1)), F.lit(True), how)
    shares = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = list(spread) or [f.name for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]
    dealt = rows.withColumn("_share", F.pmod(F.xxhash64(*[col(c) for c in spread]), F.lit(shares)))
    repeated = few.select(*[col(k).alias(f"_few_{i}") for i, k in enumerate(keys)], *[col(c) for c in few.columns if c not in keys],
                          F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).alias("_few_share"))
    same = [col(k).eqNullSafe(F.col(f"_few_{i}")) for i, k in enumerate(keys)]
    return dealt.join(repeated, [F.col("_share") == F.col("_few_share"), *same], how).drop(
        "_share", "_few_share", *[f"_few_{i}" for i in range(len(keys))])


def _meet(values: DataFrame, few: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Values with the few rows of their key; without keys all values are one group."""
    return join_few(values.withColumn("_all", F.lit(0)), few.withColumn("_all", F.lit(0)), ["_all", *keys], spread=["_v"]).drop("_all")


def _buckets(counts: DataFrame, edges: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows and extremes of the values between a group's edges."""
    placed = _meet(counts, edges, names).withColumn("_bucket", F.size(F.filter("_edges", lambda e: e < F.col("_v"))))
    return placed.groupBy(*names, "_bucket").agg(
        F.sum("_cnt").alias("_in"), F.min("_v").alias("_from"), F.max("_v").alias("_to")).drop("_bucket")


def _within(counts: DataFrame, wanted: DataFrame, names: Sequence[str]) -> DataFrame:
    """Values inside the brackets of `wanted`, with `_from` and the rows `_below` their bracket."""
    brackets = wanted.select(*names, "_from", "_to", "_below").distinct()
    return _meet(counts, brackets, names).where(F.col("_v").between(F.col("_from"), F.col("_to"))).drop("_to")


def _narrow(wanted: DataFrame, counts: DataFrame, names: Sequence[str], sort_rows: int) -> tuple[DataFrame, DataFrame]:
    """Split brackets of more than `sort_rows` values, the parts that hold no wanted rank left out, until none is left.

    A part has about a 64th of its bracket's distinct values, so each round makes brackets that much smaller.
    """
    keys = [*names, "_from"]
    parts = [i / PARTS for i in range(1, PARTS)]
    while True:
        picked = materialise(_within(counts, wanted, names), "bracket")
        size = picked.groupBy(*keys).agg(F.count("*").alias("_size"))
        if (size.agg(F.max("_size")).first()[0] or 0) <= max(sort_rows, 2):  # one number
            return wanted, picked
        edges = picked.groupBy(*keys, "_below").agg(F.percentile_approx("_v", parts, PARTS * 16).alias("_edges"))
        placed = _meet(picked.drop("_below"), edges, keys).withColumn("_part", F.size(F.filter("_edges", lambda e: e < F.col("_v"))))
        split = placed.groupBy(*keys, "_below", "_part").agg(F.sum("_cnt").alias("_in"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most 64 rows
        split = split.withColumn("_below", F.col("_below") + F.coalesce(F.sum("_in").over(before), F.lit(0))).drop("_part")
        split = split.select(*[F.col(k).alias(f"_old{k}") for k in keys], "_below", "_in", "_lo", "_hi")
        same = [F.col(k).eqNullSafe(F.col(f"_old{k}")) for k in keys]
        inside = (F.col("_rank") >= F.col("_below")) & (F.col("_rank") < F.col("_below") + F.col("_in"))
        wanted = materialise(wanted.drop("_below", "_in", "_to").join(split, [*same, inside]).select(
            *names, "_n", "_below", "_in", F.col("_lo").alias("_from"), F.col("_hi").alias("_to"), "_i", "_pos", "_rank"), "ranks")


def month_quantiles(df: DataFrame, specs: dict[str, tuple[float, float]], *, series: Sequence[str], ts: str = "ts",
                    min_rows: int = 100) -> DataFrame:
    """Low and high cut-off per series and calendar month, null for months with few rows.

    A (series, month) group has at most 2976 quarter hours per year of history,
    so the exact aggregate stays small.
    """
    aggs: list[Column] = [F.count("*").alias("_rows")]
    for c, (lo, hi) in specs.items():
        aggs.append(F.percentile(col(c), F.array(F.lit(lo), F.lit(hi))).alias(f"_cut_{c}"))
    cuts = df.groupBy(*[col(s) for s in series], F.month(col(ts)).alias("_month")).agg(*aggs)
    enough = F.col("_rows") > min_rows
    return cuts.select(
        *series, "_month",
        *[F.when(enough, col(f"_cut_{c}")[i]).alias(f"_{side}_{c}") for c in specs for i, side in enumerate(("lo", "hi"))],
    )


def side_of(x: Column, lo: Column, hi: Column) -> Column:
    """1 above the upper cut-off, -1 below the lower one, else 0."""
    return F.when(x > hi, 1.0).when(x < lo, -1.0).otherwise(0.0)


def quantile_flag(df: DataFrame, specs: dict[str, tuple[float, float]], *, series: Sequence[str], ts: str = "ts",
                  min_rows: int = 100, prefix: str = "extreme_") -> DataFrame:
    cuts = month_quantiles(df, specs, series=series, ts=ts, min_rows=min_rows)
    joined = df.withColumn("_month", F.month(col(ts))).join(cuts, [*series, "_month"], "left")
    flagged = joined.withColumns({f"{prefix}{c}": side_of(col(c), col(f"_lo_{c}"), col(f"_hi_{c}")) for c in specs})
    return flagged.select(*[col(c) for c in df.columns], *[col(f"{prefix}{c}") for c in specs])
