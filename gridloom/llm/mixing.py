"""Mixing sources to target weights by hierarchical budgeting.

A token budget runs down a tree (domain, language, source). At each node it is
split among the children by weight; a child that cannot use its share (its
tokens times the epochs allowed) is filled up, and what it leaves goes to its
siblings by weight. A shortage climbs to the parent's siblings only when the
whole subtree is full. All shares are whole tokens, rounded down.

A leaf with a budget of T tokens and A available gives T div A whole epochs and
a prefix of one more: its documents in the order of md5("seed:epoch:id"), as
long as the tokens before a document are fewer than the rest. The prefix is
found by running totals over hash ranges: 256 of a leaf, 256 of each of these
and so on until a range of the largest leaf has few rows. Rows of one place in
the order (the same or no id, the same tokens) are counted together, so neither
a leaf nor an id with a third of all rows ends in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import WORD
from gridloom.session import materialise

NONE = "(none)"


def _big(c: Column | str, digits: int) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(f"decimal({digits},0)")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _weight(name: Column, weights: dict[str, int] | None) -> Column:
    if not weights:
        return F.lit(1)
    pairs = [F.lit(x) for kv in sorted(weights.items()) for x in kv]
    return F.coalesce(F.create_map(*pairs)[name], F.lit(1))


def share(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Split `budget` of each parent among its children (`name`, `weight`, `cap`) by weight, never beyond `cap`; adds `alloc`.

    In the order of cap / weight the children that get filled come first: one is
    full if its cap is at most its share of what those before it have left.
    """
    # partitioned by nodes of the tree, one row per child: never by documents
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), name)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    w_rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    full = _big("cap", 19) * _big(w_rest, 18) <= _big("weight", 18) * _big(F.col("budget") - before, 19)
    whole = Window.partitionBy(*parent)
    out = children.withColumn("full", full)
    out = out.withColumn("left_over", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0)))
    out = out.withColumn("w_open", F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole))
    part = F.expr("cast(left_over as decimal(19,0)) * cast(weight as decimal(18,0)) div cast(w_open as decimal(18,0))")
    return out.withColumn("alloc", F.when(F.col("full"), F.col("cap")).otherwise(part).cast("long")).drop("full", "left_over", "w_open")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], total: int, max_epochs: int) -> DataFrame:
    """Budget of each leaf; `leaves` has the level columns and `avail` tokens."""
    caps = leaves.withColumn("cap", F.col("avail") * max_epochs)
    budgets = None
    for depth, level in enumerate(levels):
        path = levels[:depth + 1]
        nodes = caps.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(F.col(level), weights.get(level)).cast("long"))
        if budgets is None:
            sized = nodes.withColumn("budget", F.lit(total).cast("long")).withColumn("_top", F.lit(0))
            split = share(sized, ["_top"], level)
        else:
            split = share(nodes.join(budgets, levels[:depth]), levels[:depth], level)
        budgets = split.select(*path, F.col("alloc").alias("budget"))
    return leaves.join(budgets, levels)


def mix(docs: DataFrame, levels: list[str], id_col: str = "doc_id", tokens_col: str = "n_tokens", weights: dict[str, dict[str, int]] | None = None,
        budget: tuple[int, int] | int = (3, 5), max_epochs: int = 2, seed: int = 7) -> DataFrame:
    """(id, levels, tokens, copies) for every row: how often the mixture takes the document, 0 for never.

    `budget` is a number of tokens or a fraction (numerator, denominator) of all
    tokens; what exceeds all capacities is not used. Weights are whole numbers
    by level and name, 1 where none is given. A null level is a node named
    "(none)", null tokens count as 0, a null id has one place in the order.
    Documents without tokens come with the prefix they fall into. Repeated rows
    are documents of their own. An empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), *[F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c) for c in levels],
                       F.coalesce(F.col(tokens_col), F.lit(0)).cast("long").alias("tokens"))
    rows = materialise(rows, "mix-rows")
    leaves = materialise(rows.groupBy(*levels).agg(F.sum("tokens").alias("avail"), F.count(F.lit(1)).alias("n")), "mix-leaves")
    if isinstance(budget, tuple):
        everything = leaves.agg(F.sum("avail")).first()[0] or 0
        budget = everything * budget[0] // budget[1]
    plan = leaf_budgets(leaves, levels, weights or {}, int(budget), max_epochs).select(
        *levels, F.expr("if(avail > 0, budget div avail, 0)").alias("epochs"), F.expr("if(avail > 0, budget % avail, 0)").alias("rest"))
    plan = materialise(plan, "mix-plan")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("epochs").cast("string"), F.lit(":"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    rows_at_most = leaves.agg(F.max("n")).first()[0] or 0
    keyed = rows.join(plan, levels).withColumn("key", key).groupBy(*levels, "epochs", "rest", "key", "id", "tokens").agg(F.count(F.lit(1)).alias("n"))
    keyed = materialise(keyed, "mix-keyed")
    inside = Window.partitionBy(*levels, "range").orderBy("key", "id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    starts, digits = _range_starts(keyed, levels, rows_at_most)
    placed = keyed.withColumn("range", F.substring("key", 1, digits)).join(starts, [*levels, "range"])
    ahead = F.col("rest") - F.col("ahead") - F.coalesce(F.sum(F.col("tokens") * F.col("n")).over(inside), F.lit(0))
    # of n alike rows those are taken before which fewer tokens lie than the rest
    taken = F.when(ahead <= 0, 0).when(F.col("tokens") == 0, F.col("n")).otherwise(F.least("n", F.expr("(room + tokens - 1) div tokens")))
    counted = placed.withColumn("room", ahead).withColumn("taken", taken)
    return _each_row(counted).select(F.col("id").alias(id_col), *levels, F.col("tokens").alias(tokens_col), "copies")


#: Hex digits that a round of ranges adds, and the rows a last range may have on average.
_DIGITS, _RANGE_ROWS = 2, 256


def _range_starts(keyed: DataFrame, levels: list[str], rows_at_most: int) -> tuple[DataFrame, int]:
    """(levels, range, ahead): the tokens of a leaf before each range, and the digits of a range.

    No window has more than 256 rows: a round's ranges are summed up within the range of the round before.
    """
    digits = _DIGITS
    while rows_at_most > _RANGE_ROWS * 16 ** digits and digits < 30:
        digits += _DIGITS
    sums = materialise(keyed.groupBy(*levels, F.substring("key", 1, digits).alias("range")).agg(F.sum(F.col("tokens") * F.col("n")).alias("held")), "mix-sums")
    starts = None
    for length in range(_DIGITS, digits + 1, _DIGITS):
        held = sums.groupBy(*levels, F.substring("range", 1, length).alias("range")).agg(F.sum("held").alias("held"))
        held = held.withColumn("upper", F.substring("range", 1, length - _DIGITS))
        over = Window.partitionBy(*levels, "upper").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        own = held.select(*levels, "upper", "range", F.coalesce(F.sum("held").over(over), F.lit(0)).alias("ahead"))
        if starts is not None:
            above = starts.select(*levels, F.col("range").alias("upper"), F.col("ahead").alias("above"))
            own = own.join(above, [*levels, "upper"]).withColumn("ahead", F.col("ahead") + F.col("above"))
        starts = materialise(own.select(*levels, "range", "ahead"), "mix-starts")
    return starts, digits


def _each_row(counted: DataFrame) -> DataFrame:
    """Rows counted together one by one again, in blocks, so that no row holds all of them."""
    block = 4096
    kinds = F.array(F.struct((F.col("epochs") + 1).alias("copies"), F.col("taken").cast("long").alias("n")),
                    F.struct(F.col("epochs").alias("copies"), (F.col("n") - F.col("taken")).cast("long").alias("n")))
    split = counted.withColumn("kind", F.explode(F.filter(kinds, lambda k: k["n"] > 0)))
    split = split.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("kind.n") - 1, F.lit(block).cast("long"))))
    rows = F.least(F.lit(block).cast("long"), F.col("kind.n") - F.col("at"))
    return split.withColumn("copies", F.col("kind.copies").cast("long")).withColumn("_", F.explode(F.array_repeat(F.lit(0), rows.cast("int"))))
