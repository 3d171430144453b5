"""Connected components of an edge table, in rounds of joins and grouped minima.

Each round runs a large-star and a small-star step over edges that point from
a larger to a smaller node; the rounds needed grow with the logarithm of the
longest chain. Before the first round every task merges the edges it holds, so
that the graph is already a forest per task. All state is written to the shared
folder; neither links nor labels reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import map_batches
from gridloom.session import materialise


def forest(pairs: Iterable[tuple[int, int]]) -> dict[int, int]:
    """Root (smallest node) of every node that the pairs touch."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while up[top] != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for a, b in pairs:
        up.setdefault(a, a)
        up.setdefault(b, b)
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def _merge_held(batches: Iterable[pa.RecordBatch], at_once: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Edges of one task, merged a bounded block at a time."""
    held: list[tuple[int, int]] = []

    def out() -> pa.RecordBatch:
        links = [(x, r) for x, r in forest(held).items() if x != r]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([r for _, r in links], pa.int64())], ["a", "b"])

    for batch in batches:
        held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        if len(held) >= at_once:
            yield out()
            held = []
    if held:
        yield out()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has an edge.

    Null ends and self-loops are left out, repeated edges are harmless; an empty
    table gives an empty table. Nodes are integers.
    """
    e = edges.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b"))
    e = map_batches(e.where(F.col("a") != F.col("b")), _merge_held, "a long, b long")
    e = materialise(e.distinct(), "edges")
    while True:
        up = e.groupBy("a").agg(F.min("b").alias("p"), F.count(F.lit(1)).alias("n"))
        stars = e.join(up.select(F.col("a").alias("b")), "b", "left_semi").isEmpty() and up.where("n > 1").isEmpty()
        if stars:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        # large star: larger neighbours of b move to the smallest neighbour of b
        parent = up.select(F.col("a").alias("b"), "p")
        e = materialise(e.join(parent, "b", "left").select("a", F.coalesce("p", "b").alias("b")).distinct(), "edges")
        # small star: the smaller neighbours of a, and a itself, move to the smallest of them
        up = e.groupBy("a").agg(F.min("b").alias("p"))
        moved = e.join(up, "a").where(F.col("b") > F.col("p")).select(F.col("b").alias("a"), F.col("p").alias("b"))
        e = materialise(up.select("a", F.col("p").alias("b")).unionByName(moved).distinct(), "edges")
