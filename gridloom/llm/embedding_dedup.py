"""Near-duplicate vectors by product quantisation, with nothing lost on the way.

Unit vectors x and y have cosine >= c exactly when |x - y| <= d = sqrt(2 - 2c).

- Coarse lists: each vector is held by the list of its nearest centroid.
- Probes: if x is nearest to a and y to b, then x lies within d of the plane
  between a and b. x probes every list b for which (|x-b|^2 - |x-a|^2) / (2|a-b|)
  <= d: no list with a neighbour is left out.
- Codes: what a vector has beyond its centroid is coded by the nearest codeword
  of each subspace; the length e of what the code misses is kept. The distance
  of x to the coded y, summed from a table of x's distances to all codewords,
  is at most |x - y| + e, so only y with table distance <= d + e go on.
- Those are compared by exact cosine in double precision.

Lists are cut into blocks of bounded size, and a task compares one block of
holders with one block of probers. It returns link counts and a forest of its
links, not pairs, so a cluster in which all vectors link costs no more rows than
it has vectors. Equal vectors of a label are one holder with a count.

The index is fitted on a bounded sample; every vector is indexed and searched.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import map_batches
from gridloom.llm.components import connected_components, forest
from gridloom.session import materialise

_SLACK = 1e-9


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest center, and all squared distances."""
    d = np.maximum((x ** 2).sum(1)[:, None] - 2 * x @ centers.T + (centers ** 2).sum(1)[None, :], 0)
    return d.argmin(1), d


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own, _ = _nearest(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centers))
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
    return centers


@dataclass
class Index:
    """Coarse centroids and the codebooks of the subspaces, for vectors of one length."""
    centers: np.ndarray
    parts: list[slice]
    books: list[np.ndarray]

    @staticmethod
    def fit(sample: np.ndarray, lists: int, subspaces: int, codewords: int, seed: int) -> Index:
        rng = np.random.default_rng(seed)
        centers = _k_means(sample, lists, rng)
        rest = sample - centers[_nearest(sample, centers)[0]]
        cuts = np.linspace(0, sample.shape[1], min(subspaces, sample.shape[1]) + 1).astype(int)
        parts = [slice(int(a), int(b)) for a, b in zip(cuts, cuts[1:])]
        return Index(centers, parts, [_k_means(rest[:, p], codewords, rng) for p in parts])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, code and missed length of each vector, and its squared distances to all centroids."""
        own, d = _nearest(x, self.centers)
        rest = x - self.centers[own]
        code = np.stack([_nearest(rest[:, p], b)[0] for p, b in zip(self.parts, self.books)], 1).astype(np.uint8)
        coded = np.concatenate([b[code[:, i]] for i, b in enumerate(self.books)], 1)
        return own, code, np.sqrt(((rest - coded) ** 2).sum(1)), d

    def probes(self, own: np.ndarray, d: np.ndarray, reach: float) -> np.ndarray:
        """Whether each vector has to look into each list."""
        apart = np.sqrt(np.maximum(((self.centers[own][:, None, :] - self.centers[None, :, :]) ** 2).sum(2), 0))
        beyond = d - d[np.arange(len(own)), own][:, None]
        return beyond <= 2 * apart * (reach + _SLACK) + _SLACK

    def tables(self, x: np.ndarray, at: int) -> list[np.ndarray]:
        """Squared distances of what x has beyond centroid `at` to every codeword."""
        rest = x - self.centers[at]
        return [_nearest(rest[:, p], b)[1] for p, b in zip(self.parts, self.books)]


def _units(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1, in double precision."""
    x = x / np.abs(x).max(1)[:, None]  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1)[:, None]


def _links(held: pd.DataFrame, index: Index, at: int, cosine: float, reach: float, kind: str) -> pd.DataFrame:
    """Counts (a, null, n) and links (a, b, null) between the probers and holders of one block."""
    holders, probers = held[held["holds"]], held[~held["holds"]]
    counts, links = [], []
    if len(holders) and len(probers):
        y, x = (_units(np.frombuffer(b"".join(side["raw"]), kind).reshape(len(side), -1).astype(np.float64)) for side in (holders, probers))
        code = np.frombuffer(b"".join(holders["code"]), np.uint8).reshape(len(holders), -1)
        bound = reach + holders["missed"].to_numpy() + 1e-6
        y_id, weight = holders["rep"].to_numpy(), holders["n"].to_numpy()
        x_id = probers["rep"].to_numpy()
        for start in range(0, len(x), 128):
            q = x[start:start + 128]
            near = np.zeros((len(q), len(y)))
            for i, table in enumerate(index.tables(q, at)):
                near += table[:, code[:, i]]
            near = near <= bound[None, :] ** 2
            some = near.any(0)
            if not some.any():
                continue
            hit = near[:, some] & (q @ y[some].T >= cosine)
            hit &= x_id[start:start + 128, None] != y_id[some][None, :]
            rows, cols = np.nonzero(hit)
            counts += [(int(a), int(n)) for a, n in zip(x_id[start:start + 128], hit @ weight[some]) if n]
            links += [(a, b) for a, b in forest(zip(x_id[start + rows].tolist(), y_id[some][cols].tolist())).items() if a != b]
    out = [(a, None, n) for a, n in counts] + [(a, b, None) for a, b in links]
    return pd.DataFrame({"a": pd.array([r[0] for r in out], "Int64"), "b": pd.array([r[1] for r in out], "Int64"), "n": pd.array([r[2] for r in out], "Int64")})


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.93,
                 sample_rows: int = 16_384, subspaces: int = 8, codewords: int = 64, block: int = 1024, seed: int = 5) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of `vectors`.

    Rows link when their labels are equal and not null, their vectors have the
    same length and a cosine of at least `cosine`. Vectors that are null, empty,
    zero or hold a null, NaN or infinity link with nothing. `n_links` counts the
    other rows linked directly (a repeated row is another row), `component_id`
    is the smallest id reachable, its own included; `kept` says it is its own.
    A row with a null id has no links, a null component and is kept. Other
    columns are not looked at; an empty table gives an empty table.
    `sample_rows` vectors of each length fit the index; it has so many lists that
    one holds about a block of an average label's vectors, 1024 at most.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    # blocks carry vectors as they came; all arithmetic is in double precision
    kind = "<f4" if vectors.schema[vec_col].dataType.elementType.typeName() == "float" else "<f8"
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("vec", lambda v: v != 0)
    rows = materialise(rows.withColumn("usable", F.coalesce(usable, F.lit(False))), "vectors")
    reps = materialise(rows.where("usable").groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
                       .withColumn("dim", F.size("vec")), "distinct-vectors")
    sizes = {r["dim"]: r["count"] for r in reps.groupBy("dim").count().collect()}  # one row for each vector length
    reach = math.sqrt(2 - 2 * cosine)
    parts = [_search(spark, reps.where(F.col("dim") == dim), n, cosine, reach, sample_rows, subspaces, codewords, block, seed, kind) for dim, n in sorted(sizes.items())]
    if not parts:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = materialise(found, "vector-links")
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    roots = connected_components(found.where("b is not null"), "a", "b").withColumnRenamed("node", "rep")
    classes = reps.join(counts, "rep", "left").join(roots, "rep", "left").select(
        "label", "vec", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"), F.lit(True).alias("usable"))
    classes = materialise(classes, "vector-classes")
    return rows.join(classes, ["label", "vec", "usable"], "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"),
        F.col("id").eqNullSafe(F.coalesce("component_id", "id")).alias("kept"))


def _search(spark, reps: DataFrame, count: int, cosine: float, reach: float, sample_rows: int, subspaces: int, codewords: int, block: int, seed: int, kind: str) -> DataFrame:
    chosen = reps.select("rep", "vec").orderBy(F.xxhash64("rep"), "rep").limit(sample_rows).collect()
    labels = max(1, reps.agg(F.approx_count_distinct("label")).first()[0])
    lists = min(1024, max(1, round(count / labels / block)))
    index = spark.sparkContext.broadcast(Index.fit(_units(np.array([r["vec"] for r in chosen])), lists, subspaces, codewords, seed))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_index = index.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                raw = np.array(part.column(2).to_pylist())
                x = _units(raw)
                own, code, missed, d = own_index.encode(x)
                probed = [np.flatnonzero(p).tolist() for p in own_index.probes(own, d, reach)]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), part.column(3), pa.array([v.astype(kind).tobytes() for v in raw], pa.binary()), pa.array(own.astype(np.int32)),
                    pa.array([c.tobytes() for c in code], pa.binary()), pa.array(missed), pa.array(probed, pa.list_(pa.int32()))],
                    ["rep", "label", "n", "raw", "list", "code", "missed", "probed"])

    label_type = reps.schema["label"].dataType.simpleString()
    coded = materialise(map_batches(
        reps.select("rep", "label", "vec", "n"), encode, f"rep long, label {label_type}, n long, raw binary, list int, code binary, missed double, probed array<int>"), "codes")
    # blocks of each list: of those it holds, and of those that probe it
    held = coded.groupBy("label", "list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("h"))
    asked = coded.select("label", F.explode("probed").alias("list")).groupBy("label", "list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("p"))
    blocks = materialise(held.join(asked, ["label", "list"]), "blocks")
    spread = F.xxhash64("rep")
    holders = coded.join(blocks, ["label", "list"]).select(
        "label", "list", F.pmod(spread, F.col("h")).alias("hb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("p").cast("long") - 1)).alias("pb"),
        F.lit(True).alias("holds"), "rep", "n", "raw", "code", "missed")
    probers = coded.select("label", "rep", "raw", F.explode("probed").alias("list")).join(blocks, ["label", "list"]).select(
        "label", "list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("h").cast("long") - 1)).alias("hb"), F.pmod(spread, F.col("p")).alias("pb"),
        F.lit(False).alias("holds"), "rep", F.lit(None).cast("long").alias("n"), "raw", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("missed"))

    def compare(held: pd.DataFrame) -> pd.DataFrame:
        return _links(held, index.value, int(held["list"].iloc[0]), cosine, reach, kind)

    return holders.unionByName(probers).groupBy("label", "list", "hb", "pb").applyInPandas(compare, "a long, b long, n long")
