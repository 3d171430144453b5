"""Hashed terms of a text, the choice of telling ones, and bounded training samples.

Terms are hashed to 2^18 buckets. Of these a fit keeps the buckets whose presence
is significantly correlated with the rating, so a model is a short table whatever
the corpus, and a long text does not add up thousands of meaningless weights. A
model of pairs also takes buckets that tell nothing alone but something next to
another one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import WordTable, as_bytes, each_bytes, map_batches, map_texts
from gridloom.session import materialise

BITS = 18
Terms = Callable[[bytes], list[bytes]]
Whole = Callable[[list[bytes]], list[bytes]]
_EDGE = b".,;:!?\"'()[]{}<>|*#$%&+=-_/\\~^`@"


def word_terms(word: bytes) -> list[bytes]:
    """The word in lower case without punctuation at its ends, and its beginnings of three to six letters."""
    w = word.lower().strip(_EDGE)
    if not w:
        return []
    text = w.decode("utf-8", "replace")
    return [b"w" + w] + [b"p" + text[:k].encode() for k in range(3, 7) if len(text) >= k]


_SHAPES = bytes.maketrans(bytes(range(256)), bytes(
    88 if 65 <= c <= 90 else 120 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256)))


_RUNS = re.compile(rb"([Xx0])\1+")


def shape_terms(word: bytes) -> list[bytes]:
    """The word in lower case, and its shape: letters by case and digits as one sign for each run, other signs as they are."""
    return [b"w" + word.lower().strip(_EDGE), b"s" + _RUNS.sub(rb"\1", word.translate(_SHAPES))]


_STEPS = (0.0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7)
_SIGNS = re.compile(rb"[!-/:-@\[-`{-~]{2,}|\|")


def no_terms(words: list[bytes]) -> list[bytes]:
    return []


def share_terms(words: list[bytes]) -> list[bytes]:
    """How much of a text repeats the word before, is in capitals, ends in runs of signs, or is said for the first time: in steps."""
    n = len(words)
    if not n:
        return []
    shares = {
        b"again": sum(map(eq, words, islice(words, 1, None))) / n,
        b"capitals": sum(map(bytes.isupper, words)) / n,
        b"signs": sum(1 for _ in _SIGNS.finditer(b" ".join(words))) / n,
        b"new": len(set(words)) / n if n >= 20 else 1.0,
    }
    return [b"d%s%d" % (name, sum(share > x for x in _STEPS)) for name, share in shares.items()]


def buckets(terms: Iterable[bytes]) -> np.ndarray:
    return np.fromiter((zlib.crc32(t) & ((1 << BITS) - 1) for t in terms), np.uint32)


def sample(docs: DataFrame, ratings: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """(text, rating) of at most `rows` rated documents, taken in the order of a hash of their ids.

    `ratings` is (id, rating); null ids and ratings are left out, and of several
    ratings of a document the largest counts. Of rows that share an id the
    greatest text counts. The ids are broadcast: there are at most `rows` of them.
    """
    rated = ratings.toDF("_id", "rating").where("_id is not null and rating is not null").groupBy("_id").agg(F.max("rating").alias("rating"))
    chosen = rated.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    return texts.groupBy("_id").agg(F.max("text").alias("text"), F.max("rating").cast("int").alias("rating")).drop("_id")


@dataclass
class Examples:
    """Active buckets, sorted, and for each example its active terms (as places in `active`) and rating."""
    active: np.ndarray
    terms: list[np.ndarray]
    ratings: np.ndarray

    def passes(self, epochs: int, steps: int, size: int) -> int:
        """`epochs`, or as many as make `steps` batches where the sample is small."""
        return max(epochs, -(-steps // max(1, -(-len(self.terms) // size))))

    def batches(self, size: int, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        order = rng.permutation(len(self.terms))
        for at in range(0, len(order), size):
            chosen = order[at:at + size]
            x = np.zeros((len(chosen), len(self.active)), np.float32)
            for row, i in enumerate(chosen):
                x[row, self.terms[i]] = 1
            yield x, self.ratings[chosen]


def telling_pairs(held: list[np.ndarray], ratings: np.ndarray, size: int, least_chi2: float, least_docs: int = 5) -> np.ndarray:
    """Which of `size` terms belong to a pair whose joint presence says more about the rating than both terms apart.

    For each pair the mean ratings of the four kinds of documents (both, one,
    the other, neither) are compared: their interaction, squared, over its
    variance has to reach `least_chi2`, and each kind needs `least_docs` documents.
    """
    both, rated = np.zeros((size, size)), np.zeros((size, size))
    for at in range(0, len(held), 512):
        x = np.zeros((len(held[at:at + 512]), size), np.float32)
        for row, terms in enumerate(held[at:at + 512]):
            x[row, terms] = 1
        both += x.T @ x
        rated += x.T @ (x * ratings[at:at + 512, None].astype(np.float32))
    n, s = np.diag(both), np.diag(rated)
    counts = (both, n[:, None] - both, n[None] - both, len(held) - n[:, None] - n[None] + both)
    sums = (rated, s[:, None] - rated, s[None] - rated, ratings.sum() - s[:, None] - s[None] + rated)
    enough = np.minimum.reduce(counts) >= least_docs
    contrast, variance = np.zeros((size, size)), np.zeros((size, size))
    for sign, c, r in zip((1, -1, -1, 1), counts, sums):
        contrast += sign * r / np.maximum(c, 1)
        variance += ratings.var() / np.maximum(c, 1)
    return (enough & (contrast ** 2 >= least_chi2 * variance)).any(1)


def examples(chosen: DataFrame, terms: Terms, whole: Whole, most: int, least_chi2: float, pair_terms: int = 0, least_pair_chi2: float = 60.0) -> Examples:
    """Read a bounded sample: keep the `most` buckets whose presence correlates best with the rating, and at least with n r^2 >= `least_chi2`.

    With `pair_terms`, so many buckets which part the sample most evenly, and as
    many of those kept, are looked at in pairs (`telling_pairs`, at least
    `least_pair_chi2`); members of telling pairs are kept as well.
    """
    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = WordTable(lambda ws: (buckets(terms(w)).tobytes() for w in ws), 1 << 16)
        found = []
        for text in as_bytes(batch.column(0)):
            words = text.split()
            found.append(np.unique(np.append(np.frombuffer(table.lookup(set(words)), np.uint32), buckets(whole(words)))).tobytes())
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.binary())], ["rating", "buckets"])

    seen = materialise(map_texts(chosen, "rating int, buckets binary", hashed), "examples")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for rating, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = np.frombuffer(held, np.uint32)
                n[at] += 1
                s[at] += rating
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(s[at])], ["bucket", "n", "s"])

    total = seen.agg(F.count(F.lit(1)), F.sum("rating"), F.sum(F.col("rating") * F.col("rating"))).first()
    n, mean = total[0] or 0, (total[1] or 0) / max(1, total[0] or 0)
    spread = (total[2] or 0) / max(1, n) - mean * mean
    if not n or spread <= 0:
        return Examples(np.zeros(0, np.uint32), [np.zeros(0, np.int64)] * n, np.array([r[0] for r in seen.select("rating").collect()], np.int64))
    held = map_batches(seen, count, "bucket long, n long, s long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    p = F.col("n") / n
    chi2 = n * F.pow(F.col("s") / n - p * mean, 2) / (p * (1 - p) * spread)
    some = held.where(F.col("n") < n)
    best = [r[0] for r in some.withColumn("chi2", chi2).where(F.col("chi2") >= least_chi2).orderBy(F.desc("chi2"), "bucket").limit(most).select("bucket").collect()]
    if pair_terms:
        even = some.orderBy(F.desc(F.col("n") * (n - F.col("n"))), "bucket").limit(pair_terms).select("bucket").collect()
        tried = np.array(sorted({*best[:pair_terms], *(r[0] for r in even)}), np.uint32)
        told = telling_pairs(*_narrowed(seen, tried), len(tried), least_pair_chi2) if len(tried) else tried
        best += [b for b in tried[told].tolist() if b not in set(best)] if len(tried) else []
    active = np.array(sorted(best), np.uint32)
    return Examples(active, *_narrowed(seen, active))


def _narrowed(seen: DataFrame, active: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The places in `active` of each example's buckets, and the ratings; in an order of their own, so that a fit does not depend on how the rows arrived."""
    def narrow(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.flatnonzero(np.isin(active, np.frombuffer(b, np.uint32))).astype(np.uint16).tobytes() for b in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["rating", "terms"])

    rows = sorted(map_texts(seen, "rating int, terms binary", narrow).collect(), key=lambda r: (r[0], bytes(r[1])))
    return [np.frombuffer(r[1], np.uint16).astype(np.int64) for r in rows], np.array([r[0] for r in rows], np.int64)


def places(active: np.ndarray) -> Callable[[Iterable[bytes]], np.ndarray]:
    """Places in `active` of terms; most terms have none."""
    where = {int(b): i for i, b in enumerate(active)}
    return lambda terms: np.array([where[b] for b in buckets(terms).tolist() if b in where], np.uint16)


def score_texts(docs: DataFrame, text_col: str, active: np.ndarray, terms: Terms, whole: Whole, score: Callable[[np.ndarray], list[float]],
                names: list[str], keep_text: bool = False) -> DataFrame:
    """`docs` with the double columns `names` computed by `score` from a text's distinct active terms.

    The text comes first with `keep_text`, handed back as it came, and is left out else.
    A column of `docs` that is called like one of `names` is left out.
    """
    docs = docs.drop(*[n for n in names if n != text_col])
    rest = [c for c in docs.columns if c != text_col]
    ordered, skip = docs.select(text_col, *rest), 0 if keep_text else 1
    passed = ordered.columns[skip:]
    sent = docs.sparkSession.sparkContext.broadcast(active)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = places(sent.value)
        table = WordTable(lambda ws: (at(terms(w)).tobytes() for w in ws), 1 << 16)
        for batch in batches:
            found = []
            for text in each_bytes(batch.column(0)):
                words = text.split()
                found.append(score(np.unique(np.append(np.frombuffer(table.lookup(set(words)), np.uint16), at(whole(words))))))
            new = [pa.array([f[i] for f in found], pa.float64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[skip:], *new], [*passed, *names])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields[skip:]]
    return map_batches(ordered, run, ", ".join([*fields, *(f"`{n}` double" for n in names)]))


def adam(params: list[np.ndarray], rate: float = 0.02) -> Callable[[list[np.ndarray]], None]:
    """In-place updates of `params` from gradients."""
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0

    def step(grads: list[np.ndarray]) -> None:
        nonlocal t
        t += 1
        for p, g, a, b in zip(params, grads, m, v):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= rate * (a / (1 - 0.9 ** t)) / (np.sqrt(b / (1 - 0.999 ** t)) + 1e-8)

    return step
