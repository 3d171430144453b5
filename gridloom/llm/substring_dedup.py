"""Repeated passages by difference-cover anchors.

A difference cover modulo v is a set D of residues such that any two positions i
and j have some d < v with (i + d) mod v and (j + d) mod v both in D. If the
same `window` words stand at i and at j, both documents therefore hash the same
`window - v + 1` words at one aligned offset, although only |D| of v positions
are hashed at all. So:

1. anchors: hash the short runs at cover positions, and keep the hashes that
   occur in two different texts;
2. extend: only windows around such anchors can repeat. They alone are hashed
   (128 bits), grouped, and the smallest document of each group is found;
3. a word goes if it lies in a window whose smallest document is a smaller one.

No pairs are formed, so a passage that a third of all documents share costs as
many rows as it has places. Of documents with the same words the smallest takes
part; the others repeat all its windows.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import as_bytes, map_texts
from gridloom.session import materialise

_BASE = 0x9E3779B97F4A7C15
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


@lru_cache(maxsize=8)
def difference_cover(period: int) -> tuple[int, ...]:
    """A smallest set of residues, starting 0, 1, whose differences give every residue modulo `period`."""
    def grow(chosen: list[int], left: int) -> tuple[int, ...] | None:
        seen = {(a - b) % period for a in chosen for b in chosen}
        if len(seen) == period:
            return tuple(chosen)
        # each further residue adds two differences with every one before it
        if len(seen) + sum(2 * (len(chosen) + i) for i in range(left)) < period:
            return None
        for r in range(chosen[-1] + 1, period):
            if left and (found := grow([*chosen, r], left - 1)):
                return found
        return None

    for size in range(2, period + 1):
        if found := grow([0, 1], size - 2):
            return found
    return tuple(range(period))


@lru_cache(maxsize=8)
def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base^k and base^-k modulo 2^64 for k < n."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of `length` words, from 64-bit word hashes: sum of w[i + k] B^k modulo 2^64."""
    n = len(words)
    if n < length:
        return np.zeros(0, np.uint64)
    up, down = _powers(1 << max(10, (n - 1).bit_length()), _BASE)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up[:n], out=total[1:], dtype=np.uint64)
    return (total[length:] - total[:-length]) * down[:n - length + 1]


def word_hashes(words: list[bytes], seed: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(seed)), np.uint64, len(words))


def _anchors(docs: DataFrame, window: int, period: int) -> DataFrame:
    """(h, id, tag, pos) at every cover position of every document with a window; `tag` stands for the words of the document."""
    cover, length = np.array(difference_cover(period)), window - period + 1

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hs, ids, tags, at = [], [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            words = text.split()
            if len(words) < window:
                continue
            h = run_hashes(word_hashes(words, 0), length)
            pos = np.add.outer(np.arange(0, len(h), period), cover).ravel()
            pos = pos[pos < len(h)]
            hs.append(h[pos].view(np.int64))
            at.append(pos.astype(np.int32))
            ids.append(np.full(len(pos), doc, np.int64))
            tags.append(np.full(len(pos), xxhash.xxh64_intdigest(b" ".join(words)), np.uint64).view(np.int64))
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0, kind))
        return pa.RecordBatch.from_arrays([join(hs, np.int64), join(ids, np.int64), join(tags, np.int64), join(at, np.int32)], ["h", "id", "tag", "pos"])

    return map_texts(docs, "h long, id long, tag long, pos int", run)


def _summary(docs: DataFrame) -> DataFrame:
    """(id, n_words, sha) of every row: the SHA-256 is that of the words with one space between them."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, shas = [], []
        for text in as_bytes(batch.column(1)):
            words = text.split()
            sizes.append(len(words))
            shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(shas, pa.string())], ["id", "n_words", "sha"])
    return map_texts(docs, "id long, n_words long, sha string", run)


def _windows(held: DataFrame, window: int, period: int) -> DataFrame:
    """(w1, w2, id, tag, pos) of the windows that contain an anchor at one of `anchors`; rows whose text is not the one meant give none."""
    reach = period - 1

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], [], []]
        for doc, sha, text, anchors in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), batch.column(3).to_pylist()):
            words = text.split()
            n = len(words) - window + 1
            if n < 1 or hashlib.sha256(b" ".join(words)).hexdigest() != sha:
                continue
            a = np.asarray(anchors)
            near = np.zeros(n + 1, np.int32)
            np.add.at(near, np.clip(a - reach, 0, n), 1)
            np.add.at(near, np.clip(a + 1, 0, n), -1)
            pos = np.flatnonzero(np.cumsum(near[:-1]) > 0)
            for c, v in zip(cols, (run_hashes(word_hashes(words, 0), window)[pos].view(np.int64), run_hashes(word_hashes(words, 1), window)[pos].view(np.int64),
                                   np.full(len(pos), doc, np.int64), np.full(len(pos), zlib.crc32(sha.encode()), np.int64), pos.astype(np.int32))):
                c.append(v)
        kinds = (np.int64, np.int64, np.int64, np.int64, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, k)) for c, k in zip(cols, kinds)], ["w1", "w2", "id", "tag", "pos"])

    return map_texts(held, "w1 long, w2 long, id long, tag long, pos int", run)


def _cut(held: DataFrame, window: int) -> DataFrame:
    """(id, sha, removed, n_removed, kept_sha256): the spans of words that windows at `gone` cover, ends excluded."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, sha, text, gone in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), batch.column(3).to_pylist()):
            words = text.split()
            if hashlib.sha256(b" ".join(words)).hexdigest() != sha:
                continue
            spans: list[list[int]] = []
            for p in sorted(gone):
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + window
                else:
                    spans.append([p, p + window])
            kept, last = [], 0
            for start, end in spans:
                kept += words[last:start]
                last = end
            kept += words[last:]
            rows.append((doc, sha, [{"start": s, "end": e} for s, e in spans], len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        kinds = (pa.int64(), pa.string(), span, pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["id", "sha", "removed", "n_removed", "kept_sha256"])

    return map_texts(held, "id long, sha string, removed array<struct<start:int,end:int>>, n_removed long, kept_sha256 string", run)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, period: int = 31) -> DataFrame:
    """(id, n_words, removed, n_removed, kept_sha256) for every row of `docs`.

    `removed` are the spans [start, end) of words covered by a window of
    `window` words that also starts in a document with a smaller id. Null text
    has no words. A row with a null id is neither cut nor a source. Rows with
    the same id are never sources for each other; repeated rows come out alike.
    Other columns are not looked at; an empty table gives an empty table.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = texts.where("id is not null")
    rows = materialise(_summary(texts), "word-rows")
    first = materialise(rows.where("id is not null").groupBy("sha").agg(F.min("id").alias("first_id")), "first-of-text")

    anchors = _anchors(known, window, period)
    shared = anchors.groupBy("h").agg(F.min("tag").alias("t0"), F.max("tag").alias("t1")).where("t0 <> t1").select("h")
    shared = materialise(shared, "shared-anchors")
    near = anchors.select("h", "id", "pos").join(shared, "h", "left_semi").groupBy("id").agg(F.collect_set("pos").alias("anchors"))
    near = near.join(first.withColumnRenamed("first_id", "id"), "id")
    held = materialise(known.join(near, "id").select("id", "sha", "text", "anchors"), "anchored-texts")

    windows = _windows(held, window, period)
    repeats = windows.groupBy("w1", "w2").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("first_id < last_id")
    repeats = materialise(repeats.select("w1", "w2", "first_id"), "repeated-windows")
    gone = windows.join(repeats, ["w1", "w2"]).where("id > first_id").groupBy("id", "tag").agg(F.collect_set("pos").alias("gone"))
    edits = held.withColumn("tag", F.crc32(F.col("sha").cast("binary"))).join(gone, ["id", "tag"]).select("id", "sha", "text", "gone")
    edits = materialise(_cut(edits, window).distinct(), "edits")

    out = rows.join(first, "sha", "left").join(edits, ["id", "sha"], "left")
    copy = (F.col("id") > F.col("first_id")) & (F.col("n_words") >= window)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return out.select(
        F.col("id").alias(id_col), "n_words",
        F.when(copy, whole).otherwise(F.coalesce("removed", none)).alias("removed"),
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(_EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))
