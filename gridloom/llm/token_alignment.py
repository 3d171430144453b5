"""Alignment of two tokenizers' tokens over the same bytes, with corpus-wide counts of linked id pairs.

First pass: texts are tokenized both ways and aligned by byte offsets, a block
of documents at a time; the ids are written, and for each block its distinct
linked pairs with the number of its documents that hold them. The pairs of the corpus are
dealt into shards by their first id, each shard with a minimal perfect hash of its
pairs. Blocks add up into dense vectors of counts, indexed by that hash, which
are summed in a tree of bounded fan-in. Second pass: every block asks the shards
for the counts of its pairs (the keys at the hashed places are compared with
those asked for), aligns its documents again and adds up per document.

What a task holds is bounded by a block, a shard, or `fan_in` blocks' pairs of a
shard, whatever the corpus; the shards' number grows with the distinct pairs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import byte_bpe
from gridloom.llm.common import WordTable, map_batches, small_batches
from gridloom.llm.perfect_hash import PerfectHash
from gridloom.session import materialise, ship

_SPACE = "▁"  # a blank in the pieces' vocabulary


class Side:
    """One tokenizer: ids of " " + text (little-endian 32-bit), or None if their bytes joined are other ones; and the bytes each id stands for."""

    def __init__(self, ids: Callable[[str], bytes | None], token: list[bytes]):
        self.ids, self.token = ids, token
        self.sizes = np.asarray([len(t) for t in token], np.int64)


@lru_cache(maxsize=1)
def byte_level(path: str, table_words: int) -> Side:
    """A byte-level vocabulary in a tokenizer's JSON; matches of the byte-level pattern are looked up one by one, their tokens cut from their own bytes."""
    held = byte_bpe.vocabulary(path).token
    known, split = byte_bpe.match_ids(path, table_words), regex.compile(public_tokenizers.PATTERN).findall
    return Side(lambda text: known.lookup(split(" " + text)), [held.get(i, b"") for i in range(max(held) + 1)])


@lru_cache(maxsize=1)
def pieces(path: str, table_words: int) -> Side:
    """A model of pieces that puts a blank before the text.

    If no piece has a blank after another character, the text falls into
    stretches of blanks and what follows them, each looked up by itself.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    token = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(names)]
    sizes, alone = np.asarray([len(t) for t in token], np.int64), model.piece_to_id(_SPACE)
    apart = not any(_SPACE in p.lstrip(_SPACE) for p in names)
    stretches = re.compile(" +[^ ]*").findall

    def spelled(ids: np.ndarray) -> bytes:
        return b"".join(map(token.__getitem__, ids.tolist()))

    def whole(text: str) -> bytes | None:
        ids = np.asarray(model.encode(text, num_threads=1), "<u4")
        return ids.tobytes() if spelled(ids) == b" " + text.encode() else None

    def encode(words: list[str]) -> list[bytes]:
        """Stretches without their first blank, which the model puts back, in one call: parted where each ends."""
        joined = [w for w in words if w and w[-1] != " "]  # blanks alone would join the next stretch
        together = " ".join(joined)
        ids = np.asarray(model.encode(together, num_threads=1) if joined else [], "<u4")
        if joined and spelled(ids) != b" " + together.encode():
            raise ValueError("pieces change the text")
        ends = np.cumsum([len(w.encode()) + 1 for w in joined])
        until = np.searchsorted(np.cumsum(sizes[ids]), ends, "right") * 4
        data, start, out = ids.tobytes(), 0, {}
        for w, end in zip(joined, until.tolist()):
            out[w], start = data[start:end], end
        return [out[w] if w in out else np.asarray(model.encode(w) if w else [alone], "<u4").tobytes() for w in words]

    known = WordTable(encode, table_words)

    def ids(text: str) -> bytes | None:
        if not apart or _SPACE in text:
            return whole(text)
        words = [w[1:] for w in stretches(" " + text)] if "  " in text or text[:1] == " " else text.split(" ")
        try:
            return known.lookup(words)
        except ValueError:
            return whole(text)

    return Side(ids, token)


class Aligned:
    """Links and groups of documents whose tokens on both sides cover the same bytes, one after the other."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], a_sizes: np.ndarray, b_sizes: np.ndarray):
        self.a, self.b = _joined(a), _joined(b)
        self.a_end, self.b_end = np.cumsum(a_sizes[self.a]), np.cumsum(b_sizes[self.b])
        ends = np.sort(np.concatenate([self.a_end, self.b_end]), kind="stable")
        last = np.append(ends[1:] != ends[:-1], True)[:len(ends)]
        #: every stretch between two neighbouring ends lies in one token of each side: one link
        cuts = ends[last]
        self.key = (self.a[np.searchsorted(self.a_end, cuts)] << 32) | self.b[np.searchsorted(self.b_end, cuts)]
        self.common = ends[:-1][ends[1:] == ends[:-1]]  # ends of both sides: groups
        a_until, b_until = np.cumsum([0, *map(len, a)]), np.cumsum([0, *map(len, b)])
        self.a_until, self.b_until = a_until, b_until
        doc_ends = np.concatenate([[0], self.a_end])[a_until]
        self.links = np.searchsorted(cuts, doc_ends, "right")
        self.groups = np.searchsorted(self.common, doc_ends, "right")

    def keys_of(self, doc: int) -> np.ndarray:
        return self.key[self.links[doc]:self.links[doc + 1]]

    def written(self, a_text: np.ndarray, b_text: np.ndarray) -> np.ndarray:
        """Tokens as strings in the order of groups, each with the sign that follows it: `,` within a side, `|` and `;` after it."""
        a_group, b_group = np.searchsorted(self.common, self.a_end), np.searchsorted(self.common, self.b_end)
        a_before = np.concatenate([[0], np.searchsorted(self.a_end, self.common, "right")])
        b_before = np.concatenate([[0], np.searchsorted(self.b_end, self.common, "right")])
        out = np.empty(len(self.a) + len(self.b), object)
        out[np.arange(len(self.a)) + b_before[a_group]] = a_text[(self.a_end == self.common[a_group]).astype(np.int8), self.a]
        out[np.arange(len(self.b)) + a_before[b_group + 1]] = b_text[(self.b_end == self.common[b_group]).astype(np.int8), self.b]
        return out


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([*parts, np.empty(0, np.int64)]).astype(np.int64)


def _texts(n: int, within: str, last: str) -> np.ndarray:
    return np.array([[f"{i}{sign}" for i in range(n)] for sign in (within, last)], object)


def _number_kind(side: Side) -> str:
    return "<u2" if len(side.token) <= 1 << 16 else "<u4"


def _packed(ids: np.ndarray, kind: str) -> bytes:
    """Ids are written once and shuffled once: compressed they are about as large as the text, 1.6 times that otherwise."""
    return zstandard.compress(ids.astype(kind).tobytes(), 1)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


_BLOCK = "block long, id {}, a binary, b binary, pairs array<bigint>, docs array<bigint>"


def _cut(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of about `size` bytes of text, at least a row each."""
    start = held = 0
    for i, n in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
        held += n or 0
        if held >= size:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def _blocks(docs: DataFrame, a_path: str, b_path: str, table_words: int, block_bytes: int) -> DataFrame:
    """First pass: a row of ids for each document, and after them one row of distinct pairs for their block."""
    small_batches(docs.sparkSession)
    kind = docs.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = byte_level(a_path, table_words), pieces(b_path, table_words)
        a_kind, b_kind = _number_kind(left), _number_kind(right)
        first = TaskContext.get().partitionId() << 32
        for block, batch in enumerate((part for batch in batches for part in _cut(batch, block_bytes)), first):
            a, b = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                ids = [side.ids(text) if text else b"" for side in (left, right)]
                fit = None not in ids
                a.append(np.frombuffer(ids[0] if fit else b"", "<u4"))
                b.append(np.frombuffer(ids[1] if fit else b"", "<u4"))
            aligned = Aligned(a, b, left.sizes, right.sizes)
            pairs, n_docs = np.unique(_joined([np.unique(aligned.keys_of(d)) for d in range(len(a))]), return_counts=True)
            n = len(a)
            yield pa.RecordBatch.from_arrays([
                pa.array([block] * (n + 1), pa.int64()), pa.concat_arrays([batch.column(0), pa.nulls(1, batch.column(0).type)]),
                pa.array([*(_packed(i, a_kind) for i in a), None], pa.binary()), pa.array([*(_packed(i, b_kind) for i in b), None], pa.binary()),
                pa.array([*[None] * n, pairs], pa.list_(pa.int64())), pa.array([*[None] * n, n_docs], pa.list_(pa.int64()))],
                ["block", "id", "a", "b", "pairs", "docs"])

    return map_batches(docs, run, _BLOCK.format(kind.simpleString()))


def _numbers(column) -> list[np.ndarray]:
    return [np.frombuffer(v.as_py(), "<i8") for v in column]


def _hash_shard(table: pa.Table) -> pa.Table:
    """The hash of a shard's pairs and the pairs in its order."""
    keys = table.column("pair").to_numpy()
    hashed = PerfectHash.build(keys)
    ordered = np.empty(len(keys), "<i8")
    ordered[hashed.number(keys)] = keys
    return pa.table({"shard": table.column("shard")[:1], "hash": pa.array([hashed.to_bytes()], pa.binary()), "keys": pa.array([ordered.tobytes()], pa.binary())})


def _parts(blocks: DataFrame, shards: int, slots: int) -> DataFrame:
    """Each block's pairs and counts by shard; the blocks are dealt into slots."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block, slot, pairs, docs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                pairs, docs = pairs.values.to_numpy(), docs.values.to_numpy()
                shard = (pairs >> 32) % shards
                order = np.argsort(shard, kind="stable")
                ends = np.searchsorted(shard[order], np.arange(shards + 1))
                for s in range(shards):
                    mine = order[ends[s]:ends[s + 1]]
                    if len(mine):
                        out.append((s, slot, block, pairs[mine].astype("<i8").tobytes(), docs[mine].astype("<i8").tobytes()))
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["shard", "slot", "block", "keys", "docs"])

    dealt = blocks.where("pairs IS NOT NULL").select("block", F.pmod(F.xxhash64("block"), F.lit(slots)).alias("slot"), "pairs", "docs")
    return map_batches(dealt, run, "shard long, slot long, block long, keys binary, docs binary")


def _add_up(key: tuple, parts: pa.Table, hashes: pa.Table) -> pa.Table:
    """The dense vector of counts of some blocks in one shard, indexed by the shard's hash."""
    hashed = PerfectHash.from_bytes(hashes.column("hash")[0].as_py())
    total = np.zeros(hashed.n, "<i8")
    for keys, docs in zip(_numbers(parts.column("keys")), _numbers(parts.column("docs"))):
        total[hashed.number(keys)] += docs  # a block's pairs are distinct
    return _vector(key[0].as_py(), key[1].as_py(), total) if parts.num_rows else _vector(0, 0, total).slice(0, 0)


def _vector(shard: int, slot: int, total: np.ndarray) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int64()), "slot": pa.array([slot], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})


def _sum(key: tuple, table: pa.Table) -> pa.Table:
    return _vector(key[0].as_py(), key[1].as_py(), np.sum(_numbers(table.column("counts")), axis=0).astype("<i8"))


def _answer(key: tuple, asked: pa.Table, shard: pa.Table) -> pa.Table:
    """Counts of the pairs asked for, and whether each is its first id's highest."""
    hashed = PerfectHash.from_bytes(shard.column("hash")[0].as_py())
    keys, counts = (np.frombuffer(shard.column(c)[0].as_py(), "<i8") for c in ("keys", "counts"))
    first = keys >> 32
    highest = np.zeros(int(first.max()) + 1, np.int64)
    np.maximum.at(highest, first, counts)
    best = counts == highest[first]
    out = []
    for want in _numbers(asked.column("keys")):
        at = hashed.number(want)
        if not np.array_equal(keys[at], want):
            raise ValueError("a pair that was not counted")
        out.append((counts[at] * 2 + best[at]).astype("<i8").tobytes())
    return pa.table({"block": asked.column("block"), "keys": asked.column("keys"), "found": pa.chunked_array([pa.array(out, pa.binary())])})


def _shards_of_blocks(blocks: DataFrame, shard_pairs: int, fan_in: int) -> tuple[DataFrame, DataFrame]:
    """(shard, hash, keys, counts) of all pairs, and every block's part of each shard."""
    spark = blocks.sparkSession
    ship(spark)
    n_blocks = blocks.where("pairs IS NOT NULL").count()
    pairs = materialise(blocks.where("pairs IS NOT NULL").select(F.explode("pairs").alias("pair")).distinct(), "pairs")
    shards = max(1, -(-pairs.count() // shard_pairs))
    shard = F.pmod(F.shiftright("pair", 32), F.lit(shards)).cast("long")
    hashes = materialise(pairs.select(shard.alias("shard"), "pair").groupBy("shard").applyInArrow(_hash_shard, "shard long, hash binary, keys binary"), "hashes")
    slots = max(1, -(-n_blocks // fan_in))
    parts = materialise(_parts(blocks, shards, slots), "parts")
    total = _per_slot(parts, hashes.select("shard", "hash"), slots, _add_up, "shard long, slot long, counts binary")
    while slots > 1:
        slots = -(-slots // fan_in)
        total = total.withColumn("slot", F.pmod("slot", F.lit(slots))).groupBy("shard", "slot").applyInArrow(_sum, "shard long, slot long, counts binary")
    return materialise(hashes.join(total.select("shard", "counts"), "shard"), "counts"), parts


def _per_slot(parts: DataFrame, shards: DataFrame, slots: int, fn, schema: str) -> DataFrame:
    """Bring a shard and the parts of some blocks together; a shard meets each slot of blocks in a group of its own."""
    met = shards.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
    return parts.groupBy("shard", "slot").cogroup(met.groupBy("shard", "slot")).applyInArrow(fn, schema)


def pair_counts(docs: DataFrame, byte_level_json: str, pieces_model: str, text_col: str = "text", table_words: int = 1 << 17, block_bytes: int = 1 << 21,
                shard_pairs: int = 1 << 17, fan_in: int = 64) -> DataFrame:
    """(a, b, n_docs): how many documents link each pair of ids."""
    blocks = materialise(_blocks(docs.select(F.lit(None).cast("long").alias("id"), F.col(text_col).alias("text")), byte_level_json, pieces_model, table_words, block_bytes), "tokens")
    counted, _ = _shards_of_blocks(blocks, shard_pairs, fan_in)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(_numbers(batch.column(0)), _numbers(batch.column(1))):
                yield pa.RecordBatch.from_arrays([pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), pa.array(counts)], ["a", "b", "n_docs"])

    return map_batches(counted.select("keys", "counts"), run, "a long, b long, n_docs long")


def align(docs: DataFrame, byte_level_json: str, pieces_model: str, id_col: str = "doc_id", text_col: str = "text", table_words: int = 1 << 17,
          block_bytes: int = 1 << 21, shard_pairs: int = 1 << 17, fan_in: int = 64, groups: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per document.

    A is the byte-level tokenizer, B the model of pieces, both of a blank and
    the text. Where both end a token, a group ends; tokens whose bytes overlap
    are linked. `count_sum` adds up, over the links, how many documents of the
    corpus link the same ids, `n_best` counts the links whose number is the
    highest of their A id. With `groups`, the groups come as text too
    (`a1,a2|b1;a3|b2,b3`).

    Null or empty texts, and texts whose joined tokens differ from a blank and
    the text, have no tokens: zeros and ''. Repeated rows each count as a
    document, a null id is passed on, other columns are not looked at, an empty
    table gives an empty table. `table_words`, `block_bytes`, `shard_pairs` and
    `fan_in` trade memory for time.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    work = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    blocks = materialise(_blocks(work, byte_level_json, pieces_model, table_words, block_bytes), "tokens")
    counted, parts = _shards_of_blocks(blocks, shard_pairs, fan_in)
    slots = max(1, -(-blocks.where("pairs IS NOT NULL").count() // fan_in))
    answers = _per_slot(parts.select("shard", "slot", "block", "keys"), counted, slots, _answer, "block long, keys binary, found binary")

    def summed(key: tuple, texts: pa.Table, told: pa.Table) -> pa.Table:
        left, right = byte_level(byte_level_json, table_words), pieces(pieces_model, table_words)
        a_text, b_text = _sign_texts(len(left.token), len(right.token))
        a = [_unpacked(v.as_py(), _number_kind(left)) for v in texts.column("a")]
        b = [_unpacked(v.as_py(), _number_kind(right)) for v in texts.column("b")]
        aligned = Aligned(a, b, left.sizes, right.sizes)
        keys, found = _joined(_numbers(told.column("keys"))), _joined(_numbers(told.column("found")))
        order = np.argsort(keys)
        of_link = found[order[np.searchsorted(keys, aligned.key, sorter=order)]]
        counts, best = (np.concatenate([[0], np.cumsum(x)])[aligned.links] for x in (of_link >> 1, of_link & 1))
        tokens, until = aligned.written(a_text, b_text), aligned.a_until + aligned.b_until
        written = ["".join(tokens[s:e].tolist())[:-1] for s, e in zip(until, until[1:])]
        columns = {"id": texts.column("id"), "n_a": np.diff(aligned.a_until), "n_b": np.diff(aligned.b_until), "n_groups": np.diff(aligned.groups),
                   "n_links": np.diff(aligned.links), "n_best": np.diff(best), "count_sum": np.diff(counts),
                   "groups_sha256": [hashlib.sha256(w.encode()).hexdigest() if w else "" for w in written]}
        return pa.table(columns | ({"groups": written} if groups else {}))

    fields = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + (", groups string" if groups else "")
    rows = blocks.where("pairs IS NULL").select("block", "id", "a", "b")
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(summed, fields).withColumnRenamed("id", id_col)


@lru_cache(maxsize=1)
def _sign_texts(n_a: int, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    return _texts(n_a, ",", "|"), _texts(n_b, ",", ";")
