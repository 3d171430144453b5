"""Packing documents into sequences by the sum-of-squares rule.

A document is its token ids and an end id; only a document longer than a
sequence is cut. Pieces are dealt by hash into groups of a fixed expected size,
each packed by one task. Within a group the pieces come longest first; each goes
to the open sequence whose choice makes the sum over all residual gaps of the
squared number of open sequences with that gap smallest, and a new sequence is
opened only when the piece fits into none.

Tokens of a text are the tokens of its blank-separated words one after the
other (the tokenizer's own rules never join across a blank), so words seen
before are looked up in a bounded table.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from string import ascii_letters
from struct import pack as packed
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import WordTable, as_bytes, map_batches, map_texts
from gridloom.session import materialise, ship

if TYPE_CHECKING:  # its import costs a worker memory that only the placing ones need
    import pandas


#: ASCII signs but for the apostrophe and `<`.
_SIGNS = b"!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"


def _keeps_letters(tokenizer) -> bool:
    """Whether a word of ASCII letters reaches the model of a tokenizer whole and only lower-cased."""
    if tokenizer.normalizer is None or tokenizer.pre_tokenizer is None or any(t.content.isalpha() for t in tokenizer.get_added_tokens_decoder().values()):
        return False
    normal = tokenizer.normalizer.normalize_str(ascii_letters)
    return normal == ascii_letters.lower() and [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(normal)] == [normal]


@lru_cache(maxsize=2)
def word_tokens(path: str, table_words: int) -> WordTable:
    """Ids of words as little-endian 32-bit bytes, for at most twice `table_words` words at hand."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread for each task
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    ends = np.asarray([t.endswith("</w>") for t, _ in sorted(tokenizer.get_vocab().items(), key=lambda x: x[1])])

    def one_by_one(words: list[str]) -> Iterator[bytes]:
        for e in tokenizer.encode_batch_fast(words, add_special_tokens=False):
            yield np.asarray(e.ids, "<u4").tobytes()

    of_signs = lru_cache(maxsize=1 << 12)(lambda signs: b"".join(one_by_one([signs.decode()])) if signs else b"")

    bare, straight = tokenizer.model.tokenize, _keeps_letters(tokenizer)

    def of_letters(words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words of letters: those of plain letters straight from the model, others in one call, parted at the vocabulary's mark of a word's end."""
        known = {}
        if straight:
            for w in filter(bytes.isalpha, words):
                ids = [t.id for t in bare(w.decode().lower())]
                known[w] = packed(f"<{len(ids)}I", *ids)
            words = [w for w in words if w not in known]
        if words:
            (e,) = tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)
            ids = np.asarray(e.ids, "<u4")
            until = (np.flatnonzero(ends[ids]) + 1).tolist()
            if len(until) == len(words):  # unless lower-casing made something else than letters
                known.update((w, ids[i:j].tobytes()) for w, i, j in zip(words, [0, *until], until))
        return known

    def encode(words: list[bytes]) -> list[bytes]:
        """Signs after the letters are a part of their own to the tokenizer; an
        apostrophe may begin an ending and `<` a special token, so these are
        not taken off.
        """
        heads = [w.rstrip(_SIGNS) for w in words]
        known = of_letters([h for h in set(heads) if h.isalpha() or not h.isascii() and h.decode().isalpha()])
        rest = [w for w, h in zip(words, heads) if h not in known]
        whole = dict(zip(rest, one_by_one([w.decode() for w in rest])))
        return [whole[w] if w in whole else known[h] + of_signs(w[len(h):]) for w, h in zip(words, heads)]

    return WordTable(encode, table_words)


def squeezed(ids: bytes) -> bytes:
    """Ids for the way through a table and a shuffle: 16 bits each where all fit, compressed."""
    wide = np.frombuffer(ids, "<u4")
    return zstandard.compress(ids if wide.max(initial=0) >> 16 else wide.astype("<u2").tobytes(), 1)


def unsqueezed(data: bytes, length: int) -> bytes:
    """The `length` ids that `squeezed` was given."""
    raw = zstandard.decompress(data)
    return raw if len(raw) == 4 * length else np.frombuffer(raw, "<u2").astype("<u4").tobytes()


#: Rows of a batch of whole ids, 2 MB at 2048 ids each.
_WHOLE_ROWS = 256


def _unsqueeze(placed: DataFrame) -> DataFrame:
    """`placed` with its `ids` as they were before `squeezed`."""
    at, count = placed.columns.index("ids"), placed.columns.index("length")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, _WHOLE_ROWS):
                part = batch.slice(k, _WHOLE_ROWS)
                whole = [unsqueezed(*x) for x in zip(part.column(at).to_pylist(), part.column(count).to_pylist())]
                columns = list(part.columns)
                columns[at] = pa.array(whole, pa.binary())
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return map_batches(placed, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields))


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0,
           table_words: int = 1 << 19, squeeze: bool = False) -> DataFrame:
    """(id, piece, start, length, ids) of every document; `ids` are little-endian unsigned 32-bit numbers, or `squeezed` ones."""
    size, end, kept = 4 * capacity, np.asarray([end_id], "<u4").tobytes(), squeezed if squeeze else bytes

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        tokens = word_tokens(tokenizer, table_words)
        for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            ids = tokens.lookup(text.split()) + end
            out += [(doc, k, at // 4, len(ids[at:at + size]) // 4, kept(ids[at:at + size])) for k, at in enumerate(range(0, len(ids), size))]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["id", "piece", "start", "length", "ids"])

    return map_texts(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")),
                     "id long, piece int, start long, length long, ids binary", run).withColumnRenamed("id", id_col)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> Iterator[tuple[int, int]]:
    """(sequence, offset) for each length in turn; `lengths` come longest first."""
    held = np.zeros(capacity + 1, np.int64)
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    opened = 0
    for s in map(int, lengths):
        gaps = np.flatnonzero(held[s:capacity]) + s
        if len(gaps):
            # leaving gap g takes 2 held(g) - 1 off the sum; reaching gap g - s adds 2 held(g - s) + 1, a full sequence nothing
            change = np.where(gaps > s, 2 * held[gaps - s] + 1, 0) - 2 * held[gaps] + 1
            gap = int(gaps[change.argmin()])
            number = bins[gap].pop()
            held[gap] -= 1
        else:
            gap, number, opened = capacity, opened, opened + 1
        if gap > s:
            bins[gap - s].append(number)
            held[gap - s] += 1
        yield number, capacity - gap


def place(cut: DataFrame, capacity: int = 2048, group_rows: int = 50_000, by: Sequence[str] = ()) -> DataFrame:
    """Add `sequence_id` and `offset` to a table of pieces with a `length` of 1 to `capacity`.

    Groups of about `group_rows` pieces bound what a task holds; a larger group
    fills its sequences slightly better. Rows are dealt by the columns `by`, all
    unless named. The table should be written: its rows are counted first.
    """
    groups = max(1, round(cut.count() / group_rows))
    ship(cut.sparkSession)
    dealt = cut.withColumn("_group", F.pmod(F.xxhash64(*(by or cut.columns)), F.lit(groups)))

    def pack(held: pandas.DataFrame) -> pandas.DataFrame:
        held = held.sort_values("length", ascending=False, kind="stable")
        found = np.array(list(sum_of_squares(held["length"].to_numpy(), capacity)), np.int64).reshape(-1, 2)
        held["sequence_id"] = (held["_group"].to_numpy() << 32) + found[:, 0]
        held["offset"] = found[:, 1]
        return held.drop(columns="_group")

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return dealt.groupBy("_group").applyInPandas(pack, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0,
         group_rows: int = 50_000, digest: bool = False, table_words: int = 1 << 19) -> DataFrame:
    """Pieces of all documents with their place: (id, piece, start, length, ids, sequence_id, offset).

    `table_words` trades the memory of a worker for time; it changes no result.
    The places are found from the lengths alone, then the ids, compressed until
    then, are joined to them; with `digest`, `ids_crc32` (CRC-32 of the placed ids' bytes) is added.
    Null text counts as empty: one piece that holds the end id. Repeated rows
    are documents of their own, a null id is passed on. Other columns are not
    looked at; an empty table gives an empty table.
    """
    cut = pieces(docs, tokenizer, id_col, text_col, capacity, end_id, table_words, squeeze=True)
    cut = materialise(cut.select(id_col, "piece", "start", "length", "ids", F.crc32("ids").alias("_crc"), F.monotonically_increasing_id().alias("_row")), "pieces")
    # dealt by their row too, so that equal documents do not share a group
    placed = materialise(place(cut.select("_row", "length", "_crc"), capacity, group_rows).select("_row", "sequence_id", "offset"), "places")
    out = _unsqueeze(cut.select("_row", id_col, "piece", "start", "length", "ids").join(placed, "_row").drop("_row"))
    return out.withColumn("ids_crc32", F.crc32("ids")) if digest else out
