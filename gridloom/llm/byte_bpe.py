"""Byte-level BPE by prefix dynamic programming.

Of all tokens that a prefix of a match could end with, exactly one ends its BPE
encoding: the one that, with the last token of what stands before it, is left
alone when the bytes of the two are merged. So one token for each byte prefix
(the prefix table) holds the encodings of all prefixes. A table is continued when bytes are
appended, and after an edit only the matches next to it are computed anew.

Ids are ranks: a merge is named by the id of the token it makes, the lowest
first, the leftmost of equals, as in the rank files.
"""

from __future__ import annotations

import base64
import gc
import json
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import pairwise
from struct import pack

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import WordTable, map_batches

NEVER = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids, from a file of ranks or from a tokenizer's JSON whose merges come in the order of their ids."""
    if not path.endswith(".json"):
        with open(path, "rb") as f:
            return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    special = {t["id"] for t in held["added_tokens"]}
    letters = {c: b for b, c in enumerate(byte_letters())}
    ids = held["model"]["vocab"]
    made = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in held["model"]["merges"]]
    if any(a >= b for a, b in pairwise(made)):
        raise ValueError("merges do not come in the order of the ids they make")
    return {bytes(letters[c] for c in token): i for token, i in ids.items() if i not in special}


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class Ranks:
    """A vocabulary, how its tokens are built, and which two may stand next to each other."""

    def __init__(self, ranks: dict[bytes, int], remembered: int = 1 << 18):
        import ahocorasick

        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary holds every byte")
        self.ranks, self.remembered = ranks, remembered
        self.token = {i: t for t, i in ranks.items()}
        self.size = {i: len(t) for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        #: for each token, which tokens before it leave it alone, as far as asked
        self.after: dict[int, dict[int, bool]] = {i: {} for i in ranks.values()}
        self.asked = 0
        self.halves: dict[int, tuple[int, int]] = {}
        self.find = ahocorasick.Automaton()
        for token, i in ranks.items():
            parts = self._halves(token)
            if parts:
                self.halves[i] = parts
            if parts or len(token) == 1:  # a token that merging its bytes never makes ends no encoding
                self.find.add_word(token.decode("latin-1"), (i, len(token), self.after[i]))
        self.find.make_automaton()

    def _halves(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one."""
        own, parts = self.ranks[token], [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            rank, i = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(pairwise(parts)))
            if rank >= own:
                return None
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None

    def _border(self, token: int, side: int) -> list[int]:
        """What stands at the left (0) or right (1) end of a token while it is built, from the byte to the whole."""
        out = [token]
        while token in self.halves:
            token = self.halves[token][side]
            out.append(token)
        return out[::-1]

    def adjoin(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives just these two.

        Both are built side by side in the order of ranks; they stay apart
        unless what stands at their border at some time merges before either
        side moves on (the left one first among equals).
        """
        known = self.after[right].get(left)
        if known is None:
            if self.asked >= self.remembered:
                self.asked = 0
                for held in self.after.values():
                    held.clear()
            self.asked += 1
            known = self.after[right][left] = self._adjoin(self._border(left, 1), self._border(right, 0))
        return known

    def _adjoin(self, lefts: list[int], rights: list[int]) -> bool:
        i = j = 0
        while True:
            next_left = lefts[i + 1] if i + 1 < len(lefts) else NEVER
            next_right = rights[j + 1] if j + 1 < len(rights) else NEVER
            both = self.ranks.get(self.token[lefts[i]] + self.token[rights[j]], NEVER)
            if both < next_left and both <= next_right and both < NEVER:
                return False
            if next_left == next_right == NEVER:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def prefixes(self, match: bytes, last: Sequence[int] = ()) -> list[int]:
        """The last token of every prefix of one match; `last` holds those of its first prefixes, if known."""
        last = list(last)
        begin = max(0, len(last) - self.longest + 1)
        at = len(last) - begin
        for end, (token, size, after) in self.find.iter(match[begin:].decode("latin-1")):
            if end != at:
                continue  # decided already
            if size <= end + begin:
                left = last[end + begin - size]
                good = after.get(left)
                if not (self.adjoin(left, token) if good is None else good):
                    continue
            last.append(token)
            at += 1
        if len(last) != len(match):
            raise ValueError("no token ends a prefix")
        return last

    def encode(self, match: bytes, last: Sequence[int] | None = None) -> list[int]:
        """Ids of one match, read backwards from the end of its prefix table."""
        whole = self.ranks.get(match)
        if whole is not None:
            return [whole]
        last = self.prefixes(match) if last is None else last
        out, at = [], len(match)
        while at:
            token = last[at - 1]
            out.append(token)
            at -= self.size[token]
        return out[::-1]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Ranks:
    held = Ranks(read_ranks(path))
    gc.freeze()  # it lives as long as the worker: no collection has to look through it
    return held


def match_ids(path: str, table_words: int) -> WordTable:
    """Ids of matches (strings) as little-endian 32-bit bytes; at most twice `table_words` matches are held."""
    ranks = vocabulary(path)

    def encode(words: list[str]) -> Iterator[bytes]:
        for w in words:
            ids = ranks.encode(w.encode())
            yield pack(f"<{len(ids)}I", *ids)

    return WordTable(encode, table_words)


def encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = public_tokenizers.PATTERN,
           table_words: int = 1 << 17) -> DataFrame:
    """(id, n_tokens, ids) of every document, `ids` as little-endian unsigned 32-bit numbers.

    Each match of `pattern` is encoded by itself; special tokens in a text are
    plain text. Null text counts as empty and gives no ids; repeated rows are
    encoded each, a null id is passed on, other columns are not looked at, an
    empty table gives an empty table. `table_words` trades a worker's memory
    for time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = regex.compile(pattern).findall, match_ids(ranks, table_words)
        for batch in batches:
            ids = [known.lookup(split(t.as_py() or "")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], ["id", "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for (null for null ids); an id the vocabulary lacks is an error."""
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {i: t for t, i in read_ranks(ranks).items()}
        for batch in batches:
            ids = (v.as_py() for v in batch.column(ids_col))
            out = [None if v is None else b"".join(map(held.__getitem__, np.frombuffer(v, "<u4").tolist())) for v in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*names, to])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return map_batches(encoded, run, f"{fields}, `{to}` binary")


# -- prefix tables that follow edits ----------------------------------------------------------------------------------

class Table:
    """A text, the starts of its matches (in characters) and the last token of every byte prefix of every match."""

    def __init__(self, text: str, cuts: list[int], last: list[int]):
        self.text, self.cuts, self.last = text, cuts, last

    @classmethod
    def of(cls, text: str, ranks: Ranks, split: regex.Pattern) -> Table:
        cuts, last = [], []
        for m in split.finditer(text):
            cuts.append(m.start())
            last += ranks.prefixes(m.group().encode())
        return cls(text, cuts, last)

    def ids(self, ranks: Ranks) -> list[int]:
        out, at = [], 0
        for a, b in pairwise([*self.cuts, len(self.text)]):
            match = self.text[a:b].encode()
            out += ranks.encode(match, self.last[at:at + len(match)])
            at += len(match)
        return out

    def edited(self, at: int, remove: int, insert: str, ranks: Ranks, split: regex.Pattern) -> tuple[Table, int]:
        """The table after `remove` characters from `at` on gave way to `insert`, and how many prefixes were computed anew.

        Whether a match ends depends on at most the two characters after it, so
        those further left stay; to the right, matches are the old ones again
        as soon as one begins where an old one began.
        """
        at = min(max(at, 0), len(self.text))
        remove = min(max(remove, 0), len(self.text) - at)
        text = self.text[:at] + insert + self.text[at + remove:]
        ends = [*self.cuts[1:], len(self.text)] if self.cuts else []
        keep = bisect_right(ends, at - 2)
        begin = ends[keep - 1] if keep else 0
        done = len(self.text[:begin].encode())
        cuts, last, fresh = self.cuts[:keep], self.last[:done], 0
        old_bytes = self.text[begin:ends[keep]].encode() if keep < len(ends) else b""
        shift = len(text) - len(self.text)
        for m in split.finditer(text, pos=begin):
            if m.start() >= at + len(insert):
                k = bisect_right(self.cuts, m.start() - shift) - 1
                if k >= 0 and self.cuts[k] == m.start() - shift:
                    cuts += [c + shift for c in self.cuts[k:]]
                    last += self.last[len(self.text[:self.cuts[k]].encode()):]
                    break
            match = m.group().encode()
            same = 0
            if m.start() == begin:  # the match that the edit lies in or follows: its unchanged first bytes are known
                while same < min(len(match), len(old_bytes)) and match[same] == old_bytes[same]:
                    same += 1
            cuts.append(m.start())
            last += ranks.prefixes(match, self.last[done:done + same])
            fresh += len(match) - same
        return Table(text, cuts, last), fresh


_TABLE = "id {}, text string, cuts binary, last binary"


def prefix_tables(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(id, text, cuts, last): prefix tables to keep beside texts that will be edited (`cuts`, `last`: little-endian 32-bit numbers).

    Null text counts as empty; repeated rows and null ids are kept.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, split = vocabulary(ranks), regex.compile(pattern)
        for batch in batches:
            made = [Table.of(t.as_py() or "", held, split) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(made)], ["id", "text", "cuts", "last"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, _TABLE.format(kind))
    return out.withColumnRenamed("id", id_col)


def _columns(tables: list[Table]) -> list[pa.Array]:
    return [pa.array([t.text for t in tables], pa.string()), pa.array([np.asarray(t.cuts, "<u4").tobytes() for t in tables], pa.binary()),
            pa.array([np.asarray(t.last, "<u4").tobytes() for t in tables], pa.binary())]


def edit(tables: DataFrame, edits: DataFrame, ranks: str, id_col: str = "doc_id", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Prefix tables after edits: (id, text, cuts, last, ids, n_fresh) for every table that has an edit.

    `edits` holds the id, `at` and `remove` (characters; null 0, beyond the end:
    the end) and `insert` (null: nothing). Several edits of one id each start
    from the stored table. `n_fresh` counts the prefixes computed anew.
    """
    kind = tables.schema[id_col].dataType.simpleString()
    work = tables.select(F.col(id_col).alias("_key"), "text", "cuts", "last").join(
        edits.select(F.col(id_col).alias("id"), F.coalesce(F.col("at").cast("long"), F.lit(0)).alias("at"), F.coalesce(F.col("remove").cast("long"), F.lit(0)).alias("remove"),
                     F.coalesce("insert", F.lit("")).alias("insert")), F.col("_key").eqNullSafe(F.col("id"))).select("id", "text", "cuts", "last", "at", "remove", "insert")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, split = vocabulary(ranks), regex.compile(pattern)
        for batch in batches:
            made, fresh = [], []
            for text, cuts, last, at, remove, insert in zip(*(c.to_pylist() for c in batch.columns[1:])):
                old = Table(text, np.frombuffer(cuts, "<u4").tolist(), np.frombuffer(last, "<u4").tolist())
                new, n = old.edited(at, remove, insert, held, split)
                made.append(new)
                fresh.append(n)
            ids = pa.array([np.asarray(t.ids(held), "<u4").tobytes() for t in made], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(made), ids, pa.array(fresh, pa.int64())], ["id", "text", "cuts", "last", "ids", "n_fresh"])

    return map_batches(work, run, _TABLE.format(kind) + ", ids binary, n_fresh long").withColumnRenamed("id", id_col)
