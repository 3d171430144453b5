"""Byte-level BPE against the tiktoken library, byte by byte and after edits."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from by_hand import DATA, by_id

from gridloom.llm import byte_bpe, packing, queries

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SPLIT = regex.compile(public_tokenizers.PATTERN)
SCRAPS = ["a", "b", " ", "  ", "\n", "\r\n", "'s", "'", "é", "日本語", "1", "23", " the", "!!", "\t", "xxxxx", "<|endoftext|>", " ", "\U0001f600", "l", "ve"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def u4(ids):
    return np.asarray(ids, "<u4").tobytes()


def scraps(rng, n):
    return "".join(rng.choice(SCRAPS) for _ in range(n))


def test_query_equals_library(spark, data, library):
    got, texts = by_id(queries.RUNS["op12_byte_bpe"](spark, DATA)), data("documents").select("doc_id", "text").collect()
    assert sum(map(len, got.values())) == len(texts)
    for r in texts:
        ids, (g,) = library.encode_ordinary(r.text or ""), got[r.doc_id]
        assert g[1:] == (len(ids), hashlib.sha256(u4(ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())


def test_odd_rows(odd, docs, library):
    out = byte_bpe.decode(byte_bpe.encode(odd, RANKS), RANKS)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    got = by_id(out)
    assert len(got[4]) == 2 and len(got[None]) == 1 and sum(map(len, got.values())) == odd.count()
    for r in odd.collect():
        g = got[r.doc_id][0]
        assert g.ids == u4(library.encode_ordinary(r.text or "")) and g.decoded == (r.text or "").encode() and g.n_tokens == len(g.ids) // 4
    assert byte_bpe.encode(docs([]), RANKS).count() == 0 and byte_bpe.decode(byte_bpe.encode(docs([]), RANKS), RANKS).count() == 0


def test_long_matches_and_small_table(docs, library):
    """One match of a megabyte, many distinct words with room for few, special tokens as plain text."""
    rng = random.Random(5)
    texts = ["ab" * 500_000, " " * 300_000 + "x", "\n" * 10_000, "x <|endoftext|> y", *(scraps(rng, 200) for _ in range(50))]
    got = by_id(byte_bpe.encode(docs(list(enumerate(texts))), RANKS, table_words=8))
    for i, t in enumerate(texts):
        assert got[i][0].n_tokens * 4 == len(got[i][0].ids) and byte_bpe_bytes(got[i][0].ids) == t.encode()
        if i:  # the library takes long on the first
            assert got[i][0].ids == u4(library.encode_ordinary(t)), i


def byte_bpe_bytes(ids):
    held = byte_bpe.vocabulary(RANKS).token
    return b"".join(held[i] for i in np.frombuffer(ids, "<u4").tolist())


def test_every_prefix_has_the_library_s_last_token(library):
    ranks, rng = byte_bpe.vocabulary(RANKS), random.Random(2)
    for _ in range(300):
        match = "".join(rng.choice("aabetinorsh") for _ in range(rng.randrange(1, 40))).encode()
        last = ranks.prefixes(match)
        assert last == [library._core_bpe.encode_single_piece(match[:k])[-1] for k in range(1, len(match) + 1)]
        k = rng.randrange(len(match))
        assert ranks.prefixes(match, last[:k]) == last  # continued from a prefix


def test_both_files_hold_the_same_ranks():
    assert byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.json")) == byte_bpe.read_ranks(RANKS)


def test_unreachable_tokens_end_no_prefix():
    """`abc` is in the vocabulary, but `a` and `b` never merge: only a whole match gives it, as in the library."""
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"abcd": 257, b"cd": 258, b"ab": 259}
    held = byte_bpe.Ranks(ranks)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for word in (b"abcd", b"abcde", b"xabcd", b"abc", b"cdab", b"abcdabcd"):
        assert held.encode(word) == own._core_bpe.encode_single_piece(word), word


def test_edits_follow_the_text(library):
    ranks, rng = byte_bpe.vocabulary(RANKS), random.Random(1)
    for _ in range(400):
        table = byte_bpe.Table.of(scraps(rng, rng.randrange(25)), ranks, SPLIT)
        for _ in range(4):
            table, _ = table.edited(rng.randrange(len(table.text) + 1), rng.choice([0, 0, 1, 3]), rng.choice(["", " ", "a", "'", "  b", "s ", "\n\n", "é"]), ranks, SPLIT)
            whole = byte_bpe.Table.of(table.text, ranks, SPLIT)
            assert (table.cuts, table.last) == (whole.cuts, whole.last)
            assert table.ids(ranks) == library.encode_ordinary(table.text)


def test_edited_tables(spark, docs, library):
    """Appending and editing one place computes a few prefixes, not the text; nulls, repeats and places beyond the end."""
    long = "Some words, and more of them. " * 5000
    tables = byte_bpe.prefix_tables(docs([(1, long), (2, None), (3, "abc"), (3, "abc"), (None, "null id"), (9, "unedited")]), RANKS)
    edits = spark.createDataFrame([(1, len(long), 0, "appended"), (1, 70_000, 4, "x"), (2, 5, 5, "new text"), (3, 3, 0, "def"), (3, 0, None, None), (None, 0, 4, "no"), (8, 0, 0, "absent")],
                                  "doc_id long, at long, remove long, insert string")
    got = by_id(byte_bpe.edit(tables, edits, RANKS))
    assert sorted((k, len(v)) for k, v in got.items() if k is not None) == [(1, 2), (2, 1), (3, 4)] and len(got[None]) == 1
    for r in sum(got.values(), []):
        assert r.ids == u4(library.encode_ordinary(r.text))
        whole = byte_bpe.Table.of(r.text, byte_bpe.vocabulary(RANKS), SPLIT)
        assert (r.cuts, r.last) == (u4(whole.cuts), u4(whole.last))
    assert {r.text for r in got[3]} == {"abcdef", "abc"} and got[None][0].text == "no id" and got[2][0].text == "new text"
    assert sorted(r.text for r in got[1]) == sorted([long + "appended", long[:70_000] + "x" + long[70_004:]]) and all(r.n_fresh < 40 for r in got[1])


def test_plain_words_go_straight_to_the_model():
    """The ids are those of the whole tokenizer; one that changes or cuts words of letters is asked as a whole."""
    from tokenizers import Tokenizer, pre_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, table = Tokenizer.from_file(path), packing.word_tokens(path, 1 << 10)
    assert packing._keeps_letters(whole)
    for text in ("Plain words, in a ROW. and and", "don't we'RE 'S s' ll <|endoftext|> a<b> x1). it's (and) a-b", "İstanbul Straße ÉCOLE! ﬁ ſ é. 日本語", "", ",,"):
        assert np.frombuffer(table.lookup(text.encode().split()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    whole.pre_tokenizer = pre_tokenizers.Split("e", "isolated")
    assert not packing._keeps_letters(whole)
