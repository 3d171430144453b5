"""Token alignment against nested loops over the tokenizers' own output; the perfect hash by its definition."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from by_hand import by_id
from tokenizers import Tokenizer

from gridloom.llm import byte_bpe, queries, token_alignment
from gridloom.llm.perfect_hash import PerfectHash

SMALL = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def expected(texts, libraries):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every text, by comparing byte ranges."""
    a_model, b_model = libraries
    letters = {c: b for b, c in enumerate(byte_bpe.byte_letters())}
    a_bytes = lambda i: bytes(letters[c] for c in a_model.id_to_token(i))
    b_bytes = lambda i: bytes([i - 3]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode()
    held, counts = [], Counter()
    for text in texts:
        a = [(i, a_bytes(i)) for i in a_model.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = [(i, b_bytes(i)) for i in b_model.encode(text or "")]
        want = b" " + (text or "").encode()
        if not text or any(b"".join(t for _, t in side) != want for side in (a, b)):
            held.append(([], [], []))
            continue
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, t in side:
                out.append((i, at, at := at + len(t)))
            spans.append(out)
        links, first = [], 0
        for i, s, e in spans[0]:
            while spans[1][first][2] <= s:
                first += 1
            for j, s2, e2 in spans[1][first:]:
                if s2 >= e:
                    break
                if min(e, e2) > max(s, s2):
                    links.append((i, j))
        held.append((*spans, links))
        counts.update(set(links))
    highest = defaultdict(int)
    for (i, _), n in counts.items():
        highest[i] = max(highest[i], n)
    out = []
    for a, b, links in held:
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        parts = ["|".join(",".join(str(i) for i, s, e in side if lo <= s and e <= hi) for side in (a, b)) for lo, hi in zip([0, *ends], ends)]
        out.append((len(a), len(b), len(ends), len(links), sum(counts[x] == highest[x[0]] for x in links), sum(counts[x] for x in links), ";".join(parts)))
    return out


def check(got, texts, libraries, has_groups):
    for i, want in zip(sorted(got), expected([texts[i] for i in sorted(got)], libraries)):
        for r in got[i]:
            assert tuple(r)[1:7] == want[:6], i
            assert r.groups_sha256 == (hashlib.sha256(want[6].encode()).hexdigest() if want[6] else "")
            assert not has_groups or r.groups == want[6]


def test_query_equals_nested_loops(spark, libraries):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    got = by_id(queries.RUNS["op13_token_alignment"](spark, SMALL))
    assert sorted(got) == sorted(texts) and all(len(v) == 1 for v in got.values())
    check(got, texts, libraries, False)


ODD_TEXTS = ["", None, " ", "  ", "a ", " a", "a  b   c ", "▁x", "x▁y", "<|endoftext|> and <s>plain</s><unk>", "日本語 é\n\n\tß", "\U0001f600 x", "new\nline new\nline", "the the the", "the the the",
             "   x", "\x00\x01", "'s'll", "don't stop", "ab" * 20_000, "word " * 3000]


@pytest.mark.parametrize("sizes", [{}, {"shard_pairs": 16, "fan_in": 2, "table_words": 4, "block_bytes": 10}])
def test_odd_texts(docs, libraries, sizes):
    """Many small blocks and shards and a deep tree give the same."""
    got = by_id(token_alignment.align(docs(list(enumerate(ODD_TEXTS))), A, B, groups=True, **sizes))
    assert len(got) == len(ODD_TEXTS) and all(len(v) == 1 for v in got.values())
    check(got, ODD_TEXTS, libraries, True)
    assert got[0][0].groups_sha256 == got[1][0].groups_sha256 == got[7][0].groups_sha256 == ""


def test_repeats_nulls_and_empty_table(docs):
    got = by_id(token_alignment.align(docs([(4, "One word"), (4, "One word"), (None, "null id"), (7, None)]), A, B))
    assert len(got[4]) == 2 and len(got[None]) == 1 and got[7][0].n_a == 0 and got[4][0] == got[4][1]
    assert got[4][0].count_sum == 2 * got[4][0].n_links and got[None][0].count_sum == got[None][0].n_links
    assert token_alignment.align(docs([]), A, B).count() == 0


def test_pair_counts(docs):
    got = {(r.a, r.b): r.n_docs for r in token_alignment.pair_counts(docs([(1, "the cat"), (2, "the dog"), (2, "the dog"), (3, None)]), A, B).collect()}
    assert max(got.values()) == 3 and sorted(set(got.values())) == [1, 2, 3]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 100_000])
def test_perfect_hash(n):
    rng = random.Random(n)
    keys = np.asarray(sorted({rng.randrange(1 << 48) for _ in range(n)}), np.int64)
    made = PerfectHash.build(keys)
    again = PerfectHash.from_bytes(made.to_bytes())
    assert sorted(again.number(keys).tolist()) == list(range(len(keys))) and (again.number(keys) == made.number(keys)).all()
    assert len(made.to_bytes()) <= 64 + 0.6 * n + 100


def test_perfect_hash_refuses_repeats():
    with pytest.raises(ValueError):
        PerfectHash.build(np.asarray([5, 7, 5]))
