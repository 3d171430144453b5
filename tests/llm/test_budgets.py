"""The mixture against a plain reading of its rules; lines of a host by hand."""

import hashlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from gridloom.llm import line_dedup, mixing


def split(children, budget):
    """{name: tokens} of one parent; children are (name, weight, cap). Full ones first, the rest by weight."""
    out, left, open_ = {}, budget, sorted(children, key=lambda c: (Fraction(c[2], c[1]), c[0]))
    while open_ and open_[0][2] * sum(w for _, w, _ in open_) <= open_[0][1] * left:
        name, _, cap = open_.pop(0)
        out[name], left = cap, left - cap
    total = sum(w for _, w, _ in open_)
    return out | {name: left * w // total for name, w, _ in open_}


def by_hand(rows, weights, budget, max_epochs, seed):
    """Counter of (id, domain, source, tokens, copies)."""
    leaves = defaultdict(list)
    for i, d, s, n in rows:
        leaves[d or mixing.NONE, s or mixing.NONE].append((i, n or 0))
    avail = {k: sum(n for _, n in v) for k, v in leaves.items()}
    domains = sorted({d for d, _ in leaves})
    top = split([(d, weights["domain"].get(d, 1), max_epochs * sum(a for (x, _), a in avail.items() if x == d)) for d in domains], budget)
    out = Counter()
    for d in domains:
        given = split([(s, weights["source"].get(s, 1), max_epochs * a) for (x, s), a in avail.items() if x == d], top[d])
        for s, tokens in given.items():
            a = avail[d, s]
            epochs, rest = divmod(tokens, a) if a else (0, 0)
            key = lambda x: (hashlib.md5(f"{seed}:{epochs}:{'' if x[0] is None else x[0]}".encode()).hexdigest(), x[0] is not None, x[0] or 0, x[1])
            before = 0
            for i, n in sorted(leaves[d, s], key=key):
                out[i, d, s, n, epochs + (before < rest)] += 1
                before += n
    return out


ROWS = ([(i, "ab"[i % 2], f"s{i % 5}", i * 7 % 31) for i in range(400)]
        + [(None, "a", "s0", 9)] * 300 + [(None, "a", "s0", 0)] * 5 + [(77, "b", "s1", 3)] * 200
        + [(900 + i, None, None, 11) for i in range(6)] + [(950, "c", "s9", None), (951, "c", "s9", 0), (952, "c", "tiny", 2)])
WEIGHTS = {"domain": {"a": 1, "b": 2, "c": 50}, "source": {"s1": 3}}


@pytest.mark.parametrize("budget", [0, 1, 500, 3000, 9000, 10 ** 6])
def test_mixture_by_hand(spark, monkeypatch, budget):
    """Shortages go to siblings before ancestors; nulls, repeated rows and one id with a third of all rows included."""
    monkeypatch.setattr(mixing, "_RANGE_ROWS", 0.0002)  # three rounds of ranges
    docs = spark.createDataFrame(ROWS, "doc_id long, domain string, source string, n_tokens long")
    got = mixing.mix(docs, ["domain", "source"], weights=WEIGHTS, budget=budget, max_epochs=2, seed=3)
    assert Counter(tuple(r) for r in got.select("doc_id", "domain", "source", "n_tokens", "copies").collect()) == by_hand(ROWS, WEIGHTS, budget, 2, 3)


def test_many_alike_rows_come_out_one_by_one(spark):
    docs = spark.range(10_000).selectExpr("cast(null as long) AS doc_id", "'a' AS domain", "3L AS n_tokens")
    got = Counter(r.copies for r in mixing.mix(docs, ["domain"], budget=10_000, max_epochs=1).collect())
    assert got == {1: 3334, 0: 6666}


def test_mixture_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, domain string, n_tokens long")
    assert mixing.mix(docs, ["domain"]).count() == 0


def test_lines_leave_columns_of_any_name(spark):
    """Null ids, texts and hosts, an empty text, repeated rows, and columns called like the ones used inside."""
    fields = "doc_id long, source string, text string, _host string, _slots int, _left int, host string, line string, slot int, size long"
    rest = ("h", 1, 2, "x", "y", 3, 4)
    rows = [(1, "a", "menu\nown 1\nmenu\nfoot "), (2, "a", "menu\nown 2"), (2, "a", "menu\nown 2"), (None, "a", " foot\nown 3"), (5, "a", "foot"),
            (6, None, "menu"), (7, "a", None), (8, "b", ""), (9, "b", "menu\nfoot")]
    pages = spark.createDataFrame([(*r, *rest) for r in rows], fields)
    got = line_dedup.drop_boilerplate(pages, ratio=0.4, n_lines="lines", n_dropped="gone")
    assert got.columns == [*pages.columns, "lines", "gone"] and all(tuple(r[3:10]) == rest for r in got.collect())
    found = Counter((r.doc_id, r.source, r.text, r.lines, r.gone) for r in got.collect())
    assert found == Counter([(1, "a", "own 1", 4, 3), (2, "a", "own 2", 2, 1), (2, "a", "own 2", 2, 1), (None, "a", "own 3", 2, 1), (5, "a", "", 1, 1),
                             (6, None, "menu", 1, 0), (7, "a", None, 0, 0), (8, "b", "", 1, 0), (9, "b", "menu\nfoot", 2, 0)])
    assert line_dedup.drop_boilerplate(pages.limit(0)).count() == 0


def test_long_equal_pages(spark):
    """Each line of three long pages is boilerplate; every one is looked up in a slot of its own size, not in the list of all."""
    text = "\n".join(f"line {i}" for i in range(40_000))
    pages = spark.createDataFrame([(i, "a", text + f"\nown {i}") for i in range(3)], "doc_id long, source string, text string")
    assert {r.doc_id: r.text for r in line_dedup.drop_boilerplate(pages).collect()} == {i: f"own {i}" for i in range(3)}
