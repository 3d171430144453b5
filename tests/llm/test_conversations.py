"""Conversation repair against a plain cheapest-path search over whole audits."""

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import pytest
from by_hand import DATA, by_id

from gridloom.llm import conversation_repair as cr
from gridloom.llm import queries

SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    """Of (turn, role, text) in order."""
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(SPACE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Uniform-cost search over (cost, audit): the first end reached is the cheapest, ASCII-least among equals."""
    heap = [(0, "", 0, "", ())]
    done = set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, out
        if (i, last) in done:
            continue
        done.add((i, last))
        then = "a" if last == "u" else "u"
        name = {"u": "user", "a": "assistant"}[then]
        heapq.heappush(heap, (cost + 3, audit + "I", i, then, (*out, f"{name}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, out))
            if found[i] not in ("blank", "duplicate"):
                more = 3 * (found[i] == "truncated")
                if role[:1] == then or (role[:1] == "s" and last == ""):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*out, f"{role}:{text}")))
                heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, then, (*out, f"{name}:{text}")))


def order(rows):
    key = lambda r: hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), key(r)))


def by_brute_force(table):
    """{conversation: expected row} of (conv, turn, role, text) rows."""
    groups = defaultdict(list)
    for c, turn, role, text in table:
        groups[c].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for c, rows in groups.items():
        rows = order(rows)
        found, turns = faults(rows), {t for t, _, _ in rows if t is not None}
        cost, audit, kept = cheapest(rows, found)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        out[c] = (c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(found.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                  hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def damaged(table):
    for c, turn, role, text in table:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else text.translate({ord(x): None for x in ".!?"}) if kind == 2 else text
        row = c, turn, "user" if kind == 4 else role, text
        yield from [row] * (kind != 0) + [row] * (kind == 3)


EMPTY = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_query_equals_brute_force(spark, data):
    table = [tuple(r) for r in data("conversations").select("conv_id", "turn", "role", "text").collect()]
    want = {c: (c, *EMPTY) for c, *_ in table} | by_brute_force(damaged(table))
    got = by_id(queries.RUNS["op11_conversation_repair"](spark, DATA), "conv_id")
    assert {c: [tuple(r) for r in rs] for c, rs in got.items()} == {c: [w] for c, w in want.items()}
    assert len({r[7] for r in want.values()}) > 5


def random_table(rng, conversations):
    out = []
    for c in range(conversations):
        for _ in range(rng.randrange(1, 9)):
            out.append((c, rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "admin"]),
                        rng.choice(["Yes.", "No!", "cut off", "", " \t", None, "Why? ", "é.\n", "."])))
    return out


@pytest.fixture(scope="module")
def frame(spark):
    """With clashing extra columns."""
    kind = "conv_id long, turn long, role string, text string, conv long, mark int, audit string, digest binary, is_row boolean"
    return lambda rows: spark.createDataFrame([(*r, 1, 2, "D", b"x", True) for r in rows], kind)


def test_random_conversations(frame):
    """Nulls, ties, repeats, foreign roles; the repaired rows are those the digest was taken of."""
    table = random_table(random.Random(4), 300) + [(None, 1, "user", "Null conversation."), (None, 1, "user", "Null conversation.")]
    found = cr.repair(frame(table)).cache()
    got = {r.conv_id: tuple(r) for r in found.collect()}
    assert got == by_brute_force(table)
    lines = defaultdict(dict)
    for r in cr.repaired(frame(table), found).collect():
        lines[r.conv_id][r.place] = f"{r.role}:{r.text}"
    for c, r in got.items():
        assert hashlib.sha256("\n".join(lines[c][k] for k in sorted(lines[c])).encode()).hexdigest() == r[-1]


def test_search_alone():
    rng = random.Random(9)
    for n in [*range(9), 12, 20]:
        for _ in range(150):
            marks = bytes(rng.randrange(16) for _ in range(n))
            rows = [(i, ["system", "user", "assistant", "x"][m // 4], f"{i}.") for i, m in enumerate(marks)]
            want = cheapest(rows, [["", "truncated", "blank", "duplicate"][m % 4] for m in marks])
            assert cr.search(marks) == want[:2], marks


def test_bounds_never_exceed_what_is_needed():
    """The lower bounds are admissible in every state, so the first accepting path is the cheapest."""
    rng = random.Random(3)
    for _ in range(100):
        marks = bytes(rng.randrange(16) for _ in range(6))
        cost, _ = cr.search(marks)
        user, _, last_system = cr._needs(marks)
        assert (max(0, user[0] - cr.DELETE) if last_system >= 0 else user[0]) <= cost


def test_long_conversation(frame):
    """Tens of thousands of rows under one id, with stray system rows: no recursion, few rounds."""
    rng = random.Random(7)
    rows = [(5, i, rng.choice(["user", "assistant"] * 4 + ["system"]), rng.choice(["Fine.", "cut", ""]) + str(i) * (i % 3 > 0)) for i in range(20_000)]
    (r,) = cr.repair(frame(rows)).collect()
    assert r.audit.count("I") + 20_000 == len(r.audit) and r.duplicate > 0
    assert r.cost == 4 * r.audit.count("D") + 3 * r.audit.count("I") + 3 * r.audit.count("R") + 3 * sum(
        m == "truncated" and e in "KR" for m, e in zip(faults(order([x[1:] for x in rows])), r.audit.replace("I", "")))


def test_empty_table(frame):
    assert cr.repair(frame([])).count() == 0 and cr.damage(frame([])).count() == 0


def test_damage(frame):
    """Every kind of damage, and rows with nulls in the key."""
    table = [(c, t, "assistant", "One. Two? Three!") for c in range(30) for t in range(8)] + [(None, 3, None, None), (4, None, "user", "x")]
    got = sorted((tuple(r) for r in cr.damage(frame(table)).collect()), key=str)
    assert got == sorted(damaged(table), key=str) and any(r[3] == "One Two Three" for r in got)
