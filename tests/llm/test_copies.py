"""Exact and near copies, repeated lines and passages, vectors: against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from by_hand import DATA, by_id, components

from gridloom.llm import embedding_dedup, exact_dedup, line_dedup, queries, simhash, substring_dedup
from gridloom.llm.common import lower_ascii
from gridloom.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# exact copies

def exact_by_hand(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    out = Counter()
    for i, t in rows:
        g = groups[lower(t)]
        keep = max((x for x in g if x is not None), default=None)
        out[(i, keep, len(g), i == keep, hashlib.sha256(lower(t).encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("bits", [64, 3, 1])
def test_exact_copies(spark, docs, bits):
    """Few hash bits make almost every chunk share its hash with another text."""
    rng = random.Random(3)
    base = [" ".join(rng.choice("Ärger am BACH, drei. vier! \n sechs".split(" ")) for _ in range(rng.randrange(1, 900))) for _ in range(30)]
    rows = [(i, rng.choice(base) + rng.choice(["", "", "!", "É", "é"])) for i in range(150)]
    rows = [(i, t.upper() if i % 7 == 0 and t.isascii() else t) for i, t in rows] + [(900, None), (901, ""), (901, ""), (None, "null id"), (902, base[0] * 40), (903, base[0] * 40)]
    got = Counter(tuple(r) for r in exact_dedup.exact_duplicates(docs(rows), low=16, high=64, bits=bits).collect())
    assert got == exact_by_hand(rows)


def test_exact_copies_of_sample(data):
    rows = [(r.doc_id, r.text) for r in data("documents").select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in exact_dedup.exact_duplicates(data("documents")).collect()) == exact_by_hand(rows)


def test_chunks_make_up_the_text(spark):
    texts = ["", "a", "a" * 10_000, "one, two. three\n" * 700, "é😀 " * 3000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", exact_dedup.chunks_of(df.t, 256, 4096).alias("c"), lower_ascii(df.t).alias("l")).collect():
        assert "".join(r.c) == r.t and all(len(c) <= 4096 for c in r.c) and r.l == lower(r.t)


def test_native_operators_run_no_python(spark):
    for q in ("op2_line_dedup", "op8_exact_dedup"):
        text = queries.RUNS[q](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in text and "Arrow" not in text and "Pandas" not in text


# lines

def test_lines_by_hand(spark):
    rows = [("a", "Menu\nx\n\nMenu "), ("a", "Menu\ny"), ("a", " Menu\nz\n"), ("a", "w"), ("b", "Menu\nq"), ("b", "Menu"), (None, "Menu"), ("a", None), ("b", "")]
    pages = spark.createDataFrame([(i, h, t, "k") for i, (h, t) in enumerate(rows)], "page int, site string, body string, host string")
    out = line_dedup.drop_boilerplate(pages, "site", "body", ratio=0.5, min_pages=3, n_lines="n", n_dropped="k")
    assert [(r.page, r.body, r.n, r.k) for r in out.orderBy("page").collect()] == [
        (0, "x\n", 4, 2), (1, "y", 2, 1), (2, "z\n", 3, 1), (3, "w", 1, 0), (4, "Menu\nq", 2, 0), (5, "Menu", 1, 0), (6, "Menu", 1, 0), (7, None, 0, 0), (8, "", 1, 0)]


def test_line_ratio_is_a_limit_not_reached(spark):
    pages = spark.createDataFrame([("a", "x" if i < 5 else f"{i}") for i in range(10)], "source string, text string")
    assert line_dedup.drop_boilerplate(pages, ratio=0.5).where("text = ''").count() == 0
    assert line_dedup.drop_boilerplate(pages, ratio=0.49).where("text = ''").count() == 5


# SimHash

def fingerprint_by_hand(text, k):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_of_sample(data):
    rows = {r.doc_id: r.text for r in data("documents").select("doc_id", "text").collect()}
    fps = {i: fingerprint_by_hand(t, 3) for i, t in rows.items()}
    ids = sorted(fps)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if (fps[a] ^ fps[b]).bit_count() <= 2]
    want = components(links, ids)
    got = queries.RUNS["op3_simhash"](data("documents").sparkSession, DATA).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{fps[i]:016x}", want[i]) for i in ids} and len(got) == len(ids)


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_index_finds_every_link(spark, bits):
    rng = random.Random(bits)
    fps = {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1, 1 << 63}
    for f in list(fps):
        for _ in range(4):
            fps.add(f ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))))
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    nodes = spark.createDataFrame([(i, signed[f]) for i, f in enumerate(sorted(fps))], "node long, fp long")
    got = {tuple(sorted((r.a, r.b))) for r in simhash.fingerprint_links(nodes, bits).collect()}
    order = sorted(fps)
    assert got == {(a, b) for b in range(len(order)) for a in range(b) if (order[a] ^ order[b]).bit_count() <= bits}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_of_fingerprints_are_not_broadcast(spark):
    """Spark takes 28 postings a node to be as small as the node."""
    nodes = spark.range(50).selectExpr("id AS node", "id * 7919 AS fp")
    links = simhash.fingerprint_links(nodes, 2)
    assert "Broadcast" not in plan(links) and "SortMergeJoin" in plan(links)


def test_postings_of_sketches_are_not_broadcast(docs, monkeypatch):
    """No exploded table of the similarity stage goes through the driver: lists of nodes, classes of sizes, members of a round."""
    plans, write = [], simhash.materialise
    monkeypatch.setattr(simhash, "materialise", lambda df, name: plans.append((name, plan(df))) or write(df, name))
    d = docs([(i, f"a b c d e f g h {i % 4}") for i in range(30)])
    texts = d.selectExpr("doc_id AS id", "text")
    simhash._unsettled(texts.selectExpr("id AS node", "explode(array(1L, 2L)) AS list"), None)
    pairs = simhash._rare_pairs(texts.selectExpr("id AS node", "id AS label", "true AS outside"), texts, 5, 0.8)
    assert [n for n, _ in plans] == ["postings", "crowd", "rare"] and "Broadcast" not in plans[0][1] + plan(pairs)
    plans.clear()
    simhash.similar_links(simhash.profiles(d, "doc_id", "text", 5).selectExpr("id AS node", "sketch").dropDuplicates(["sketch"]), texts, 5, 0.8)
    met = next(p for n, p in plans if n == "tallied")
    assert "SortMergeJoin [list" in met and "BroadcastHashJoin [list" not in met


def test_simhash_odd_rows(odd, docs):
    got = by_id(simhash.near_duplicates(odd, shingle=3, max_bits=2))
    assert [r.fp for i in (1, 2, 3, 7) for r in got[i]] == [0] * 4 and {r.component_id for i in (1, 2, 3, 7) for r in got[i]} == {1}
    assert len(got[4]) == 2 and got[4][0].component_id == 4 and len(got[None]) == 1
    assert simhash.near_duplicates(docs([])).count() == 0


def shingles_by_hand(text, k):
    words = WORD.findall(lower(text))
    return {" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def test_similar_documents_of_sample(data):
    """Components are those of all pairs that share 0.8 of their shingles, or 3 bits."""
    rows = {r.doc_id: r.text for r in data("documents").select("doc_id", "text").collect()}
    ids, sets = sorted(rows), {i: shingles_by_hand(t, 5) for i, t in rows.items()}
    fps = {i: fingerprint_by_hand(t, 5) for i, t in rows.items()}
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n]
             if (fps[a] ^ fps[b]).bit_count() <= 3 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = components(links, ids)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(data("documents")).collect()}
    assert got == want


def test_planted_copies(docs):
    """Copies with a few words changed at increasing numbers of places; unrelated texts and texts half alike stay apart."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, want = [], {}
    for g in range(20):
        base = [word() for _ in range(300)]
        for c in range(6):
            copy = list(base)
            for at in rng.sample(range(300), c):
                copy[at] = word()
            rows.append((10 * g + c, " ".join(copy)))
            want[10 * g + c] = 10 * g
        rows.append((10 * g + 9, " ".join(base[:150] + [word() for _ in range(150)])))
        want[10 * g + 9] = 10 * g + 9
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs(rows)).collect()}
    assert got == want


def test_copies_of_one_original_each_edited_on_its_own(docs):
    """Star families: every copy is 0.8 similar to the original, copies among each other are not."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, sets = [], {}
    for g, (copies, edits) in enumerate([(300, 6), (150, 5), (20, 6)]):
        base = [word() for _ in range(304)]
        for c in range(copies + 1):
            copy = list(base)
            start = rng.randrange(40)
            for at in range(start, start + 50 * edits, 50) if c != copies // 2 else ():
                copy[at % 304] = word()
            rows.append((1000 * g + c, " ".join(copy)))
            sets[1000 * g + c] = shingles_by_hand(rows[-1][1], 5)
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if a // 1000 == b // 1000 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(links) < 20 * len(ids)
    want = components(links, ids)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs(rows)).collect()}
    assert set(want.values()) == {0, 1000, 2000}
    assert [i for i in ids if got[i] != want[i]] == []


def edited(rng, words, edits):
    """Words with that many places replaced, deleted or added to, each by a word of a small vocabulary."""
    out = list(words)
    for _ in range(edits):
        i = rng.randrange(len(out))
        out[i:i + 1] = rng.choice([[f"v{rng.randrange(400)}"], [], [out[i], f"v{rng.randrange(400)}"]])
    return out


def test_crowds_are_not_compared_pair_by_pair(spark, docs, monkeypatch):
    """Copies edited so much that most are similar to none, some only to an edited one: all links, few pairs."""
    rng = random.Random(17)
    base = [f"w{i}" for i in range(150)]
    texts = [base] + [edited(rng, base, rng.randrange(1, 9)) for _ in range(400)]
    texts += [edited(rng, rng.choice(texts[1:]), rng.randrange(1, 3)) for _ in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [shingles_by_hand(t, 5) for _, t in rows]
    want = components([(a, b) for b in range(len(rows)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])], range(len(rows)))
    compared, tallied = [], simhash._tallied

    def counted(pairs, nodes, least):
        compared.append(pairs.count())
        return tallied(pairs, nodes, least)

    monkeypatch.setattr(simhash, "_tallied", counted)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs(rows)).collect()}
    alone = sum(n == 1 for n in Counter(want.values()).values())
    assert alone > 100 and got == want
    assert sum(compared) < alone * len(rows) / 2


@pytest.mark.parametrize("similarity", [0.5, 0.8, 1.0])
def test_rare_shingles_lose_no_pair(docs, similarity):
    rng = random.Random(int(similarity * 10))
    base = [f"w{i}" for i in range(60)]
    texts = [edited(rng, base[:rng.randrange(8, 61)], rng.randrange(0, 4)) for _ in range(150)] + [base[:n] for n in (0, 1, 4, 5, 6, 7, 50, 60)]
    rows = [(i, " ".join(t).upper()) for i, t in enumerate(texts)]
    sets = [shingles_by_hand(t, 5) for _, t in rows]
    members = [(i, rng.choice([i, -1]), rng.random() < 0.7) for i in range(len(rows))]
    want = {(a, b) for b in range(len(rows)) for a in range(b)
            if sets[a] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) and members[a][1] != members[b][1] and (members[a][2] or members[b][2])}
    d = docs(rows)
    got = simhash._rare_pairs(d.sparkSession.createDataFrame(members, "node long, label long, outside boolean"),
                              d.select(d.doc_id.alias("id"), "text"), 5, similarity).collect()
    assert len(want) >= 10 and want <= {(r.a, r.b) for r in got} and len(got) == len(set(got))
    assert all(members[r.a][1] != members[r.b][1] for r in got)


def test_members_of_a_round_are_made_once(spark):
    """Spark may share the work between the two readers by itself; here it need not."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    posts = spark.range(24).selectExpr("id % 3 AS list", "id AS node").mapInArrow(counted, "list long, node long")
    labels = spark.createDataFrame([(i, 0, 2) for i in range(0, 24, 3)] + [(1, 4, 1), (4, 4, 1)], "node long, label long, degree long")
    got = simhash._unsettled(posts, labels)
    assert seen.value == 24
    assert Counter((r.list, r.top, r.outside) for r in got.collect()) == {(1, 4, 6): 8, (2, 23, 7): 8}


def test_equal_fingerprints_of_different_texts_are_no_link(docs):
    """A cycle repeated over most of a text decides the fingerprint; only texts that share their shingles are copies."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    cycle = [word() for _ in range(9)]
    rows = [(i, " ".join(cycle * 75 + [word() for _ in range(300)])) for i in range(8)]
    rows += [(20, " ".join(rows[3][1].split() + [word()])), (21, rows[4][1])]
    assert len({fingerprint_by_hand(t, 5) for _, t in rows}) == 1
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs(rows)).collect()}
    assert got == {**{i: i for i in range(8)}, 20: 3, 21: 4}


def test_similar_documents_odd_rows(odd, docs):
    got = by_id(simhash.similar_documents(odd))
    assert {r.component_id for i in (1, 2, 3, 7) for r in got[i]} == {1}
    assert len(got[4]) == 2 and got[4][0].component_id == 4 and len(got[None]) == 1
    assert simhash.similar_documents(docs([])).count() == 0


def test_components_of_a_long_chain(spark):
    rng = random.Random(1)
    names = rng.sample(range(10_000), 700)
    pairs = [(names[i], names[i + 1]) for i in range(600)] + [(names[650], names[i]) for i in range(660, 700)] + [(5, 5)]
    rng.shuffle(pairs)
    edges = spark.createDataFrame([*pairs, (None, 3)], "a long, b long").repartition(7)
    want = components([p for p in pairs if p[0] != p[1]], {x for p in pairs if p[0] != p[1] for x in p})
    assert {r.node: r.root for r in connected_components(edges, "a", "b").collect()} == want
    assert connected_components(edges.limit(0), "a", "b").count() == 0


# passages

def passages_by_hand(rows, window):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for p in range(len(w) - window + 1):
                key = tuple(w[p:p + window])
                first[key] = min(first.get(key, i), i)
    out = Counter()
    for i, w in words:
        gone = set()
        for p in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[p:p + window])] < i:
                gone |= set(range(p, p + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[(i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())] += 1
    return out


def test_passages_of_sample(data):
    rows = [(r.doc_id, r.text) for r in data("documents").select("doc_id", "text").collect()]
    got = queries.RUNS["op7_substring_dedup"](data("documents").sparkSession, DATA)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == passages_by_hand(rows, 50)


@pytest.mark.parametrize("window,period", [(8, 5), (10, 7), (6, 6)])
def test_passages_by_hand(docs, window, period):
    rng = random.Random(window)
    rows = []
    for i in range(60):
        parts = [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 30))]
        for _ in range(rng.randrange(0, 3)):
            if rows:
                w = WORD.findall(rng.choice(rows)[1] or "")
                at = rng.randrange(0, max(1, len(w)))
                cut = rng.randrange(0, len(parts) + 1)
                parts[cut:cut] = w[at:at + rng.randrange(1, 20)]
        rows.append((i * 3, " ".join(parts)))
    rows += [(200, rows[5][1]), (201, "\t" + rows[5][1].replace(" ", "\n ")), (300, None), (301, ""), (None, rows[7][1]), (400, rows[8][1] * 3), (400, rows[8][1] * 3)]
    got = substring_dedup.repeated_passages(docs(rows), window=window, period=period).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == passages_by_hand(rows, window)
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in got)


def test_passages_of_an_empty_table(docs):
    assert substring_dedup.repeated_passages(docs([])).count() == 0


@pytest.mark.parametrize("v", [1, 2, 5, 7, 13, 31])
def test_difference_cover(v):
    d = substring_dedup.difference_cover(v)
    assert {(a - b) % v for a in d for b in d} == set(range(v)) and len(d) <= 2 * v ** 0.5 + 1


# vectors

def vectors_by_hand(rows, cosine):
    def unit(v):
        v = np.array(v, float) / max(map(abs, v))
        return v / np.linalg.norm(v)

    ok = {i: (lab, unit(v)) for i, v, lab in rows
          if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a in ok for b in ok if a < b and ok[a][0] == ok[b][0] and len(ok[a][1]) == len(ok[b][1]) and ok[a][1] @ ok[b][1] >= cosine]
    n = Counter(x for p in links for x in p)
    root = components(links, [r[0] for r in rows])
    return {(i, n[i], root[i], root[i] == i) for i, _, _ in rows}


def test_vectors_of_sample(data):
    rows = [(r.vec_id, r.embedding, r.label) for r in data("embeddings").collect()]
    got = queries.RUNS["op4_embedding_dedup"](data("embeddings").sparkSession, DATA)
    assert {tuple(r) for r in got.collect()} == vectors_by_hand(rows, 0.93)


def test_vectors_by_hand(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(12, 10))
    rows = [(i, (centers[i % 12] + rng.normal(size=10) * 0.25).tolist(), int(i % 3)) for i in range(400)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(5)] + [(1100, [x * 1e200 for x in rows[0][1]], 0), (1101, [3.0, 4.0], 1), (1102, [6.0, 8.1], 1)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 10, 1), (2003, [None] + [1.0] * 9, 1), (2004, [float("nan")] * 10, 1), (2005, [float("inf")] + [1.0] * 9, 1),
             (2006, rows[1][1], None)]
    df = spark.createDataFrame([(*r, 7.0) for r in rows], "vec_id long, embedding array<double>, label int, n double")
    got = embedding_dedup.near_vectors(df, cosine=0.9, block=16, sample_rows=100).collect()
    assert {tuple(r) for r in got} == vectors_by_hand(rows, 0.9) and len(got) == len(rows)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0
