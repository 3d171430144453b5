"""Classifiers by held-out accuracy, packing by round trip, the pipeline stage by stage."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from by_hand import DATA, by_id

import corpus_pipeline
from gridloom.llm import language_id, packing, quality, queries, terms, toxicity

SMALL = "/root/testdata/sf0.001"
TOKENS = public_tokenizers.path("word_bpe_49k.json")


def rated(data, column):
    return {r.doc_id: r[column] for r in data("labels").collect() if r[column] is not None}


def test_toxicity_of_held_out_documents(spark, data):
    got, toxic = by_id(queries.RUNS["op1_toxicity"](spark, DATA)), rated(data, "toxic")
    assert sorted(got) == sorted(r.doc_id for r in data("documents").select("doc_id").collect())
    for i, (r,) in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(toxic[i], r.predicted) for i, (r,) in got.items() if r.held_out and i in toxic]
    assert len(held) > 20 and np.mean([a == b for a, b in held]) >= 0.95


def test_machine_learns_what_words_mean_together(docs, spark):
    """Either word alone is harmless; both together are not."""
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(1200):
        a, b = rng.random(2) < 0.5
        rows.append((i, " ".join(["calm"] + ["vermin"] * int(a) + ["neighbours"] * int(b) + [f"w{x}" for x in rng.integers(0, 20, 5)])))
        labels.append((i, int(a and b)))
    model = toxicity.fit(docs(rows), spark.createDataFrame(labels, "i long, y int"), epochs=60)
    got = by_id(toxicity.toxicity(docs([(1, "calm vermin"), (2, "calm neighbours"), (3, "calm vermin neighbours")]), model))
    assert [got[i][0].score > 0.5 for i in (1, 2, 3)] == [False, False, True]


def test_terms_that_tell_only_together(docs, spark):
    """Neither word says anything alone: the label is that exactly one of them is there."""
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(2400):
        a, b = rng.random(2) < 0.5
        rows.append((i, " ".join(["calm"] + ["vermin"] * int(a) + ["neighbours"] * int(b) + [f"w{x}" for x in rng.integers(0, 200, 8)])))
        labels.append((i, int(a != b)))
    known = spark.createDataFrame(labels[:1200], "i long, y int")
    got = by_id(toxicity.toxicity(docs(rows[1200:]), toxicity.fit(docs(rows[:1200]), known)))
    assert np.mean([(got[i][0].score >= 0.5) == bool(y) for i, y in labels[1200:]]) >= 0.95
    alone = toxicity.fit(docs(rows[:1200]), known, pair_terms=0)
    assert len(alone.active) < 3


def test_pairs_of_independent_terms_tell_nothing():
    rng = np.random.default_rng(6)
    held = [np.flatnonzero(rng.random(60) < 0.3) for _ in range(2000)]
    noise = rng.integers(0, 2, 2000)
    assert not terms.telling_pairs(held, noise, 60, 60.0).any()
    pair = np.array([int((3 in set(h.tolist())) != (8 in set(h.tolist()))) for h in held])
    assert np.flatnonzero(terms.telling_pairs(held, pair, 60, 60.0)).tolist() == [3, 8]


def test_quality_of_rated_documents(spark, data):
    got, good = by_id(queries.RUNS["op9_quality"](spark, DATA)), rated(data, "quality")
    assert len(got) == data("documents").count()
    assert all(len(rs) == 1 and rs[0].p_grade_1 >= rs[0].p_grade_2 for rs in got.values())
    assert np.mean([got[i][0].selected == bool(q) for i, q in good.items() if i in got]) >= 0.95


@pytest.mark.parametrize("rates", [[], [(4, 1)], [(4, 0), (7, 1), (None, 1), (5, None)]])
def test_classifiers_and_odd_rows(spark, docs, odd, rates):
    labels = spark.createDataFrame(rates, "doc_id long, grade int")
    for model, apply in ((toxicity.fit(odd, labels), toxicity.toxicity), (quality.fit(odd, labels, 2), quality.quality)):
        got = apply(odd, model)
        assert got.count() == odd.count() and got.columns[:2] == ["doc_id", "id"] and "text" not in got.columns
        assert not any(np.isnan(r[-1]) for r in got.collect()) and apply(docs([]), model).count() == 0


def test_long_words_are_read_whole():
    assert terms.shape_terms(b"aB1" * 400_000 + b"!!")[1] == b"s" + b"xX0" * 400_000 + b"!!"
    word = ("\u4eca\u65e5\u306f" * 3000).encode()
    assert b"".join(language_id.parts(word)) == word and max(map(len, language_id.parts(word))) <= 160
    assert language_id.parts(b"Word,") == [b"word"]


def test_sample_takes_a_row_for_each_id(spark, docs):
    table = docs([(1, f"copy {i}") for i in range(300)] + [(2, "two"), (3, None), (None, "none")])
    rates = spark.createDataFrame([(1, 0), (1, 2), (2, 1), (3, 1), (None, 1)], "i long, y int")
    got = terms.sample(table, rates, "doc_id", "text", 10).collect()
    assert sorted((r.text or "", r.rating) for r in got) == [("", 1), ("copy 99", 2), ("two", 1)]


def test_scores_keep_the_text_and_replace_clashing_columns(spark, odd):
    labels = spark.createDataFrame([(4, 0), (5, 1)], "doc_id long, grade int")
    model = quality.fit(odd, labels, 3)
    clash = odd.selectExpr("*", "'old' as p_grade_1", "'old' as expected_grade")
    got = quality.quality(clash, model, keep_text=True)
    assert got.columns[0] == "text" and got.schema["p_grade_1"].dataType.simpleString() == "double"
    assert sorted(str(r.text) for r in got.collect()) == sorted(str(r.text) for r in odd.collect())


def test_many_languages(spark):
    rows = [(100 * k + i, f"l{k:02}", " ".join(chr(0x4E00 + 40 * k + j) * 3 for j in range(i, i + 12))) for k in range(70) for i in range(4)]
    table = spark.createDataFrame([*rows, *[(5, "l00", rows[5][2])] * 20, (None, "zz", "none")], "id long, lang string, text string")
    model = language_id.fit(table, "lang", "text", "id")
    assert model.languages == [f"l{k:02}" for k in range(70)]
    with pytest.raises(ValueError):
        language_id.fit(table, "lang", "text", "id", most_languages=69)


def test_language_of_a_text_without_blanks(spark):
    chinese = "".join(chr(0x4E00 + i * 7 % 900) for i in range(800))
    greek = "".join(chr(0x3B1 + i * 5 % 24) for i in range(800))
    table = spark.createDataFrame([(1, "zh", chinese), (2, "el", greek)], "id long, lang string, text string")
    model = language_id.fit(table, "lang", "text", "id")
    mixed = spark.createDataFrame([(1, greek[:45] + chinese), (2, chinese[:45] + greek)], "id long, text string")
    found = {r.id: r.lt for r in language_id.text_evidence(mixed, model, "text").collect()}
    assert model.languages == ["el", "zh"] and found[1][1] > found[1][0] and found[2][0] > found[2][1]


def test_language_of_documents(spark, data):
    """Declared languages, and whatever the pages hold: every row once."""
    got = queries.RUNS["op5_language_id"](spark, DATA)
    language = next(c for c in ("language", "lang", "predicted") if c in got.columns)
    rows = by_id(got.where("kind = 'document'").select("doc_id", language))
    lang = {r.doc_id: r.lang for r in data("documents").select("doc_id", "lang").collect()}
    assert sorted(rows) == sorted(lang) and all(len(rs) == 1 for rs in rows.values())
    assert np.mean([rows[i][0][1] == x for i, x in lang.items() if x is not None]) >= 0.97
    assert got.where("kind = 'page'").count() == data("pages").count()


def check_sequences(rows, capacity):
    """Every sequence is filled from 0 without gaps, up to its capacity."""
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        held.sort()
        assert [o for o, _ in held] == [0, *np.cumsum([n for _, n in held])[:-1].tolist()] and sum(n for _, n in held) <= capacity
    return len(places)


def test_packing_round_trip(data):
    from tokenizers import Tokenizer

    rows = packing.pack(data("documents"), TOKENS).collect()
    n = check_sequences(rows, 2048)
    assert n <= 1.01 * np.ceil(sum(r.length for r in rows) / 2048) + 1
    tokenizer, held = Tokenizer.from_file(TOKENS), defaultdict(dict)
    for r in rows:
        assert r.length == len(r.ids) // 4 and r.start == 2048 * r.piece
        held[r.doc_id][r.piece] = np.frombuffer(r.ids, "<u4").tolist()
    for r in data("documents").select("doc_id", "text").collect():
        want = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        assert sum((held[r.doc_id][k] for k in sorted(held[r.doc_id])), []) == want
        assert all(len(held[r.doc_id][k]) == 2048 for k in sorted(held[r.doc_id])[:-1])


def test_equal_documents_do_not_share_a_group(docs, monkeypatch):
    sizes = []
    placed = packing.place
    monkeypatch.setattr(packing, "place", lambda cut, *a: sizes.append(placed(cut, *a)) or sizes[-1])
    out = packing.pack(docs([(1, "the same text")] * 3000), TOKENS, group_rows=100)
    assert out.select("sequence_id", "offset").distinct().count() == 3000
    groups = sizes[0].selectExpr("sequence_id >> 32 as g").groupBy("g").count().collect()
    assert len(groups) == 30 and max(r["count"] for r in groups) < 200


def test_packing_odd_rows(odd, docs):
    rows = packing.pack(odd, TOKENS, capacity=64, digest=True).collect()
    check_sequences(rows, 64)
    assert sum(r.doc_id == 4 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    assert {r.length for r in rows if r.doc_id in (1, 2, 3, 7)} == {1}
    assert packing.pack(docs([]), TOKENS).count() == 0


def test_packed_ids_are_returned(data, odd):
    """The ids come with their place, digest or not, in the pipeline's last stage too; op6 names them by their CRC-32."""
    spark = data("documents").sparkSession
    last = corpus_pipeline.pack_sequences(spark, data("documents").limit(50), DATA)
    assert "ids" in last.columns and all(r.length == len(r.ids) // 4 > 0 for r in last.collect())
    rows = packing.pack(odd, TOKENS, capacity=64, digest=True).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows) and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    op6 = queries.RUNS["op6_packing"](spark, DATA)
    assert op6.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_pipeline_stages(spark):
    """Every stage keeps rows of the one before; the last places each of them once."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, sorted(r.doc_id for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).cache()
        now = sorted(r.doc_id for r in docs.collect())
        assert docs.columns == columns and now and set(now) <= set(before), name
        if "mixing" not in name:
            assert len(now) == len(set(now)), name
        before = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    check_sequences(packed, queries.CAPACITY)
    assert sorted(r.doc_id for r in packed if r.piece == 0) == before
