"""Registered queries of the operators, next to their SQL twins where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import byte_bpe, conversation_repair, embedding_dedup, exact_dedup, language_id, line_dedup, mixing, packing, quality, simhash, substring_dedup, token_alignment, toxicity
from gridloom.llm.common import read

RUNS = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        RUNS[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return keep


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = toxicity.fit(docs.select("doc_id", "text"), labels.where(~held_out).select("doc_id", "toxic"))
    scored = toxicity.toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


LINE_RATIO, LINE_PAGES = 0.1, 3


@query("op2_line_dedup", f"""
WITH parts AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents),
own AS (SELECT source, unnest(list_distinct(list_transform(parts, lambda x: trim(x, chr(32) || chr(9) || chr(13))))) AS line FROM parts WHERE source IS NOT NULL),
counts AS (SELECT source, line, count(*) AS n FROM own WHERE line <> '' GROUP BY 1, 2),
totals AS (SELECT source, count(*) AS n_all FROM documents GROUP BY 1),
found AS (SELECT c.source, list(c.line) AS lines FROM counts c JOIN totals t ON c.source = t.source
          WHERE c.n >= {LINE_PAGES} AND c.n > {LINE_RATIO}::DOUBLE * t.n_all GROUP BY 1),
cut AS (SELECT p.doc_id, p.source, p.text, p.parts, CASE WHEN f.lines IS NULL THEN p.parts
        ELSE list_filter(p.parts, lambda x: NOT list_contains(f.lines, trim(x, chr(32) || chr(9) || chr(13)))) END AS kept
        FROM parts p LEFT JOIN found f ON p.source = f.source)
SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(parts) END::INTEGER AS n_lines,
       CASE WHEN text IS NULL THEN 0 ELSE len(parts) - len(kept) END::INTEGER AS n_dropped,
       CASE WHEN text IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text
FROM cut
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs, "source", "text", LINE_RATIO, LINE_PAGES, "n_lines", "n_dropped").select("doc_id", "source", "n_lines", "n_dropped", "text")


@query("op3_simhash")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


@query("op4_embedding_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(read(spark, sf_dir, "embeddings"))


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages by markup, address and host; documents by declared language and source."""
    docs = read(spark, sf_dir, "documents")
    model = language_id.fit(docs, "lang", "text", "doc_id")
    none = F.lit(None).cast("string")
    pages = language_id.page_rows(read(spark, sf_dir, "pages")).select(
        F.lit("page").alias("kind"), F.lit(None).cast("long").alias("doc_id"), "page_id", "text", "declared", "suffix", "host", "parent")
    texts = docs.select(F.lit("document").alias("kind"), "doc_id", F.lit(None).cast("long").alias("page_id"), "text", F.col("lang").alias("declared"),
                        none.alias("suffix"), F.col("source").alias("host"), none.alias("parent"))
    return language_id.identify(pages.unionByName(texts), model)


CAPACITY = 2048


@query("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest stands for the ids in the result; it is taken of the ids where they are placed."""
    packed = packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=CAPACITY)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


@query("op7_substring_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op8_exact_dedup", """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


def grades(labels: DataFrame) -> DataFrame:
    """0 junk, 1 sound but toxic, 2 sound."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality").isNotNull(), 2).alias("grade"))


@query("op9_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, grades(read(spark, sf_dir, "labels")), 3)
    return quality.quality(docs, model).withColumn("selected", F.col("p_grade_1") >= 0.5)


MIX_LEVELS = ["domain", "lang", "source"]
MIX_WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 1}}
MIX_SEED, MIX_EPOCHS, MIX_BUDGET = 7, 2, (3, 5)


def with_domain(docs: DataFrame) -> DataFrame:
    """Sources are numbered; four domains share them out."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), r"([0-9]+)$", 1)
    return docs.withColumn("domain", F.when(number != "", F.concat(F.lit("d"), (number.cast("long") % 4).cast("string"))))


def _split_sql(depth: int) -> str:
    """One level of the tree in SQL: children of level `depth` get their part of the parent's budget."""
    path, up = MIX_LEVELS[:depth + 1], MIX_LEVELS[:depth]
    name = MIX_LEVELS[depth]
    cases = "".join(f" WHEN '{k}' THEN {v}" for k, v in MIX_WEIGHTS.get(name, {}).items())
    weight = f"CASE {name}{cases} ELSE 1 END" if cases else "1"
    part = f"PARTITION BY {', '.join(up)}" if up else ""
    budget = f"p.budget FROM nodes{depth} n JOIN split{depth - 1} p USING ({', '.join(up)})" if up else f"(SELECT sum(avail) * {MIX_BUDGET[0]} // {MIX_BUDGET[1]} FROM leaves) AS budget FROM nodes{depth} n"
    return f"""
nodes{depth} AS (SELECT {', '.join(path)}, sum(cap) AS cap, ({weight})::HUGEINT AS weight FROM leaves GROUP BY {', '.join(path)}),
b{depth} AS (SELECT n.*, {budget}),
o{depth} AS (SELECT *, coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest FROM b{depth}
  WINDOW w AS ({part} ORDER BY cap::DOUBLE / weight::DOUBLE, {name})),
f{depth} AS (SELECT *, cap * w_rest <= weight * (budget - before) AS is_full FROM o{depth}),
s{depth} AS (SELECT *, budget - coalesce(sum(CASE WHEN is_full THEN cap END) OVER ({part}), 0) AS left_over,
  sum(CASE WHEN NOT is_full THEN weight END) OVER ({part}) AS w_open FROM f{depth}),
split{depth} AS (SELECT {', '.join(path)}, CASE WHEN is_full THEN cap ELSE (left_over * weight) // w_open END AS budget FROM s{depth}),"""


MIX_SQL = rf"""
WITH rows AS (SELECT doc_id, coalesce(CASE WHEN num <> '' THEN 'd' || (num::BIGINT % 4)::VARCHAR END, '{mixing.NONE}') AS domain, coalesce(lang, '{mixing.NONE}') AS lang,
  coalesce(source, '{mixing.NONE}') AS source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::HUGEINT AS n_tokens
  FROM (SELECT *, regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) AS num FROM documents)),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS avail, sum(n_tokens) * {MIX_EPOCHS} AS cap FROM rows GROUP BY 1, 2, 3),{_split_sql(0)}{_split_sql(1)}{_split_sql(2)}
plan AS (SELECT l.domain, l.lang, l.source, CASE WHEN avail > 0 THEN budget // avail ELSE 0 END AS epochs, CASE WHEN avail > 0 THEN budget % avail ELSE 0 END AS rest
  FROM leaves l JOIN split2 s USING (domain, lang, source)),
keyed AS (SELECT r.*, p.epochs, p.rest, md5('{MIX_SEED}:' || p.epochs::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '')) AS key FROM rows r JOIN plan p USING (domain, lang, source)),
placed AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM keyed)
SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens, (epochs + CASE WHEN before < rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM placed
"""


def mixture(docs: DataFrame) -> DataFrame:
    counted = with_domain(docs).select("doc_id", *MIX_LEVELS, mixing.n_words(F.col("text")).alias("n_tokens"))
    return mixing.mix(counted, MIX_LEVELS, weights=MIX_WEIGHTS, budget=MIX_BUDGET, max_epochs=MIX_EPOCHS, seed=MIX_SEED)


@query("op10_mixing", MIX_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(read(spark, sf_dir, "documents"))


@query("op11_conversation_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that lost all rows are there too."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = conversation_repair.repair(conversation_repair.damage(rows)).withColumnRenamed("conv_id", "_found")
    every = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_found")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


@query("op12_byte_bpe")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.decode(byte_bpe.encode(read(spark, sf_dir, "documents"), ranks), ranks)
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
