"""From raw documents to packed training sequences, one stage after another.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; all but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import line_dedup, packing, quality, queries, simhash
from gridloom.llm.common import read, small_batches
from gridloom.session import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_junk(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay that reach at least grade 1 more likely than not; the model is fitted on the rated ones among them.

    A null or empty text has the grade of a text without terms; repeated rows are kept or dropped together.
    """
    model = quality.fit(docs.select("doc_id", "text"), queries.grades(read(spark, sf_dir, "labels")), 3)
    rated = quality.quality(docs.select(*COLUMNS), model, keep_text=True)
    return rated.where("p_grade_1 >= 0.5").select(*COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that more than a tenth of a source's documents hold go; documents stay, with their length counted anew."""
    out = line_dedup.drop_boilerplate(docs.select(*COLUMNS), "source", "text", queries.LINE_RATIO, queries.LINE_PAGES)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (0.8 of all shingles of five words) stays.

    Rows that share this id all stay, as do rows without an id: nothing names one of them.
    """
    found = simhash.similar_documents(docs, shingle=5, similarity=0.8)
    gone = materialise(found.where("doc_id > component_id").select("doc_id").distinct(), "near-copies")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mixture takes them."""
    taken = materialise(queries.mixture(docs).where("copies > 0").groupBy("doc_id").agg(F.max("copies").cast("int").alias("copies")), "mixture")
    taken = taken.withColumnRenamed("doc_id", "_id")
    times = docs.join(taken, F.col("doc_id").eqNullSafe(F.col("_id"))).withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return times.select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=queries.CAPACITY, table_words=1 << 16)


STAGES = [
    ("quality classifier", drop_junk),
    ("line dedup", drop_boilerplate),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Neither the classifier nor XXH64 can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
