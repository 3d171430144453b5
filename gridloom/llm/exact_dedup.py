"""Exact duplicates by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its content says so: after a line break or the space behind
a punctuation mark, at the first such place at least `low` characters into the
chunk and at most `high`. The recipe of a text is the ordered list of its chunk
identifiers, and two texts are equal exactly when their recipes are.

A chunk's identifier is its 64-bit hash, verified: all distinct chunk texts are
grouped once, and where two texts share a hash, every text but the smallest gets
a number of its own, which goes into the recipes that use it. So each distinct
chunk moves once and documents never move: what is grouped and joined
afterwards are recipes (8 bytes per chunk).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import lower_ascii
from gridloom.session import materialise


def chunk_pattern(low: int, high: int) -> str:
    return rf"(?s).{{{low},{high}}}?(?<=\n|[.!?;:,] )|.{{1,{high}}}"


def normalised(text: Column) -> Column:
    return lower_ascii(F.coalesce(text, F.lit("")))


def chunks_of(text: Column, low: int, high: int) -> Column:
    return F.regexp_extract_all(text, F.lit(chunk_pattern(low, high)), F.lit(0))


def chunk_id(chunk: Column, bits: int) -> Column:
    h = F.xxhash64(chunk)
    return h if bits == 64 else F.shiftrightunsigned(h, 64 - bits)


def recipes(docs: DataFrame, id_col: str, text_col: str, low: int, high: int, bits: int) -> DataFrame:
    """(id, text_sha256, recipe, twins): `twins` lists chunks that share their hash with a smaller text, as (place, number)."""
    text = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("t"))
    chunked = text.select("id", F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"), chunks_of(F.col("t"), low, high).alias("c"))
    plain = materialise(chunked.select("id", "text_sha256", F.transform("c", lambda c: chunk_id(c, bits)).alias("recipe")), "recipes")
    single = text.select(F.explode(chunks_of(F.col("t"), low, high)).alias("chunk")).select(chunk_id(F.col("chunk"), bits).alias("h"), "chunk").distinct()
    distinct = materialise(single.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "twin-hashes")
    if distinct.isEmpty():
        return plain.withColumn("twins", F.lit(None).cast("array<struct<pos:int,k:int>>"))
    # Some hash stands for several texts: number them, and note the number at each place that uses one.
    numbered = single.join(distinct, "h").withColumn("k", F.row_number().over(Window.partitionBy("h").orderBy("chunk")) - 1).where("k > 0")
    placed = chunked.select("id", "text_sha256", F.posexplode("c").alias("pos", "chunk")).withColumn("h", chunk_id(F.col("chunk"), bits))
    places = placed.join(numbered, ["h", "chunk"]).groupBy("id", "text_sha256").agg(F.sort_array(F.collect_set(F.struct("pos", F.col("k").cast("int").alias("k")))).alias("twins"))
    key = [F.col("p.id").eqNullSafe(F.col("q.id")), F.col("p.text_sha256") == F.col("q.text_sha256")]
    return plain.alias("p").join(places.alias("q"), key, "left").select("p.id", "p.text_sha256", "p.recipe", "q.twins")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: int = 256, high: int = 4096, bits: int = 64) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row of `docs`.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    Of equal texts the row with the largest id stays. `group_size` counts rows,
    so a repeated row counts twice and, having the same id, stays or goes as one.
    A null id is smaller than any id; a group of null ids only has `keep_id` null
    and is kept. Other columns are not looked at; an empty table gives an empty
    table.
    """
    own = materialise(recipes(docs, id_col, text_col, low, high, bits), "own-recipes")
    # the hash of the recipe only spreads the join; the recipe itself is compared
    own = own.withColumn("rh", F.xxhash64("recipe"))
    key = ["rh", "recipe", "twins"]
    groups = materialise(own.groupBy(*key).agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "recipe-groups")
    same = (F.col("d.rh") == F.col("g.rh")) & (F.col("d.recipe") == F.col("g.recipe")) & F.col("d.twins").eqNullSafe(F.col("g.twins"))
    return own.alias("d").join(groups.alias("g"), same).select(
        F.col("d.id").alias(id_col), "g.keep_id", "g.group_size", F.col("d.id").eqNullSafe(F.col("g.keep_id")).alias("kept"), "d.text_sha256")
