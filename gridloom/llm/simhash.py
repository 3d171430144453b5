"""Near-duplicate documents by SimHash and a byte-position inverted index.

A 64-bit fingerprint has eight bytes at eight positions. Two fingerprints that
differ in at most `k` bits differ in at most `k` bytes, so they share at least
`8 - k` positional bytes. A posting list per single byte would hold 1/256 of all
fingerprints and its pairs would grow with the square of the corpus; the index
therefore posts each fingerprint under every choice of `8 - k` positions with
the bytes found there (28 postings for k = 2). Two fingerprints meet in a list
exactly when their tally of shared positional bytes reaches the guaranteed
minimum, so the lists lose no link and hardly any list holds more than links.
The tally is still counted per pair and the differing bits are verified.

Equal fingerprints are one node of the index, whatever their number; a document
finds its class through its fingerprint.

Copies that share 0.8 of their shingles differ in about 10 of 64 bits, for which no
byte is guaranteed to be shared. `similar_documents` therefore adds a second sketch
to the same kind of index: 120 positional bytes, each the low byte of the smallest
value of its own hash over a text's shingles. Two texts share a byte as often as
their sets of shingles overlap, so a tally of positional bytes is proportional to
the similarity. Lists are keyed by six bytes each; what the tally retains is
verified by the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import as_bytes, each_bytes, map_batches, map_texts
from gridloom.llm.components import connected_components
from gridloom.session import materialise

BYTES = 8
SEED = 42
_BLOCK = 1 << 15

#: Positional bytes of a sketch, and how many of them key a list.
SKETCH, ROWS = 120, 6
_SCALE = np.random.default_rng(SEED).integers(0, 1 << 32, SKETCH, np.uint32) | np.uint32(1)
_SHIFT = np.random.default_rng(SEED + 1).integers(0, 1 << 32, SKETCH, np.uint32)

#: A list with more members is a crowd; it goes to the rare shingles after so many rounds.
CROWD, ROUNDS = 64, 3
#: Ratio of the sizes within a class of sizes.
_CLASS = 1 + 1 / 32


def shingle_hashes(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of all shingles of a text in blocks, repeats included; none for a text without words."""
    words = text.lower().split()
    n = max(1, len(words) - shingle + 1) if words else 0
    parts = map(b" ".join, zip(*(islice(words, i, None) for i in range(shingle)))) if len(words) >= shingle else iter([b" ".join(words)])
    for _ in range(0, n, _BLOCK):
        yield np.fromiter(map(xxhash.xxh64_intdigest, islice(parts, _BLOCK), repeat(SEED)), "<u8")


def majority(blocks: Iterable[np.ndarray]) -> int:
    """Bitwise majority of hashes as a signed 64-bit number; 0 without hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in blocks:
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint(text: bytes, shingle: int) -> int:
    """Bitwise majority of the XXH64 of all shingles, repeats included, as a signed 64-bit number.

    Fewer words than a shingle: the whole sequence is the only shingle. No words: 0.
    """
    return majority(shingle_hashes(text, shingle))


def sketch(blocks: Iterable[np.ndarray]) -> bytes | None:
    """The positional bytes of a set of hashes; none without hashes."""
    least = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    some = False
    for hashes in blocks:
        some = True
        low = hashes.astype(np.uint32)
        for at in range(0, len(low), 1024):
            least = np.minimum(least, (_SCALE[:, None] * low[None, at:at + 1024] + _SHIFT[:, None]).min(1))
    return least.astype(np.uint8).tobytes() if some else None


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 5) -> DataFrame:
    """(id, fp) for every row; null text counts as empty."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(t, shingle) for t in as_bytes(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])
    return map_texts(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id long, fp long", run)


def _shuffled(df: DataFrame) -> DataFrame:
    """The same for a join that is to shuffle it.

    Spark takes an exploded table to be as small as the one it was made from, and
    columns that compress well to be as small as their file: it would send
    millions of postings through the driver to broadcast them.
    """
    return df.hint("merge")


def fingerprint_links(nodes: DataFrame, max_bits: int) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints differ in at most `max_bits` bits.

    `nodes` is (node, fp) with distinct fingerprints. A pair that shares more
    bytes than the minimum meets in several lists and comes out of each.
    """
    least = BYTES - max_bits
    masks = [sum(255 << 8 * i for i in chosen) for chosen in combinations(range(BYTES), least)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    lists = F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(signed)])
    posts = _shuffled(nodes.select("node", "fp", F.inline(lists)))
    x, y = posts.alias("x"), posts.alias("y")
    differ = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    tally = sum((differ.bitwiseAND(F.lit((255 << 8 * i) - (1 << 64) if i == 7 else 255 << 8 * i).cast("long")) == 0).cast("int") for i in range(BYTES))
    return x.join(y, (F.col("x.c") == F.col("y.c")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp"))
                  & (tally >= least) & (F.bit_count(differ) <= max_bits)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, max_bits: int = 3) -> DataFrame:
    """(id, fp, component_id) for every row of `docs`.

    `component_id` is the smallest id reachable over links, its own included.
    Null text counts as empty; empty texts share fingerprint 0 and are linked
    like any other. A repeated row comes out as often as it goes in. A row with
    a null id gets the component of its fingerprint, null if it has none. Other
    columns are not looked at; an empty table gives an empty table.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = materialise(fps.groupBy("fp").agg(F.min("id").alias("node")), "fp-nodes")
    linked = fingerprint_links(nodes.where("node is not null"), max_bits)
    roots = connected_components(linked, "a", "b")
    classes = materialise(nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id")), "fp-classes")
    return fps.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def profiles(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, fp, sketch) for every row; null text counts as empty, an empty text has no sketch."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps, sketches = [], []
        for text in each_bytes(batch.column(1)):
            blocks = list(shingle_hashes(text, shingle))
            fps.append(majority(blocks))
            sketches.append(sketch(blocks))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), pa.array(sketches, pa.binary())], ["id", "fp", "sketch"])
    return map_texts(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id long, fp long, sketch binary", run)


def _least_shared(similarity: float) -> int:
    """Positional bytes that two sketches of that similarity share, but for one pair in some thousands."""
    return int(SKETCH * similarity - 3.5 * (SKETCH * similarity * (1 - similarity)) ** 0.5)


def _tallied(pairs: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """Of pairs (a, b) those whose sketches share at least `least` positional bytes."""
    held = nodes.select("node", "sketch")
    both = pairs.join(held.toDF("a", "sa"), "a").join(held.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sides = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SKETCH) for i in (2, 3)]
        return batch.select(["a", "b"]).filter(pa.array((sides[0] == sides[1]).sum(1) >= least))
    return map_texts(both, "a long, b long", run)


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Of pairs (a, b) those whose sets of shingles overlap by at least `similarity`; `texts` is (id, text)."""
    # written, so that the join knows how few they are: it need not shuffle all texts to find theirs
    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "pair-ids")
    held = texts.select("id", "text").join(ids, "id", "left_semi").groupBy("id").agg(F.max("text").alias("text"))
    both = pairs.join(held.toDF("a", "ta"), "a").join(held.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")

    def shingles(text: bytes) -> set[int]:
        return {h for block in shingle_hashes(text, shingle) for h in block.tolist()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = b"", shingles(b"")
        for batch in batches:
            keep = []
            for ta, tb in zip(each_bytes(batch.column(2)), each_bytes(batch.column(3))):
                if ta != last:
                    last, x = ta, shingles(ta)
                y = shingles(tb)
                keep.append(len(x & y) >= similarity * len(x | y))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return map_batches(both, run, "a long, b long")


def _shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, size, h): the set of shingles of each text of (id, text), and how many they are."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), each_bytes(batch.column(1))):
                held = np.unique(np.concatenate([np.zeros(0, "<u8"), *shingle_hashes(text, shingle)])).view("<i8")
                for at in range(0, len(held), _BLOCK):
                    part = held[at:at + _BLOCK]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), x)) for x in (node, len(held))] + [pa.array(part)], ["node", "size", "h"])
    return map_batches(texts, run, "node long, size long, h long")


def _rare_pairs(members: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of members with different labels, one of them outside, without losing one that overlaps by `similarity`.

    `members` is (node, label, outside). Two sets of x and y shingles overlap by
    `similarity` when they share `similarity / (1 + similarity)` of x + y. Both
    are put in one order, the rarest shingle first: so many shingles must then
    follow the first shared one in either set, itself included, which places it
    among the first of both. Members are therefore joined on these few, which
    are mostly held by one member alone, not on what the crowd has in common.
    How few depends on the other's size: the larger set of a pair is posted for
    each class of sizes that the smaller may have.
    """
    part = similarity / (1 + similarity)
    ids = materialise(members.groupBy("node").agg(F.max("label").alias("label"), F.max("outside").alias("outside")), "crowd")
    held = texts.select("id", "text").join(ids.select(F.col("node").alias("id")), "id", "left_semi").groupBy("id").agg(F.max("text").alias("text"))
    sets = _shingle_sets(held, shingle).withColumn("holders", F.count(F.lit(1)).over(Window.partitionBy("h")))
    sets = sets.withColumn("left", F.col("size") + 1 - F.row_number().over(Window.partitionBy("node").orderBy("holders", "h")))
    # the smallest size that the other can have leaves the most to be looked up
    first = sets.where((F.col("holders") > 1) & (F.col("left") >= part * (1 + similarity) * F.col("size") - 1e-6)).select("node", "size", "h", "left")
    first = materialise(first.join(ids, "node"), "rare")

    def size_class(size: Column) -> Column:
        return F.floor(F.log(size) / F.log(F.lit(_CLASS))).cast("int")
    size, left = F.col("size"), F.col("left")
    small = first.where(left >= 2 * part * size - 1e-6).withColumn("class", size_class(size))
    least = F.greatest(F.lit(1), F.floor(similarity * size - 1e-6))
    large = first.withColumn("class", F.explode(F.sequence(size_class(least), size_class(size))))
    large = large.where(left >= part * (size + F.greatest(least, F.floor(F.pow(F.lit(_CLASS), F.col("class"))) - 1)) - 1e-6)
    x, y = _shuffled(small).alias("x"), _shuffled(large).alias("y")
    both = (F.col("x.h") == F.col("y.h")) & (F.col("x.class") == F.col("y.class")) & (F.col("x.size") <= F.col("y.size")) & (F.col("x.label") != F.col("y.label"))
    both &= F.least("x.left", "y.left") >= part * (F.col("x.size") + F.col("y.size")) - 1e-6
    met = x.where("outside").join(y, both).select("x.node", F.col("y.node").alias("other")).unionByName(
        x.where("not outside").join(y.where("outside"), both).select("x.node", F.col("y.node").alias("other")))
    return met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _unsettled(posts: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(list, node, label, degree, top, outside, members) of lists whose members have several labels.

    `top` is the label most members of a list have, `outside` counts those with another one.
    """
    if labels is None:
        held = posts.select("list", "node", F.col("node").alias("label"), F.lit(0).cast("long").alias("degree"))
        lists = held.groupBy("list").agg(F.max("node").alias("top"), (F.count(F.lit(1)) - 1).alias("outside"), F.count(F.lit(1)).alias("members"))
    else:
        # read twice below: written once, so that the joins that make it need not run for each reader
        held = materialise(posts.select("list", "node").join(labels, "node", "left").select(
            "list", "node", F.coalesce("label", "node").alias("label"), F.coalesce("degree", F.lit(0)).alias("degree")), "members")
        shares = held.groupBy("list", "label").agg(F.count(F.lit(1)).alias("n"))
        lists = shares.groupBy("list").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n")).select(
            "list", F.col("most.label").alias("top"), (F.col("n") - F.col("most.n")).alias("outside"), F.col("n").alias("members"))
    return materialise(_shuffled(held).join(lists.where("outside > 0"), "list"), "postings")


def _labels(found: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(node, label, degree) of all nodes with links: nodes of one label are connected, those connected get one label round by round."""
    both = found.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(found.select(F.col("b").alias("node"), F.col("a").alias("other")))
    known = labels.select("node", "label") if labels is not None else both.select("node", F.col("node").alias("label")).limit(0)
    for _ in range(2):
        near = both.join(known.toDF("other", "label"), "other", "left").groupBy("node").agg(
            F.min(F.coalesce("label", "other")).alias("least"), F.count(F.lit(1)).alias("degree"))
        labels = near.join(known, "node", "left").select("node", F.least("least", F.coalesce("label", "node")).alias("label"), "degree")
        known = labels.select("node", "label")
    return materialise(labels, "labels")


def similar_links(nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Verified pairs (a, b) of nodes that connect what is similar; `nodes` is (node, sketch) with distinct sketches.

    Every two members of a list are compared or already connected. In each
    round the leaders of a list are compared with all its members that are not
    known to be connected with them, and only leaders leave; who joined one
    stays, as others may be similar to that member alone. A list is settled
    when all members left are connected. Leaders are the member with the most
    links so far (the original of many copies) and members outside the largest
    connected part: one in the first round, then about twice as many each time,
    so the rounds grow with the logarithm of the members that are similar to none.

    Members of a crowd that are similar to none would so meet all others. A
    crowd has two leaders a round and order, which finds its originals; those
    still outside after some rounds are compared with the members that share a
    rare shingle with them (`_rare_pairs`), which settles the list.
    """
    spark = nodes.sparkSession
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("sketch", 1 + ROWS * k, ROWS)) for k in range(SKETCH // ROWS)])
    labels = None
    posts = _unsettled(nodes.select("node", F.explode(keys).alias("list")), labels)
    least = _least_shared(similarity)
    found, more, rounds = spark.createDataFrame([], "a long, b long"), 0, 0
    seen = found
    outside, crowded = F.col("label") != F.col("top"), F.col("members") > CROWD

    def compare(pairs: DataFrame) -> None:
        nonlocal seen, found, labels
        near = materialise(_tallied(pairs.join(seen, ["a", "b"], "left_anti"), nodes, least), "tallied")
        seen = seen.unionByName(near)
        found = materialise(found.unionByName(_verified(near, texts, shingle, similarity)), "similar")
        labels = _labels(found, labels)

    while not posts.isEmpty():
        # four orders of the nodes, so that not all lists of a group have the same leaders
        order = F.xxhash64(F.pmod("list", F.lit(4)), "node")
        ends = posts.groupBy("list").agg(F.max(F.struct("degree", order.alias("o"), "node", "label")).alias("x"),
                                         F.min(F.when(outside, F.struct(order.alias("o"), "node", "label"))).alias("y"))
        pick = [F.struct(F.col(f"{e}.node").alias("leader"), F.col(f"{e}.label").alias("led")) for e in "xy"]
        leaders = ends.select("list", F.inline(F.array(*pick)))
        if more:
            chosen = posts.where(~crowded & outside & (F.pmod(order, F.col("outside")) < more))
            leaders = leaders.unionByName(chosen.select("list", F.col("node").alias("leader"), F.col("label").alias("led")))
        leaders = leaders.distinct()
        met = _shuffled(posts).join(leaders, "list").where("leader <> node and led <> label")
        compare(met.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct())
        posts = _unsettled(posts.join(leaders.select("list", F.col("leader").alias("node")), ["list", "node"], "left_anti"), labels)
        more, rounds = 2 * more or 4, rounds + 1
        if rounds == ROUNDS and not (crowds := posts.where(crowded)).isEmpty():
            compare(_rare_pairs(crowds.select("node", "label", outside.alias("outside")), texts, shingle, similarity))
            posts = _unsettled(posts.where(~crowded), labels)
    return found


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, max_bits: int = 3) -> DataFrame:
    """(id, fp, component_id): components of documents whose sets of shingles overlap by `similarity`.

    Candidates come from the sketches and, in addition, from fingerprints that
    differ in at most `max_bits` bits or not at all; a fingerprint alone links
    nothing, as one repeated line can decide it. Two texts of exactly that
    similarity share a list with a probability of 0.998. Documents of one
    sketch (120 equal bytes), and those without words, are one node. Nulls,
    empty and repeated rows, other columns and empty tables are treated as in
    `near_duplicates`, but a row with a null id gets the component of its
    sketch; of several texts of one id the largest is verified.
    """
    found = profiles(docs, id_col, text_col, shingle)
    found = materialise(found.withColumn("sketch", F.coalesce("sketch", F.lit(b""))), "profiles")
    known = found.where("id is not null")
    by_sketch = materialise(known.groupBy("sketch").agg(F.min("id").alias("node")), "sketch-nodes")
    worded = by_sketch.where(F.octet_length("sketch") > 0)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    links = similar_links(worded, texts, shingle, similarity)
    roots = materialise(connected_components(links, "a", "b"), "sketch-roots")

    # fingerprints: of each one its first node, with the others of that fingerprint and with the first nodes of near ones
    of_fp = materialise(known.join(worded, "sketch").select("fp", "node").distinct(), "fp-nodes")
    first = materialise(of_fp.groupBy("fp").agg(F.min("node").alias("node")), "fp-first")
    equal = of_fp.join(first.withColumnRenamed("node", "a"), "fp").where("a <> node").select("a", F.col("node").alias("b"))
    pairs = fingerprint_links(first, max_bits).where("a <> b").unionByName(equal)
    open_pairs = pairs.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left").where(
        F.coalesce("ra", "a") != F.coalesce("rb", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = materialise(_tallied(open_pairs, worded, _least_shared(similarity)), "fp-tallied")
    links = links.unionByName(materialise(_verified(near, texts, shingle, similarity), "fp-similar"))

    # a document of several texts (a repeated id) connects their sketches
    links = links.unionByName(known.join(by_sketch, "sketch").select(F.col("node").alias("a"), F.col("id").alias("b")))
    roots = connected_components(links, "a", "b")
    classes = by_sketch.join(roots, "node", "left").select("sketch", F.coalesce("root", "node").alias("component_id"))
    return found.join(materialise(classes, "sketch-classes"), "sketch", "left").select(F.col("id").alias(id_col), "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
