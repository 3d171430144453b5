"""Language of a text by fusing the evidence around it.

For each language the posterior is the product of
- the likelihood of the text (letter sequences of its distinct words, each an
  independent witness up to a limit, so a long text is sure but not blind),
- the probability of the declared markup language given the language,
- the probability of the address suffix given the language,
- the prior of the host, smoothed towards its parent domain, which is smoothed
  towards the whole corpus.

All but the text model are estimated by grouped sums over all rows from what the
texts alone say; a row's own share is taken out of its host's prior. A
declaration that contradicts its texts everywhere thus counts for little.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import WordTable, as_bytes, map_batches
from gridloom.session import materialise

_BITS = 15
_EDGE = b".,;:!?\"'()[]{}<>|*#$%&+=-_/\\~^`@0123456789"


#: Words of more bytes are read in parts of `_PART` letters.
_LONG, _PART = 128, 40


def parts(word: bytes) -> list[bytes]:
    """The word in lower case without signs at its ends; a long one, as of scripts without blanks, in parts that each count as a word."""
    bare = word.decode("utf-8", "replace").lower().encode().strip(_EDGE)
    if len(bare) <= _LONG:
        return [bare]
    text = bare.decode("utf-8", "replace")
    return [text[i:i + _PART].encode() for i in range(0, len(text), _PART)]


def grams(bare: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the sequences of one to four bytes of each word, its ends marked, and where each word starts and ends.

    Row k of the buckets holds the sequences of k + 1 bytes by the place they
    start at; where one would leave its word, or the word has no letters, it
    holds the bucket 2^15, which stands for nothing.
    """
    marked = [b"^%s$" % w if w else b"-" for w in bare]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.cumsum(sizes)
    letters = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    left = np.repeat(ends, sizes) - np.arange(len(letters))  # bytes to the end of the word, this one included
    left[np.repeat(sizes == 1, sizes)] = 0
    out, key = [], np.zeros(len(letters), np.uint64)
    for k in range(4):
        reach = max(0, len(letters) - k)
        key[:reach] = key[:reach] * np.uint64(257) + letters[k:] + np.uint64(1)
        mixed = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)
        out.append(np.where(left > k, mixed.astype(np.int64), 1 << _BITS))
    return np.stack(out), ends - sizes, ends


@dataclass
class TextModel:
    languages: list[str]
    logs: np.ndarray  # bucket x language, and a last row of zeros

    def table(self) -> WordTable:
        def compute(words: list[bytes]) -> Iterator[bytes]:
            split = [parts(w) for w in words]
            buckets, starts, ends = grams([p for ps in split for p in ps])
            n_lang = self.logs.shape[1]
            sums, counts = np.zeros((buckets.shape[1] + 1, n_lang)), np.zeros(buckets.shape[1] + 1)
            for row in buckets:
                sums[1:] += self.logs[row]
                counts[1:] += row < 1 << _BITS
            sums, counts = np.cumsum(sums, 0), np.cumsum(counts)
            n = counts[ends] - counts[starts]
            mean = ((sums[ends] - sums[starts]) / np.maximum(n, 1)[:, None]).astype(np.float32)
            at = 0
            for ps in split:  # one row of means for each part that has letters
                some = slice(at, at + len(ps))
                yield mean[some][n[some] > 0].tobytes()
                at += len(ps)
        return WordTable(compute)


def fit(docs: DataFrame, lang_col: str, text_col: str, id_col: str, sample_rows: int = 12_000, most_languages: int = 256) -> TextModel:
    """Letter sequences by language, from at most `sample_rows` texts with a known language, in the order of a hash of their ids.

    All languages of the sample are told apart; more than `most_languages`, which
    bounds the model's table, are an error. Of rows that share an id the one with the
    greatest (language, text) counts; rows without id, language or text are left out.
    """
    known = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    ids = known.select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(sample_rows)
    pair = F.struct(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    one = known.join(F.broadcast(ids), id_col).groupBy(id_col).agg(F.max(pair).alias("_pair"))
    chosen = materialise(one.select("_pair.*"), "language-sample")
    languages = sorted(r["lang"] for r in chosen.select("lang").distinct().limit(most_languages + 1).collect())
    if len(languages) > most_languages:
        raise ValueError(f"more than {most_languages} languages; raise most_languages")
    place = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(languages), 1 << _BITS), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                if lang in place and (words := list(set(text.split()))):
                    n[place[lang]] += np.bincount(grams([p for w in words for p in parts(w)])[0].ravel(), minlength=(1 << _BITS) + 1)[:-1]
        at = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(n[at])], ["lang", "bucket", "n"])

    counts = np.full((1 << _BITS, max(1, len(languages))), 0.5)
    # languages x 2^15 buckets at most
    for r in map_batches(chosen, count, "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["bucket"], r["lang"]] += r["n"]
    return TextModel(languages, np.vstack([np.log(counts / counts.sum(0)), np.zeros(counts.shape[1])]))


def text_evidence(rows: DataFrame, model: TextModel, text_col: str, witnesses: int = 40) -> DataFrame:
    """`rows` without the text, with `lt`: the log likelihood of each language, 0 for a text without words."""
    rest = [c for c in rows.columns if c != text_col]
    ordered = rows.select(text_col, *rest)
    sent = rows.sparkSession.sparkContext.broadcast(model)
    n_lang = len(model.languages)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value.table()
        for batch in batches:
            found = []
            for text in as_bytes(batch.column(0)):
                logs = np.frombuffer(table.lookup(set(text.split())), np.float32).reshape(-1, max(1, n_lang))
                found.append(([0.0] * n_lang if not len(logs) else (logs.mean(0, dtype=np.float64) * min(len(logs), witnesses)).tolist()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.list_(pa.float64()))], [*rest, "lt"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields[1:]]
    return map_batches(ordered, run, ", ".join([*fields, "lt array<double>"]))


def _softmax(logs: str | Column) -> Column:
    logs = F.col(logs) if isinstance(logs, str) else logs
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def _sums(n_lang: int) -> Column:
    return F.array(*[F.sum(F.col("tp")[i]) for i in range(n_lang)])


def identify(rows: DataFrame, model: TextModel, text_col: str = "text", declared_col: str = "declared", suffix_col: str = "suffix",
             host_col: str = "host", parent_col: str = "parent", weight: float = 5.0) -> DataFrame:
    """`rows` without the text and the evidence columns, with `language`, `confidence` and `text_language`.

    `weight` is how many rows the level above counts for in a prior. Evidence
    that is null says nothing; a row with no words and no evidence gets the
    corpus prior. Ties go to the language first in the alphabet. Without any
    language in the model `language` is null. Repeated rows come out alike; an
    empty table gives an empty table.
    """
    langs, n_lang = model.languages, len(model.languages)
    out_cols = [c for c in rows.columns if c not in (text_col, declared_col, suffix_col, host_col, parent_col)]
    if not n_lang:
        empty = F.lit(None)
        return rows.select(*out_cols, empty.cast("string").alias("language"), empty.cast("double").alias("confidence"), empty.cast("string").alias("text_language"))
    seen = text_evidence(rows.withColumnsRenamed({declared_col: "_declared", suffix_col: "_suffix", host_col: "_host", parent_col: "_parent"}), model, text_col)
    seen = materialise(seen.withColumn("tp", _softmax("lt")), "text-evidence")

    whole = seen.agg(_sums(n_lang).alias("s"), F.count(F.lit(1)).alias("n")).first()
    base = [((x or 0.0) + 1) / ((whole["n"] or 0) + n_lang) for x in (whole["s"] or [0.0] * n_lang)]
    base_col = F.array(*[F.lit(float(b)) for b in base])

    def given(col: str, out: str) -> DataFrame:
        """P(value | language) for each value of a column, one share of it set aside for values not seen."""
        by = seen.where(F.col(col).isNotNull()).groupBy(col).agg(_sums(n_lang).alias("s"))
        total = by.agg(F.array(*[F.sum(F.col("s")[i]) for i in range(n_lang)]).alias("t"), F.count(F.lit(1)).alias("k")).first()
        t, k = total["t"], total["k"]
        logs = F.array(*[F.log((F.col("s")[i] + 0.5) / F.lit(float((t[i] or 0.0) + 0.5 * (k + 1)))) for i in range(n_lang)])
        return materialise(by.select(col, logs.alias(out)), out)

    def smoothed(s: Column, n: Column, up: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(n_lang - 1)), lambda i: (F.get(s, i) + weight * F.get(up, i)) / (n + weight))

    parents = seen.where("_parent is not null").groupBy("_parent").agg(_sums(n_lang).alias("s"), F.count(F.lit(1)).alias("n"))
    parents = materialise(parents.select("_parent", smoothed(F.col("s"), F.col("n"), base_col).alias("up")), "parent-priors")
    hosts = seen.where("_host is not null").groupBy("_host", "_parent").agg(_sums(n_lang).alias("hs"), F.count(F.lit(1)).alias("hn"))
    hosts = materialise(hosts.join(parents, "_parent", "left").select("_host", F.col("_parent").alias("_hp"), "hs", "hn", F.coalesce("up", base_col).alias("up")), "host-sums")

    joined = (seen.join(given("_declared", "ld"), "_declared", "left").join(given("_suffix", "ls"), "_suffix", "left").alias("x")
              .join(hosts.alias("h"), (F.col("x._host") == F.col("h._host")) & F.col("x._parent").eqNullSafe(F.col("h._hp")), "left"))
    # the host without the row itself
    own = F.transform(F.sequence(F.lit(0), F.lit(n_lang - 1)), lambda i: F.get(F.col("hs"), i) - F.get(F.col("tp"), i))
    prior = F.when(F.col("hs").isNotNull(), smoothed(own, F.col("hn") - 1, F.col("up"))).otherwise(base_col)
    fused = F.transform(F.sequence(F.lit(0), F.lit(n_lang - 1)), lambda i: F.get("lt", i) + F.log(F.greatest(F.get("_prior", i), F.lit(1e-12)))
                        + F.coalesce(F.get("ld", i), F.lit(0.0)) + F.coalesce(F.get("ls", i), F.lit(0.0)))
    names = F.array(*[F.lit(x) for x in langs])
    best = lambda p: F.get(names, F.array_position(p, F.array_max(p)).cast("int") - 1)
    return joined.withColumn("_prior", prior).withColumn("_post", _softmax(fused)).select(
        *out_cols, best(F.col("_post")).alias("language"), F.array_max("_post").alias("confidence"),
        F.when(F.exists("lt", lambda x: x != 0), best(F.col("tp"))).alias("text_language"))


def page_rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, text, declared, suffix, host, parent) of web pages: text without markup, language of the html tag, parts of the address."""
    url, html = F.col(url_col), F.col(html_col)
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    plain = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    declared = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1))
    known = lambda c: F.when(c != "", c)
    return pages.select(F.col(id_col), plain.alias("text"), known(declared).alias("declared"), known(F.regexp_extract(host, r"\.([a-z]+)$", 1)).alias("suffix"),
                        known(host).alias("host"), known(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("parent"))
