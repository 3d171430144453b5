"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import ship

#: Whitespace of the word rule `[^\x20\x09-\x0D]+`; `bytes.split()` splits at exactly these six characters.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, every other character as it is (`lower` alone would also change accented letters)."""
    ascii_only = F.octet_length(c) == F.char_length(c)
    return F.when(ascii_only, F.lower(c)).otherwise(F.translate(c, _UPPER, _UPPER.lower()))


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """`names` with as many underscores before each as no column of `df` is called like it."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        found.append(name)
    return found


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes; null counts as empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def each_bytes(column) -> Iterator[bytes]:
    """The same one after the other, without holding all of a batch twice."""
    return (v.as_py() or b"" for v in column.cast(pa.binary()))


#: Spark's setting for the bytes of an Arrow batch, and its default.
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Cut the session's Arrow batches at `size` unless it has a bound of its own; no result depends on it.

    A batch is held several times over: by the executor, by Arrow, as Python
    objects, as results.
    """
    if spark.conf.get(_BATCH) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, size)


def map_batches(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`mapInArrow` with this package at hand in the workers, which give back their memory at the end of a partition."""
    ship(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system: a worker waits for its next task with all it ever held otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def map_texts(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """Run `fn` over each Arrow batch that has rows."""
    return map_batches(df, lambda batches: (fn(b) for b in batches if b.num_rows), schema)


class WordTable:
    """Bytes looked up by word, computed once for words seen lately: two generations of at most `size` words."""

    def __init__(self, compute: Callable[[list[bytes]], Iterable[bytes]], size: int = 1 << 17):
        self.compute, self.size = compute, size
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def lookup(self, words: list[bytes] | set[bytes]) -> bytes:
        """The bytes of all words, one after the other."""
        if len(self.new) > self.size:
            self.old, self.new = self.new, {}
        new, missing = self.new, []
        for w in set(words).difference(new):
            if (found := self.old.get(w)) is None:
                missing.append(w)
            else:
                new[w] = found
        if missing:
            new.update(zip(missing, self.compute(missing)))
        return b"".join(map(new.__getitem__, words))
