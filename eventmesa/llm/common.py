"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries that a task's word cache holds before it is emptied; bounds a Python worker's memory.
CACHE_WORDS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where it is unset and all runs on this
    machine (tests), a new temporary one takes its place."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a saved table that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(df.saved_at)
    path.getFileSystem(conf).delete(path, True)


def tidied(spark: SparkSession) -> None:
    """Frees what finished steps left: unreachable shuffle files and broadcasts go when the driver collects its garbage, and
    the driver's Python gives its free memory back."""
    gc.collect()
    spark._jvm.System.gc()
    trimmed()


def trimmed() -> None:
    """This process's free memory goes back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n."""
    return F.crc32(column.cast("string").cast("binary")) % n


class WordHash(dict):
    """word bytes -> 64-bit hash, kept for words met before; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_P = np.uint64(0x9E3779B97F4A7C15)
_A = np.uint64(0xFF51AFD7ED558CCD)
_B = np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _S)) * _A
    x = (x ^ (x >> _S)) * _B
    return x ^ (x >> _S)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word sequences, in text order; empty when there are fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n] + np.uint64(k)
    for j in range(1, k):
        out = out * _P + words[j : j + n]
    return mixed(out)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingle hashes; with fewer words the whole sequence is one shingle; no words, no shingle."""
    return np.unique(gram_hashes(words, min(k, len(words)))) if len(words) else np.empty(0, np.uint64)


class MinHasher:
    """Minima of `n` universal hash functions a*x+b (upper half of 64 bits) over a set, in blocks of bounded size."""

    def __init__(self, n: int, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.a = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, n, dtype=np.uint64)

    def of(self, items: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(items), 1024):
            np.minimum(out, (items[i : i + 1024, None] * self.a + self.b).min(axis=0), out=out)
        return (out >> np.uint64(32)).astype(np.uint32)


def released(each: Callable) -> Callable:
    """`each` for mapInArrow, after which the task's memory goes back to the machine: Python workers outlive their tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from each(batches)
        trimmed()

    return run


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The texts of a batch as bytes; null is empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()).to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches small enough for Python lists of their words."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def sliced_bytes(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `limit` bytes in a text column, or of one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
