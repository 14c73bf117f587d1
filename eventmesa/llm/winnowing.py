"""Benchmark decontamination by winnowing.

From each run of `window` words the k-gram with the least hash is kept as a fingerprint, so every shared span of
`window` words or more has a fingerprint in common. Fingerprints of documents and benchmark items are joined, and each
hit is extended along its diagonal to the whole run of equal words; runs of `window` words or more count.
"""

from __future__ import annotations

import hashlib
import string
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHash, gram_hashes, released, saved, sliced, utf8

#: Bytes of benchmark text up to which its fingerprints and words are sent to every executor; above, they are joined.
BROADCAST_BYTES = 16_000_000

#: Words are runs of a-z, 0-9 and bytes beyond ASCII, after A-Z became a-z.
_FOLD = bytes(b if b >= 0x80 or chr(b) in string.ascii_lowercase + string.digits else b + 32 if chr(b) in string.ascii_uppercase else 32 for b in range(256))


def split_words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def winnowed(grams: np.ndarray, span: int) -> np.ndarray:
    """Positions that hold the least hash of some `span` neighbouring k-grams (all of them, on ties)."""
    n = len(grams) - span + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least = grams[:n].copy()
    for j in range(1, span):
        np.minimum(least, grams[j : j + n], out=least)
    keep = np.zeros(len(grams), bool)
    for j in range(span):
        keep[j : j + n] |= grams[j : j + n] == least
    return np.flatnonzero(keep)


def runs(equal: np.ndarray, least: int) -> list[tuple[int, int]]:
    """[start, end) of the runs of True that are `least` long or longer."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], equal, [False])).astype(np.int8)))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= least]


class Items:
    """Benchmark items as word hashes, with their fingerprints; items shorter than the window match as a whole."""

    def __init__(self, texts: list[bytes], window: int):
        self.window, self.k = window, (window + 1) // 2
        self.span = window - self.k + 1
        cache = WordHash()
        self.words = [cache.of(split_words(t)) for t in texts]
        posted, self.short = defaultdict(list), defaultdict(lambda: defaultdict(list))
        for i, w in enumerate(self.words):
            if len(w) >= window:
                grams = gram_hashes(w, self.k)
                for p in winnowed(grams, self.span).tolist():
                    posted[int(grams[p])].append((i, p))
            elif len(w):
                self.short[len(w)][int(gram_hashes(w, len(w))[0])].append(i)
        self.prints = np.array(sorted(posted), np.uint64)
        self.posted = [posted[int(x)] for x in self.prints]

    def spans(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, start, end) of every maximal run of document words that covers whole windows of the item."""
        if len(words) >= self.window and len(self.prints):
            grams = gram_hashes(words, self.k)
            kept = winnowed(grams, self.span)
            at = np.searchsorted(self.prints, grams[kept])
            same = self.prints[np.minimum(at, len(self.prints) - 1)] == grams[kept]
            diagonals = {(i, p - q) for p, x in zip(kept[same].tolist(), at[same].tolist(), strict=True) for i, q in self.posted[x]}
            for i, shift in diagonals:
                item = self.words[i]
                first, last = max(0, -shift), min(len(item), len(words) - shift)
                for a, b in runs(words[first + shift : last + shift] == item[first:last], self.window):
                    yield i, first + shift + a, first + shift + b
        for n, known in self.short.items():
            grams = gram_hashes(words, n)
            if len(grams):
                for p in np.flatnonzero(np.isin(grams, np.fromiter(known, np.uint64, len(known)))).tolist():
                    for i in known[int(grams[p])]:
                        yield i, p, p + n


def digest_of(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def _found(words: np.ndarray, items: Items, names: list[str | None]) -> tuple[int, list[str]]:
    hit, seen = np.zeros(len(words), bool), set()
    for i, a, b in items.spans(words):
        hit[a:b] = True
        seen.add(names[i])
    return int(hit.sum()), sorted(x for x in seen if x is not None)


def judged(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document row: its id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null or empty texts have no words and aren't contaminated. Repeated document rows give a row each. Items without
    words never match; item ids count once however often they are repeated, and a null item id is no item, though its
    words hit. Other columns of either table don't matter. With an empty benchmark nothing is hit.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    benchmark, small = _items(benchmark, item_col, item_text_col, broadcast_bytes)
    id_type = docs.schema["doc_id"].dataType
    return _sent(docs, benchmark, id_type, window) if small else _joined(docs, benchmark, id_type, window)


def _items(benchmark: DataFrame, item_col: str, text_col: str, broadcast_bytes: int) -> tuple[DataFrame, bool]:
    """item_id, text; and whether they may be sent."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(text_col).alias("text")).na.drop(subset=["text"])
    return items, items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0] <= broadcast_bytes


def _sender(benchmark: DataFrame, window: int):
    """A function that tasks call once, for one that judges a text: n_words, n_hit, item ids."""
    rows = benchmark.collect()  # at most BROADCAST_BYTES
    sent = benchmark.sparkSession.sparkContext.broadcast(([r.item_id for r in rows], [r.text.encode() for r in rows]))

    def judge():
        (names, texts), cache = sent.value, WordHash()
        items = Items(texts, window)

        def of(text: bytes) -> tuple[int, int, list[str]]:
            words = cache.of(split_words(text))
            return len(words), *_found(words, items, names)

        return of

    return judge


def _sent(docs: DataFrame, benchmark: DataFrame, id_type: T.DataType, window: int) -> DataFrame:
    judge = _sender(benchmark, window)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = judge()
        for batch in sliced(batches):
            out = [(n, n_hit, len(seen), digest_of(seen), judged(n, n_hit)) for n, n_hit, seen in map(of, utf8(batch, "text"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, zip(*out, strict=True))], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return docs.mapInArrow(released(each), T.StructType([T.StructField("doc_id", id_type), *T._parse_datatype_string(RESULT).fields]))


def _joined(docs: DataFrame, benchmark: DataFrame, id_type: T.DataType, window: int) -> DataFrame:
    """For benchmarks too large to send: fingerprints are joined, then the words of the pairs that they name."""
    docs = saved(docs.withColumn("row", F.monotonically_increasing_id()), "decontaminate-docs")
    items = saved(benchmark.withColumn("item", F.monotonically_increasing_id()), "decontaminate-items")

    def prints(name: str, lengths: list[int] | None):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cache, k = WordHash(), (window + 1) // 2
            for batch in sliced(batches):
                rows, found = [], []
                for row, text in zip(batch.column(0).to_pylist(), utf8(batch, "text"), strict=True):
                    words = cache.of(split_words(text))
                    grams = gram_hashes(words, k)
                    parts = [grams[winnowed(grams, window - k + 1)]]
                    whole = lengths if lengths is not None else [len(words)] * (0 < len(words) < window)
                    parts += [gram_hashes(words, n) + np.uint64(n) for n in whole]
                    own = np.unique(np.concatenate(parts))
                    rows.append(np.full(len(own), row, np.int64))
                    found.append(own.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(found))], [name, "print"])

        return each

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([pa.array([len(split_words(t)) for t in utf8(batch, "text")], pa.int64())], ["n"])

    lengths = [r.n for r in items.select("text").mapInArrow(released(count), "n long").where(F.col("n").between(1, window - 1)).distinct().collect()]  # fewer than `window`
    left = docs.select("row", "text").mapInArrow(released(prints("row", lengths)), "row long, print long")
    right = items.select("item", "text").mapInArrow(released(prints("item", None)), "item long, print long")
    pairs = left.join(right, "print").select("row", "item").distinct()

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHash()
        for batch in sliced(batches, 64):
            out = []
            for row, name, text, item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch, "text"), utf8(batch, "item_text"), strict=True):
                out += [(row, name, a, b) for _, a, b in Items([item], window).spans(cache.of(split_words(text)))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["row", "item_id", "a", "b"])

    spans = pairs.join(items.withColumnRenamed("text", "item_text"), "item").join(docs.select("row", "text"), "row").select("row", "item_id", "text", "item_text").mapInArrow(released(extend), "row long, item_id string, a long, b long")
    spans = saved(spans, "decontaminate-spans")
    before = F.coalesce(F.max("b").over(Window.partitionBy("row").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hits = spans.select("row", "a", "b").distinct().withColumn("new", F.greatest(F.col("b") - F.greatest("a", before), F.lit(0))).groupBy("row").agg(F.sum("new").alias("n_hit"))
    named = spans.where("item_id is not null").groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(split_words(t)) for t in utf8(batch, "text")], pa.int64())], ["row", "doc_id", "n_words"])

    counted = docs.select("row", "doc_id", "text").mapInArrow(released(number), T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", id_type), T.StructField("n_words", T.LongType())]))
    n_hit, ids = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("ids", F.array().cast("array<string>"))
    return counted.join(hits, "row", "left").join(named, "row", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents that aren't contaminated, with all their columns, whatever their names. Each row is judged by its own
    text, so rows that share an id don't share a verdict; null and empty texts stay."""
    items, small = _items(benchmark, item_col, item_text_col, broadcast_bytes)
    if not small:
        rows = saved(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.monotonically_increasing_id().alias("row_id")), "decontaminate-rows")
        bad = contamination(rows.select("row_id", F.col("row")[text_col].alias("text")), items, id_col="row_id", item_text_col="text", item_col="item_id", window=window, broadcast_bytes=broadcast_bytes)
        bad = bad.where("contaminated").select("doc_id")
        return rows.join(bad, F.col("row_id") == F.col("doc_id"), "left_anti").select("row.*")
    judge, at = _sender(items, window), docs.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = judge()
        for batch in sliced(batches):
            verdicts = [judged(*of(x or b"")[:2]) for x in batch.column(at).cast(pa.large_binary()).to_pylist()]
            yield batch.filter(pa.array([not x for x in verdicts], pa.bool_()))

    return docs.mapInArrow(released(each), docs.schema)
