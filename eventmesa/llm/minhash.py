"""Document fingerprints: MinHash minima over word shingles by vectorised universal hash functions.

Fingerprints compare position by position. Bands of them are joined in Spark to find near copies, whose Jaccard
similarity is then verified on the full shingle sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MinHasher, WordHash, released, saved, shingle_set, sliced
from .setlinks import MINIMA, Links, Screen, digest

SHINGLE, SEED = 5, 61
#: What a fingerprint keeps of each minimum, and how many must agree before a pair is verified (at 0.8 all but 14 in a million pairs).
PRINT = Screen(MINIMA, ">u2", 37)
#: Minima of a band: 16 bands of 4 miss a pair at similarity 0.8 once in 4,500.
BAND = 4
OWN = "screen binary, n_shingles long, node long"
EDITED = f"n_chars long, edited_sha256 string, {OWN}, edited_screen binary, near_edited double, near_next double"
#: Ranges of ids a task: more of them make the tasks more even.
RANGES = 4


class Fingerprinter:
    def __init__(self, shingle: int = SHINGLE):
        self.shingle, self.cache, self.hasher = shingle, WordHash(), MinHasher(MINIMA, SEED)

    def set_of(self, text: str) -> np.ndarray:
        return shingle_set(self.cache.of(text.encode().lower().split()), self.shingle)

    def of(self, text: str) -> np.ndarray:
        """16 bits of each minimum; a text without words has all of them set."""
        return self.hasher.of(self.set_of(text)).astype(np.uint16)

    def with_node(self, text: str) -> tuple[np.ndarray, int, int | None]:
        """The same, with the number of shingles and the node."""
        own = self.set_of(text)
        return self.hasher.of(own).astype(np.uint16), len(own), digest(own) if len(own) else None


def hexed(minima: np.ndarray) -> str:
    return PRINT.of(minima).hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal minima: an estimate of the Jaccard similarity of the shingle sets."""
    return float((a == b).mean())


def part_of(value: Column, cuts: list) -> Column:
    """How many of the ascending cuts are at or below a value, looked up in two steps; null is below all."""
    if not cuts:
        return F.lit(0)
    width = math.isqrt(len(cuts)) + 1
    blocks = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    upto = lambda values, x: F.size(F.filter(values, lambda c: c <= x))
    block = upto(F.array(*(F.lit(b[0]) for b in blocks)), value)
    inside = F.element_at(F.array(*(F.array(*map(F.lit, b)) for b in blocks)), F.greatest(block, F.lit(1)))
    return F.when(value.isNull() | (block == 0), F.lit(0)).otherwise((block - 1) * width + upto(inside, value))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, packed (its text, compressed), part, head: documents dealt out by ranges of ids (`part`) and sorted in each,
    followed by the first document of the next range (`head`), so a task that reads a part meets every document's successor.

    Ranges are cut where Spark's range partitioning cuts the ids, so they are even for ids of any type and spread. Null ids
    come first, equal ids stand in the order of their texts' hashes, and the first document follows the last.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    firsts = rows.select("doc_id").na.drop().repartitionByRange(RANGES * n, "doc_id").select("doc_id", F.spark_partition_id().alias("p"))
    cuts = sorted(r.first for r in firsts.groupBy("p").agg(F.min("doc_id").alias("first")).collect())[1:]  # at most RANGES * n
    part = part_of(F.col("doc_id"), cuts)
    every = rows.withColumn("part", part).withColumn("head", F.lit(False))
    # The least of the rows that begin a range follows the range before; the first of all follows the last.
    heads = rows.where(F.col("doc_id").isin(cuts)).groupBy((part - 1).alias("part"), "doc_id").agg(F.min(F.struct("tie", "text")).alias("first"))
    start = rows.orderBy(F.col("doc_id").asc_nulls_first(), "tie").limit(1).withColumn("part", F.lit(len(cuts)))
    every = every.union(heads.select("doc_id", "first.text", "first.tie", "part", F.lit(True))).union(start.select("doc_id", "text", "tie", "part", F.lit(True)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in sliced(batches):
            packed = pa.array([compress(x) for x in batch.column(1).cast(pa.large_binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed, *batch.columns[2:]], ["doc_id", "packed", "tie", "part", "head"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *T._parse_datatype_string("packed binary, tie long, part int, head boolean").fields])
    dealt = every.mapInArrow(released(pack), schema).repartition(n, "part")
    return dealt.sortWithinPartitions("part", "head", F.col("doc_id").asc_nulls_first(), "tie").select("doc_id", "packed", "part", "head")


def with_edited(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_chars, edited_sha256, the fingerprint (`screen`), n_shingles and node of its
    text, the fingerprint of an edit of it, and likenesses.

    The edited text has its last half (rounded down) replaced by as many code points, or all, from the start of the next
    document by ascending id; the first follows the last, and a lone document follows itself. A null text is empty; empty
    texts are alike. Ids may be of any type that has an order. Texts are read whole; repeated rows give a row each.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *T._parse_datatype_string(EDITED).fields])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, unpack = Fingerprinter(), zstandard.ZstdDecompressor().decompress
        last, waiting = None, False

        def row(doc, own, following, after) -> tuple:
            half = len(own) // 2
            edited = own[: len(own) - half] + following[:half]
            print_, n_shingles, node = last[3]
            changed = maker.of(edited)
            return doc, len(own), hashlib.sha256(edited.encode()).hexdigest(), PRINT.of(print_), n_shingles, node, PRINT.of(changed), likeness(print_, changed), likeness(print_, after)

        for batch in sliced(batches):
            out = []
            for doc, packed, part, head in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if head and not (waiting and last[2] == part):
                    continue
                text = unpack(packed).decode()
                mine = maker.with_node(text)
                if waiting:
                    out.append(row(last[0], last[1], text, mine[0]))
                last, waiting = (doc, text, part, mine), not head
            if out:
                types = (batch.schema.field(0).type, pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*out, strict=True), types, strict=True)], schema.fieldNames())

    return with_next(docs, id_col, text_col).mapInArrow(released(each), schema)


def fingerprints(docs: DataFrame, *, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, screen (its fingerprint), n_shingles, node (null without words). Equal texts have
    equal fingerprints; null is empty."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *T._parse_datatype_string(OWN).fields])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter(shingle)
        for batch in sliced(batches):
            prints, sizes, nodes = zip(*(maker.with_node(t or "") for t in batch.column(1).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(PRINT.of, prints), pa.binary()), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64())], schema.fieldNames())

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(each), schema)


def near_copies(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id, kept; links are pairs with a band of minima in common
    whose Jaccard similarity is verified to be `percent` per cent or more. Nulls, texts without words and repeated rows
    are treated as chosen_path.near_duplicates treats them."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return banded(docs, saved(fingerprints(docs, shingle=shingle), "rows"), shingle, percent).labelled()


def banded(docs: DataFrame, rows: DataFrame, shingle: int, percent: int) -> Links:
    """The verified links between rows that have a band in common."""
    found = Links(docs, rows, shingle, percent, PRINT)
    bands = F.array(*(F.xxhash64(F.lit(i), F.substring("screen", 2 * i + 1, 2 * BAND)) for i in range(0, MINIMA, BAND)))
    found.search(found.reps.select("node", "n", F.explode(bands).alias("path")))
    return found


def fingerprinted(docs: DataFrame, *, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """with_edited and near_copies in one: one row per document row, with fingerprints computed once and in hexadecimal."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = saved(with_edited(docs), "rows")
    found = banded(docs, rows, SHINGLE, percent).labelled("n_chars", "edited_sha256", "screen", "edited_screen", "near_edited", "near_next")
    hexes = {c: F.lower(F.hex(c)) for c in ("screen", "edited_screen")}
    return found.withColumns(hexes).withColumnsRenamed({"screen": "fingerprint", "edited_screen": "edited_fingerprint"})
