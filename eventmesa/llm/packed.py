"""Token ids in patched frame-of-reference blocks.

A segment is a byte string: a header, the number of ids of each document, an index of block starts, and blocks of 256
ids. A block stores its least id, then the differences from it at a width that most of them fit; the high bits of the
rest stand in an exception list. Segments are written by Spark as rows of a Parquet folder, in document order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache as once

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, sliced, sliced_bytes

#: Fixed values of the format: mark, ids in a block, lanes of a packed block, per cent of a block's ids that its width must fit.
MAGIC, BLOCK, LANES, FIT = b"PFB1", 256, 8, 92
ROWS = BLOCK // LANES
#: Ids after which a segment ends (at the end of a document).
SEGMENT_IDS = 1 << 19
#: Encoded pieces of text that a Python worker keeps, twice: the newer ones and those before.
CACHE_PIECES = 150_000
#: Bytes of text that are encoded at once (at least one text).
SLICE_BYTES = 6_000_000
#: Of a text that is encoded whole: white space at an end or next to other, or what may be a special token.
SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
#: A letter and a mark after it, which a byte-level pre-tokenizer parts.
MARKED = "([A-Za-zÀ-ÖØ-öø-ÿ])([.,])"
WHOLE = rf"^{SPACE}|{SPACE}{SPACE}|{SPACE}$|\x00|<\|"


def bit_length(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def pack(values: np.ndarray, lengths: np.ndarray) -> bytes:
    """A segment of unsigned 32-bit `values`, which belong to documents of these lengths."""
    n_blocks = -(-len(values) // BLOCK)
    body: list[bytes] = []
    starts = np.zeros(n_blocks + 1, np.uint64)
    if n_blocks:
        padded = np.concatenate([values, np.full(n_blocks * BLOCK - len(values), values[-1], np.uint32)]).reshape(n_blocks, BLOCK)
        least = padded.min(axis=1)
        rest = padded - least[:, None]
        at = BLOCK * FIT // 100 - 1
        width = bit_length(np.partition(rest, at, axis=1)[:, at])
        over = rest >> np.minimum(width, 31)[:, None].astype(np.uint32)
        over[width >= 32] = 0
        n_over = (over > 0).sum(axis=1)
        packed: list[bytes] = [b""] * n_blocks
        for w in np.unique(width).tolist():
            if w:
                own = np.flatnonzero(width == w)
                low = rest[own] if w >= 32 else rest[own] & np.uint32((1 << w) - 1)
                words = np.zeros((len(own), w, LANES), np.uint32)
                for r, lanes in enumerate(low.reshape(len(own), ROWS, LANES).transpose(1, 0, 2)):
                    word, shift = divmod(r * w, 32)
                    words[:, word] |= lanes << np.uint32(shift)
                    if shift + w > 32:
                        words[:, word + 1] |= lanes >> np.uint32(32 - shift)
                size, raw = w * LANES * 4, words.astype("<u4").tobytes()
                for i, b in enumerate(own.tolist()):
                    packed[b] = raw[i * size : (i + 1) * size]
        heads = np.zeros(n_blocks, [("least", "<u4"), ("width", "u1"), ("over", "u1")])
        heads["least"], heads["width"], heads["over"] = least, width, n_over
        raw_heads, (of, where) = heads.tobytes(), np.nonzero(over)
        high, places = over[of, where].astype("<u4").tobytes(), where.astype(np.uint8).tobytes()
        ends = np.cumsum(n_over)
        for b, (end, n) in enumerate(zip(ends.tolist(), n_over.tolist(), strict=True)):
            body.append(raw_heads[b * 6 : b * 6 + 6] + packed[b] + places[end - n : end] + high[4 * (end - n) : 4 * end])
        starts[1:] = np.cumsum([len(x) for x in body])
    head = MAGIC + np.array([len(lengths), len(values), n_blocks], "<u8").tobytes()
    return b"".join([head, lengths.astype("<u4").tobytes(), starts.astype("<u8").tobytes(), *body])


class Segment:
    """Reads a packed segment, all of it or a range."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a packed segment")
        n_docs, self.n, n_blocks = (int(x) for x in np.frombuffer(data, "<u8", 3, 4))
        self.lengths = np.frombuffer(data, "<u4", n_docs, 28).astype(np.int64)
        self.starts = np.frombuffer(data, "<u8", n_blocks + 1, 28 + 4 * n_docs).astype(np.int64)
        self.data, self.base = data, 28 + 4 * n_docs + 8 * (n_blocks + 1)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The ids of blocks [first, last), padding included."""
        at = self.base + self.starts[first:last]
        raw = np.frombuffer(self.data, np.uint8)
        heads = raw[at[:, None] + np.arange(6)].copy().view([("least", "<u4"), ("width", "u1"), ("over", "u1")])[:, 0]
        out = np.zeros((last - first, BLOCK), np.uint32)
        for w in np.unique(heads["width"]).tolist():
            if w:
                own = np.flatnonzero(heads["width"] == w)
                words = raw[at[own, None] + 6 + np.arange(w * LANES * 4)].copy().view("<u4").reshape(len(own), w, LANES)
                for r in range(ROWS):
                    word, shift = divmod(r * w, 32)
                    lanes = words[:, word] >> np.uint32(shift)
                    if shift + w > 32:
                        lanes = lanes | words[:, word + 1] << np.uint32(32 - shift)
                    out[own, r * LANES : (r + 1) * LANES] = lanes & np.uint32((1 << w) - 1)
        for b in np.flatnonzero(heads["over"]).tolist():
            n, w = int(heads["over"][b]), int(heads["width"][b])
            p = int(at[b]) + 6 + w * LANES * 4
            out[b, raw[p : p + n]] |= np.frombuffer(self.data, "<u4", n, p + n) << np.uint32(w)
        return (out + heads["least"][:, None]).ravel()

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """Ids [start, end); only the blocks that hold them are read."""
        end = self.n if end is None else min(end, self.n)
        if start >= end:
            return np.empty(0, np.uint32)
        first, last = start // BLOCK, -(-end // BLOCK)
        return self.blocks(first, last)[start - first * BLOCK : end - first * BLOCK]


@once
def tokenizer_at(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Pieces:
    """Encodes texts, keeping the ids of pieces met before as little-endian 32-bit bytes.

    A byte-level pre-tokenizer cuts before a lone space, around a lone line end and between a letter and a mark, so such
    pieces can be encoded one by one. Arrow cuts a batch and finds its distinct pieces; those not known are encoded together, a line end between them,
    and all ids are then gathered by offsets. A text with other white space next to each other or at its ends, or with
    what may be a special token, is encoded whole, as all texts are with other tokenizers.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizer_at(path)
        self.cuts = type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel" and self.tokenizer.normalizer is None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.line_end = self.encoded(["\n"])[0] if self.cuts else []
        self.cuts = len(self.line_end) == 1

    def encoded(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: list[str]) -> None:
        if len(self.known) > CACHE_PIECES:
            self.older, self.known = self.known, {}
        fresh = []
        for piece in pieces:
            if piece in self.known:
                continue
            if (ids := self.older.get(piece)) is not None:
                self.known[piece] = ids
            elif piece in ("", "\n"):
                self.known[piece] = np.array(self.encoded([piece])[0], "<u4").tobytes()
            else:
                fresh.append(piece)
        if fresh:
            ids = np.array(self.encoded(["\n".join(fresh)])[0], "<u4")
            cuts = np.flatnonzero(ids == self.line_end[0]).tolist()
            raw = ids.tobytes()
            self.known.update((x, raw[4 * a + 4 : 4 * b]) for x, a, b in zip(fresh, [-1, *cuts], [*cuts, len(ids)], strict=True))

    def of(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, `end_id` after each, and how many each has."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        plain = ~np.asarray(pc.match_substring_regex(texts, WHOLE)) if self.cuts else np.zeros(len(texts), bool)
        marked = pc.replace_substring_regex(texts.filter(pa.array(plain)), MARKED, "\\1\0\\2")
        marked = pc.replace_substring(pc.replace_substring(marked, " ", "\0 "), "\n", "\0\n\0")
        split = pc.split_pattern(marked, "\0")
        coded = split.flatten().dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        self.learn(pieces)
        found = [*map(self.known.__getitem__, pieces)]
        found += [np.array(x, "<u4").tobytes() for x in self.encoded(texts.filter(pa.array(~plain)).to_pylist())]
        found.append(np.array([end_id], "<u4").tobytes())
        # Of each text the codes of its pieces (one for a text encoded whole), then that of the end.
        counts = np.ones(len(texts), np.int64)
        counts[plain] = split.value_lengths().to_numpy()
        ends = np.cumsum(counts + 1)
        codes = np.empty(ends[-1] if len(ends) else 0, np.int64)
        is_plain = np.repeat(plain, counts + 1)
        is_end = np.zeros(len(codes), bool)
        is_end[ends - 1] = True
        codes[is_end] = len(found) - 1
        codes[is_plain & ~is_end] = coded.indices.to_numpy()
        codes[~is_plain & ~is_end] = len(pieces) + np.arange(int((~plain).sum()))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        own = sizes[codes]
        shift = (np.cumsum(sizes) - sizes)[codes] - (np.cumsum(own) - own)
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(shift, own) + np.arange(int(own.sum()))]
        return ids, np.add.reduceat(own, ends - counts - 1) if len(ends) else np.zeros(0, np.int64)


@once
def pieces_for(path: str) -> Pieces:
    """One for each Python worker, which serves many tasks."""
    return Pieces(path)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> None:
    """Writes the documents' token ids, `end_id` after each, to the folder `path`, in ascending order of `id_col`.

    A null text is empty: only its end id is written. Null ids come first; rows of one id stand in the order of their
    texts. An empty table gives a folder with no segment.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_ids", T.ArrayType(id_type)), *T._parse_datatype_string("shard int, part int, n_ids long, payload binary").fields])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, shard, part = pieces_for(tokenizer_path), TaskContext.get().partitionId(), 0
        names, found, sizes, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            own, lengths = pa.concat_arrays(names), np.concatenate(sizes)
            payload = pack(np.concatenate(found), lengths)
            columns = [pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([int(lengths.sum())], pa.int64()), pa.array([payload], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["doc_ids", "shard", "part", "n_ids", "payload"])

        for batch in sliced_bytes(batches, 1, SLICE_BYTES):
            ids, lengths = pieces.of(batch.column(1), end_id)
            ends, row, at = np.cumsum(lengths), 0, 0
            while row < len(lengths):
                to = min(int(np.searchsorted(ends, at + SEGMENT_IDS - held)) + 1, len(lengths))  # the document that fills the segment
                names.append(batch.column(0).slice(row, to - row))
                found.append(ids[at : ends[to - 1]])
                sizes.append(lengths[row:to])
                held, row, at = held + len(found[-1]), to, int(ends[to - 1])
                if held >= SEGMENT_IDS:
                    yield flush()
                    names, found, sizes, held, part = [], [], [], 0, part + 1
        if names:
            yield flush()

    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(released(each), schema).write.option("compression", "none").parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """The documents of such a folder: doc_id, start (ids before it), n_tokens, ids_crc32."""
    files = spark.read.parquet(path)
    id_type = files.schema["doc_ids"].dataType.elementType
    counts = files.select("shard", "part", "n_ids")
    shards = counts.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # as many as the writer's tasks
    before = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("within", within).join(before, "shard").select("shard", "part", (F.col("before") + F.col("within")).alias("first"))
    schema = T.StructType([T.StructField("doc_id", id_type), *T._parse_datatype_string("shard int, part int, at long, n_tokens long, ids_crc32 long").fields])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            segment = Segment(batch.column(3)[0].as_py())
            raw, ends = segment.ids().astype("<u4").tobytes(), np.cumsum(segment.lengths)
            starts = ends - segment.lengths
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(ends)
            columns = [batch.column(0).flatten(), pa.array([batch.column(1)[0].as_py()] * n, pa.int32()), pa.array([batch.column(2)[0].as_py()] * n, pa.int32()), pa.array(starts), pa.array(segment.lengths), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "shard", "part", "at", "n_tokens", "ids_crc32"])

    docs = files.select("doc_ids", "shard", "part", "payload").mapInArrow(released(each), schema)
    return docs.join(starts, ["shard", "part"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
