"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Both tokenizers tile the same bytes (a space and the text). Per batch of documents, pandas' merge_asof, keyed by document,
finds for each token start the other side's token that covers it; both directions together are all overlaps, and equal ends
cut both sides into groups. How many documents hold an id pair linked is counted by batches' distinct pairs, so that Spark
adds up and looks up a batch's pairs, never a document's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache as once

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, saved, sliced, sliced_bytes

#: Bytes of text in a batch (at least one text); chunks, and ids, that a worker keeps before it forgets all; chunks that are encoded as one text.
BATCH_BYTES, CACHE_CHUNKS, CACHE_IDS, TOGETHER = 1 << 20, 200_000, 4_000_000, 2048
#: What isn't white space, before a space: no token of either tokenizer reaches over such a place.
SOLID = r"[^\t-\r\x1c-\x20\x{85}\p{Z}]"
CUT, ENDS = rf"({SOLID})( )", rf"{SOLID}$"
#: A pair's key is the A id times this plus the B id.
SIDE = 1 << 32


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("\u2581", " ").encode()


class Side:
    """One tokenizer's tokens, and the ids of known chunks one after another: chunk i has those from starts[i] on, sizes[i] of
    them."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.width, self.name = tokens, np.array([*map(len, tokens)], np.int64), np.array([*map(str, range(len(tokens)))], object)
        self.clear()

    def clear(self) -> None:
        self.ids, self.used, self.starts, self.sizes = np.zeros(1 << 16, np.int32), 0, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, ids: list[np.ndarray], sizes: list[np.ndarray]) -> None:
        more, own = np.concatenate(ids), np.concatenate(sizes)
        if self.used + len(more) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used + 2 * len(more), np.int32)])
        self.ids[self.used : self.used + len(more)] = more
        self.starts, self.sizes = np.append(self.starts, self.used + np.cumsum(own) - own), np.append(self.sizes, own)
        self.used += len(more)

    def of(self, codes: np.ndarray, counts: np.ndarray, texts: int, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these chunks, and how many each text has; `used` are the texts with chunks, `counts` of them each."""
        own, n = self.sizes[codes], np.zeros(texts, np.int64)
        if len(codes):
            n[used] = np.add.reduceat(own, np.cumsum(counts) - counts)
        return self.ids[np.repeat(self.starts[codes] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))], n


class Chunks:
    """Encodes texts on both sides by chunks that begin at a space, keeping the ids of chunks met before.

    Neither side has a token that goes on from other characters into a space, so chunks can be encoded apart, or new ones
    one after another as one text and cut where each begins: A as they are, B without the first space, which it adds. A
    text with a null character is one chunk."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.of_a, self.of_b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.of_a.encode_special_tokens = True  # their strings are plain text
        alphabet, tokens = byte_alphabet(), self.of_a.get_vocab()
        bytes_a = [b""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            bytes_a[i] = bytes(map(alphabet.__getitem__, token)) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.of_b.id_to_piece(i) for i in range(self.of_b.get_piece_size())]
        if any("\u2581" in p.lstrip("\u2581") for p in pieces):
            raise ValueError("a piece goes on into a space")
        self.a, self.b = Side(bytes_a), Side([*map(piece_bytes, pieces)])
        self.place: dict[str, int] = {}
        self.bad: set[int] = set()  # chunks whose bytes aren't those of their tokens

    def encoded(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of a text that begins with a space, on both sides; None where bytes differ."""
        raw, (a,) = text.encode(), self.of_a.encode_batch_fast([text], add_special_tokens=False)
        ids = a.ids, self.of_b.encode(text[1:]) or [self.of_b.piece_to_id("\u2581")]  # it adds no space to an empty text
        same = all(b"".join(map(side.tokens.__getitem__, x)) == raw for side, x in zip((self.a, self.b), ids, strict=True))
        return (np.array(ids[0], np.int64), np.array(ids[1], np.int64)) if same else None

    def learn(self, chunks: list[str], plain: list[bool]) -> None:
        """Plain chunks, which don't end in white space, can follow one another in one text."""
        queue = [[c for c, p in zip(chunks, plain, strict=True) if p][i : i + TOGETHER] for i in range(0, sum(plain), TOGETHER)] + [[c] for c, p in zip(chunks, plain, strict=True) if not p]
        found: list[list[tuple[np.ndarray, np.ndarray]]] = []
        while queue:
            some = queue.pop()
            got = self.encoded("".join(some))
            if got is None and len(some) > 1:
                queue += [[c] for c in some]
                continue
            first = len(self.place)
            self.place.update(zip(some, range(first, first + len(some)), strict=True))
            if got is None:
                self.bad.add(first)
                found.append([(np.zeros(0, np.int64), np.zeros(1, np.int64))] * 2)
                continue
            ends = np.cumsum([len(c.encode()) for c in some])
            found.append([(ids, np.diff(np.searchsorted(np.cumsum(side.width[ids]), ends, "right"), prepend=0)) for side, ids in zip((self.a, self.b), got, strict=True)])
        for k, side in enumerate((self.a, self.b)):
            if found:
                side.learn(*zip(*(x[k] for x in found), strict=True))

    def look_up(self, chunks: pa.Array) -> np.ndarray:
        """The places of distinct chunks."""
        if len(self.place) > CACHE_CHUNKS or max(self.a.used, self.b.used) > CACHE_IDS:
            self.place, self.bad = {}, set()
            self.a.clear()
            self.b.clear()
        names = chunks.to_pylist()
        fresh = [i for i, c in enumerate(names) if c not in self.place]
        if fresh:
            plain = pc.match_substring_regex(chunks.take(pa.array(fresh)), ENDS).to_pylist()
            self.learn([names[i] for i in fresh], plain)
        return np.fromiter(map(self.place.__getitem__, names), np.int64, len(names))

    def of(self, texts: pa.Array) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Of both sides the ids of all texts one after another, and how many each text has; none where its bytes differ."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))
        whole = np.asarray(pc.match_substring(texts, "\0"))
        split = pc.split_pattern(pc.replace_substring_regex(pc.if_else(pa.array(whole), "", spaced), CUT, "\\1\0\\2"), "\0")
        flat, counts = split.flatten(), split.value_lengths().to_numpy().astype(np.int64)  # each text has one chunk at least
        starts = np.cumsum(counts) - counts
        if whole.any():
            flat = pc.replace_with_mask(flat, pa.array(np.isin(np.arange(len(flat)), starts[whole])), spaced.filter(pa.array(whole)))
        coded = flat.dictionary_encode()
        codes = self.look_up(coded.dictionary)[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)
        left_out = np.asarray(pc.equal(texts, ""))
        if self.bad:
            left_out = left_out | np.logical_or.reduceat(np.isin(codes, list(self.bad)), starts)
        codes, counts, used = codes[~np.repeat(left_out, counts)], counts[~left_out], np.flatnonzero(~left_out)
        return self.a.of(codes, counts, len(texts), used), self.b.of(codes, counts, len(texts), used)


@once
def chunks_for(path_a: str, path_b: str) -> Chunks:
    """One for each Python worker, which serves many tasks."""
    return Chunks(path_a, path_b)


@dataclass(frozen=True)
class Alignment:
    """Of a batch of documents: ids of both sides and how many each document has; the links as places of tokens; of each
    token whether a group starts with it."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    opens_a: np.ndarray
    opens_b: np.ndarray

    def per_document(self, flags: np.ndarray) -> np.ndarray:
        """How many of A's tokens have the flag, by document."""
        return np.bincount(np.repeat(np.arange(len(self.n_a)), self.n_a)[flags], minlength=len(self.n_a))


def aligned(chunks: Chunks, texts: pa.Array) -> Alignment:
    (a, n_a), (b, n_b) = chunks.of(texts)
    rows = np.arange(len(n_a))

    def tokens(ids: np.ndarray, n: np.ndarray, sizes: np.ndarray) -> pd.DataFrame:
        own = sizes[ids]  # both sides tile the same bytes, so places run on from document to document
        return pd.DataFrame({"doc": np.repeat(rows, n), "at": np.cumsum(own) - own, "token": np.arange(len(ids))})

    left, right = tokens(a, n_a, chunks.a.width), tokens(b, n_b, chunks.b.width)

    def covering(x: pd.DataFrame, y: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Of each token of x the token of y that covers its start, and whether that starts there too."""
        if not len(x):
            return np.zeros(0, np.int64), np.zeros(0, bool)
        found = pd.merge_asof(x[["doc", "at"]], y, on="at", by="doc")["token"].to_numpy(np.int64)
        return found, y["at"].to_numpy()[found] == x["at"].to_numpy()

    of_b, opens_a = covering(left, right)
    of_a, opens_b = covering(right, left)
    more = np.flatnonzero(~opens_b)  # where both start, the first direction has the link
    return Alignment(a, b, n_a, n_b, np.concatenate([np.arange(len(a)), of_a[more]]), np.concatenate([of_b, more]), opens_a, opens_b)


def digests(chunks: Chunks, found: Alignment) -> list[str]:
    """SHA-256 of each document's groups, `a1,a2|b1;a3|b2,b3`; empty without tokens."""
    group_a, group_b = np.cumsum(found.opens_a), np.cumsum(found.opens_b)
    n = int(group_a[-1]) if len(group_a) else 0
    many_a, many_b = np.bincount(group_a, minlength=n + 1), np.bincount(group_b, minlength=n + 1)
    out = np.empty(2 * (len(group_a) + len(group_b)), object)
    # A token's place: the A tokens before it, and the B tokens of the groups before it (A) or up to it (B).
    place_a = np.arange(len(group_a)) + (np.cumsum(many_b) - many_b)[group_a]
    place_b = np.arange(len(group_b)) + np.cumsum(many_a)[group_b]
    out[2 * place_a], out[2 * place_b] = chunks.a.name[found.a], chunks.b.name[found.b]
    out[2 * place_a + 1] = np.where(np.append(found.opens_a[1:], True), "|", ",")
    out[2 * place_b + 1] = np.where(np.append(found.opens_b[1:], True), ";", ",")
    ends, parts = 2 * np.cumsum(found.n_a + found.n_b), out.tolist()
    starts = np.append(0, ends[:-1])
    return [hashlib.sha256("".join(parts[s : e - 1]).encode()).hexdigest() if e > s else "" for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


def _flat(n: np.ndarray) -> pa.Array:
    return pa.array(np.append(0, np.cumsum(n)), pa.int32())


def alignments(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, a, b (ids), group_a, group_b (the group of each token, from 0), link_a, link_b (places
    of the tokens of each link). A text that is null or empty, or that either tokenizer doesn't give back byte for byte, has
    no tokens. Texts of any length are read whole; repeated rows give a row each; other columns don't matter."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("a", "b", "group_a", "group_b", "link_a", "link_b"))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = chunks_for(path_a, path_b)
        for batch in sliced_bytes(batches, 1, BATCH_BYTES):
            found = aligned(chunks, batch.column(1))
            first_a, first_b = np.cumsum(found.n_a) - found.n_a, np.cumsum(found.n_b) - found.n_b
            doc_a, doc_b = np.repeat(np.arange(batch.num_rows), found.n_a), np.repeat(np.arange(batch.num_rows), found.n_b)
            opened = np.cumsum(found.opens_a)
            groups = [np.cumsum(x) - opened[first_a[d]] for x, d in ((found.opens_a, doc_a), (found.opens_b, doc_b))]
            of = doc_a[found.link_a]
            order = np.lexsort((found.link_b, found.link_a))
            links = [(x - first[of])[order] for x, first in ((found.link_a, first_a), (found.link_b, first_b))]
            n = np.bincount(of, minlength=batch.num_rows)
            lists = zip((found.n_a, found.n_b, found.n_a, found.n_b, n, n), (found.a, found.b, *groups, *links), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.ListArray.from_arrays(_flat(k), pa.array(x.astype(np.int32))) for k, x in lists)], schema.fieldNames())

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(each), schema)


def reports(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A pair of ids counts the document rows that hold it linked, over all rows. count_sum adds up the counts of a document's
    links; n_best is how many links have the highest count of their A id, ties included. Odd rows as in `alignments`: theirs
    are zeros and an empty digest; an empty table gives no rows.
    """
    id_type = docs.schema[id_col].dataType
    longs = ["n_a", "n_b", "n_groups", "n_links", "n_entries"]
    schema = T.StructType([T.StructField("batch", T.LongType()), T.StructField("doc_id", T.ArrayType(id_type)), *(T.StructField(c, T.ArrayType(T.LongType())) for c in longs), *T._parse_datatype_string("groups_sha256 array<string>, pairs array<long>, held array<int>, entries binary, times binary").fields])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, name = chunks_for(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in sliced_bytes(batches, 1, BATCH_BYTES):
            found, docs = aligned(chunks, batch.column(1)), batch.num_rows
            of = np.repeat(np.arange(docs), found.n_a)[found.link_a]
            code, pairs = pd.factorize(found.a[found.link_a].astype(np.int64) * SIDE + found.b[found.link_b])
            entry, times = np.unique(of * max(1, len(pairs)) + code, return_counts=True)
            own, entry = np.divmod(entry, max(1, len(pairs)))
            numbers = [found.n_a, found.n_b, found.per_document(found.opens_a), np.bincount(of, minlength=docs), np.bincount(own, minlength=docs)]
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            columns = [pa.array([name], pa.int64()), one(batch.column(0)), *(one(pa.array(x.astype(np.int64))) for x in numbers), one(pa.array(digests(chunks, found), pa.string())), one(pa.array(pairs)), one(pa.array(np.bincount(entry, minlength=len(pairs)).astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([entry.astype("<u2" if len(pairs) <= 1 << 16 else "<u4").tobytes()]), pa.array([times.astype("<u1" if times.max(initial=0) < 256 else "<u4").tobytes()])], schema.fieldNames())
            name += 1

    batches = saved(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(each), schema), "alignments")
    held = batches.select("batch", F.posexplode(F.arrays_zip("pairs", "held")).alias("place", "x")).select("batch", "place", F.col("x.pairs").alias("pair"), F.col("x.held").alias("held"))
    counts = held.groupBy("pair").agg(F.sum("held").alias("count"))
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("count").alias("most"))
    judged = counts.join(most, F.shiftright("pair", 32) == F.col("a")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    # Per batch, by place among its pairs: the count, negative if it isn't the A id's highest.
    found = held.join(judged, "pair").groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("place", F.when(F.col("best"), F.col("count")).otherwise(-F.col("count")).alias("count")))).alias("found"))
    looked_up = found.select("batch", F.col("found.count").alias("counts"))
    out = T.StructType([T.StructField("doc_id", id_type), *(T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), T.StructField("groups_sha256", T.StringType())])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in sliced(batches, 1):
            column = lambda c, row=row: row.column(row.schema.get_field_index(c))
            flat = lambda c, column=column: column(c).flatten().to_numpy()
            n, counts = flat("n_entries"), flat("counts")
            raw, times = column("entries")[0].as_py(), column("times")[0].as_py()
            total = int(n.sum())
            entries, times = np.frombuffer(raw, f"<u{len(raw) // total}") if total else np.zeros(0, int), np.frombuffer(times, f"<u{len(times) // total}").astype(np.int64) if total else np.zeros(0, int)
            of, count = np.repeat(np.arange(len(n)), n), counts[entries]
            sums = [np.bincount(of, w, len(n)).astype(np.int64) for w in (times * (count > 0), times * np.abs(count))]  # whole numbers below 2^53
            yield pa.RecordBatch.from_arrays([column("doc_id").flatten(), *(pa.array(flat(c)) for c in ("n_a", "n_b", "n_groups", "n_links")), *map(pa.array, sums), column("groups_sha256").flatten()], out.fieldNames())

    return batches.drop("pairs", "held").join(looked_up, "batch", "left").mapInArrow(released(summed), out)
