"""LM scoring by Brown class-based bigrams.

An exchange algorithm moves all words above a count that is relative to the corpus between classes, whose number grows
with them, so that class bigrams explain the corpus best; rarer words belong to classes by their shape. A token's
probability is that of its class after the last token's class, times its own within the class, both smoothed. All counts
are taken over all training texts, by Spark; each round passes over a written table of every word's neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, released, saved, sliced, sliced_bytes

#: Parameters of the model: fewest classes of exchanged words, and shapes of other words.
CLASSES, SHAPES = 32, 16
#: Rounds end when the last two gained less than so much log-likelihood a token, or after this many.
STILL, ROUNDS = 0.002, 40
#: Words whose counts every task holds; the counts of rarer ones are joined. A bound, not a cut: both give the same sums.
COMMON = 1 << 18
END = 0
#: Of each byte, whether it is ASCII but no letter or digit.
IS_MARK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Word counts, or bigrams, that a task holds before it adds them up and passes them on; bytes of text that it takes at once.
HELD, HELD_PAIRS, SLICE_BYTES = 2_000_000, 4_000_000, 4_000_000
WORD_SHAPES = "word long, shape int, n long"


def shapes_of(words: pa.LargeStringArray) -> np.ndarray:
    """Classes for words that aren't exchanged: by length, a digit, a mark at the end. No word is empty."""
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    last = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[1:] - 1]
    digit = pc.match_substring_regex(words, "[0-9]").to_numpy(zero_copy_only=False)
    return np.minimum(3, np.diff(ends) // 4) + 4 * digit + 8 * IS_MARK[last]


def least_count(tokens: int) -> int:
    """Of a word that is exchanged. It grows as the root of the corpus, and so do the words that reach it."""
    return max(1, math.isqrt(tokens) // 512)


def classes_for(exchanged: int) -> int:
    """They grow as the cube root of the words, so that a round's work per word grows slowly."""
    return max(CLASSES, round(2 * exchanged ** (1 / 3)))


class Words:
    """The words of a batch of texts, lower-cased (A-Z): the distinct ones with their hashes and shapes, and for each token
    the place of its word; `sizes` has the tokens of each text."""

    def __init__(self, texts: pa.Array):
        whole = pa.concat_arrays([texts]).cast(pa.large_string())  # a copy: lower-casing a slice reads past it
        lower = pc.ascii_lower(pc.fill_null(whole, ""))
        split = pc.ascii_split_whitespace(lower)
        tokens, sizes = split.flatten(), split.value_lengths().to_numpy().astype(np.int64)
        there = pc.not_equal(tokens, "").to_numpy(zero_copy_only=False)  # white space at an end leaves an empty word
        if not there.all():
            of = np.repeat(np.arange(len(sizes)), sizes)
            tokens, sizes = tokens.filter(pa.array(there)), np.bincount(of[there], minlength=len(sizes))
        coded = tokens.dictionary_encode()
        self.codes, self.sizes = coded.indices.to_numpy().astype(np.int64), sizes
        words = coded.dictionary.to_pylist()
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)
        self.shapes = shapes_of(coded.dictionary) if words else np.zeros(0, np.int64)
        self.text_of = np.repeat(np.arange(len(sizes)), sizes)

    def sequence(self, values: np.ndarray, end: int) -> np.ndarray:
        """`values` of the tokens' words, with an end before, between and after the texts."""
        out = np.full(len(self.codes) + len(self.sizes) + 1, end, np.int64)
        out[np.arange(len(self.codes)) + 1 + self.text_of] = values[self.codes]
        return out


def batches_of_words(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for batch in sliced_bytes(batches, column, SLICE_BYTES):
        yield batch, Words(batch.column(column))


def unigrams(texts: DataFrame) -> DataFrame:
    """word (64-bit hash; END for a text's end), shape, n over all texts; tasks add up what they read before it is dealt out."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ends = [], 0, 0

        def flush() -> pa.RecordBatch:
            word, shape, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(word, kind="stable")
            starts = np.flatnonzero(np.diff(word[order], prepend=word[order[0]] - 1))
            return pa.RecordBatch.from_arrays([pa.array(word[order][starts]), pa.array(shape[order][starts].astype(np.int32)), pa.array(np.add.reduceat(n[order], starts))], ["word", "shape", "n"])

        for batch, words in batches_of_words(batches, 0):
            if len(words.hashes):
                held.append((words.hashes, words.shapes, np.bincount(words.codes, minlength=len(words.hashes))))
                size += len(words.hashes)
            ends += batch.num_rows
            if size > HELD:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.int64()), pa.array([-1], pa.int32()), pa.array([ends], pa.int64())], ["word", "shape", "n"])

    return texts.mapInArrow(released(each), WORD_SHAPES).groupBy("word").agg(F.min("shape").alias("shape"), F.sum("n").alias("n"))


class Places:
    """64-bit hash -> place of the word in an order, in 12 bytes a word."""

    def __init__(self, words: np.ndarray):
        order = np.argsort(words)
        self.words, self.order = words[order].astype(np.int64), order.astype(np.int32)

    def of(self, words: np.ndarray) -> np.ndarray:
        """The places of many words; -1 of those that have none."""
        if not len(self.words):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.order[at].astype(np.int64), -1)


def bigrams(texts: DataFrame, places: Places, exchanged: int) -> DataFrame:
    """a, b (ids; the last stands for a text's end, which also comes before its first word), n."""
    ids = exchanged + SHAPES + 1
    sent = texts.sparkSession.sparkContext.broadcast(places)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, held = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            found, n = np.unique(np.concatenate(codes), return_counts=True)
            for i in range(0, len(found), 100_000):
                some = found[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array((some // ids).astype(np.int32)), pa.array((some % ids).astype(np.int32)), pa.array(n[i : i + 100_000].astype(np.int64))], ["a", "b", "n"])

        for _, words in batches_of_words(batches, 0):
            place = sent.value.of(words.hashes)
            own = words.sequence(np.where(place < 0, exchanged + words.shapes, place), ids - 1)
            codes.append(own[:-1] * ids + own[1:])
            held += len(own) - 1
            if held > HELD_PAIRS:
                yield from flush()
                codes, held = [], 0
        if codes:
            yield from flush()

    return texts.mapInArrow(released(each), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def neighbours(pairs: DataFrame, ids: int, count: type = np.int64) -> DataFrame:
    """One row an id: word, at (ids that come after it; those before it plus `ids`) and n (how often each does), as bytes
    of 32-bit integers and of `count`, which pass between Spark and Python whole."""

    def lists(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        word = rows["word"].to_numpy()
        starts = np.flatnonzero(np.diff(word, prepend=-1))

        def packed(numbers: np.ndarray) -> pa.BinaryArray:
            ends = (numbers.itemsize * np.append(starts, len(word))).astype(np.int32)
            return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(numbers.tobytes())])

        return pa.RecordBatch.from_arrays([pa.array(word[starts]), packed(rows["at"].to_numpy().astype(np.int32)), packed(rows["n"].to_numpy().astype(count))], ["word", "at", "n"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of a word that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            word = batch.column(0).to_numpy()
            if held and word[-1] != held[-1].column(0)[-1].as_py():
                cut = int(np.searchsorted(word, word[-1]))
                yield lists([*held, batch.slice(0, cut)])
                held = [batch.slice(cut)]
            else:
                held.append(batch)
                if word[0] != word[-1]:
                    cut = int(np.searchsorted(word, word[-1]))
                    yield lists([*held[:-1], batch.slice(0, cut)])
                    held = [batch.slice(cut)]
        if held:
            yield lists(held)

    sides = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("at")), F.struct(F.col("b").alias("word"), (F.col("a") + F.lit(ids)).alias("at")))
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pairs.select(F.explode(sides).alias("side"), "n").select("side.word", "side.at", "n")
    return rows.repartition(n, "word").sortWithinPartitions("word").mapInArrow(released(each), "word int, at binary, n binary")


def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of neighbours: how many each has, and all their ids and counts."""

    def numbers(column: pa.BinaryArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
        wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
        ends = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1]
        return np.diff(ends) // np.dtype(kind).itemsize, np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind)

    (sizes, at), (many, n) = numbers(batch.column(1), np.int32), numbers(batch.column(2), np.int32)
    return sizes, at, n if many.sum() == len(at) else n.view(np.int64)


def exchange_round(near: DataFrame, classes: np.ndarray, gain: np.ndarray, movers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One pass over all neighbours: how often each class follows each under `classes`; the movers, and the classes that the
    counts of their neighbours' classes fit best under `gain`. Tasks add up class counts before Spark does."""
    count, learnt, ids, spark = len(gain), len(gain) - SHAPES - 1, len(classes), near.sparkSession
    fits = np.concatenate([gain.T[:, :learnt], gain[:, :learnt]]).astype(np.float32)
    sent = spark.sparkContext.broadcast((np.concatenate([classes, count + classes]), fits, movers))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (classes, fits, movers), total = sent.value, np.zeros((count, count))
        for batch in sliced(batches, 512):
            word = batch.column(0).to_numpy()
            sizes, at, n = flat(batch)
            own = np.repeat(np.arange(batch.num_rows) * 2 * count, sizes)
            seen = np.bincount(own + classes[at], n, batch.num_rows * 2 * count).reshape(-1, 2 * count)
            np.add.at(total, classes[word], seen[:, :count])
            here = np.flatnonzero((word < len(movers)) & movers[np.minimum(word, len(movers) - 1)]) if len(movers) else np.zeros(0, int)
            if len(here):
                best = (seen[here].astype(np.float32) @ fits).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(word[here].astype(np.int64)), pa.array(best)], ["key", "value"])
        cells = np.flatnonzero(total)
        if len(cells):
            yield pa.RecordBatch.from_arrays([pa.array(ids + cells), pa.array(total.ravel()[cells].astype(np.int64))], ["key", "value"])

    # A word has one row; the cells of the class table, which have keys beyond all words, are added up.
    rows = near.mapInArrow(released(each), "key long, value long").groupBy("key").agg(F.sum("value").alias("value")).toArrow()
    key, value = rows["key"].to_numpy(), rows["value"].to_numpy()
    table = np.zeros(count * count)
    table[key[key >= ids] - ids] = value[key >= ids]
    return table.reshape(count, count), key[key < ids], value[key < ids]


def likelihood(table: np.ndarray) -> float:
    """What classes make of the log-likelihood of their words' bigrams."""
    own, known = table.sum(axis=1), table[table > 0]
    return float((known * np.log(known)).sum() - 2 * (own[own > 0] * np.log(own[own > 0])).sum())


def exchange(near: DataFrame, exchanged: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of each id, and class bigram counts. In each round one half of the words moves to the classes that the
    counts of their neighbours' classes fit best, as the class counts of the round before have it; the classes with the best
    likelihood count."""
    learnt, rng = classes_for(exchanged), np.random.default_rng(5)
    count = learnt + SHAPES + 1
    classes = np.concatenate([np.arange(exchanged) % learnt, learnt + np.arange(SHAPES + 1)])
    nobody = np.zeros(exchanged, bool)
    table, *_ = exchange_round(near, classes, np.zeros((count, count)), nobody)
    best, fits = (likelihood(table), classes, table), [likelihood(table)]
    for turn in range(ROUNDS if exchanged else 0):
        own = table.sum(axis=1)
        gain = np.log((table + 0.1) / (own[:, None] + 1) / (own[None, :] + 1))
        table, moved, to = exchange_round(near, classes, gain, rng.permutation(exchanged) % 2 == turn % 2)
        # This pass has the counts of the classes before its moves, so these are judged by the next one.
        fits.append(likelihood(table))
        if fits[-1] > best[0]:
            best = (fits[-1], classes, table)
        if turn > 2 and fits[-1] - fits[-3] < STILL * table.sum():
            break
        classes = classes.copy()
        classes[moved] = to
    return best[1], best[2]


def ranked(n: np.ndarray, word: np.ndarray) -> np.ndarray:
    return np.lexsort((word, -n))


class Model:
    """What scoring tasks need: the exchanged and other common words with their counts, classes and logarithms."""

    def __init__(self, words, counts, shapes, exchanged, classes, table, tokens, types, ends, class_types):
        self.tokens, self.types, self.ends = tokens, types, ends
        own = table.sum(axis=0)
        k = len(own)
        self.exchanged, self.learnt = exchanged, k - SHAPES - 1
        self.step = np.log10((table + 0.5) / (table.sum(axis=1, keepdims=True) + 0.5 * k))
        self.room = own + class_types + 1  # of each class: its tokens, its words and an unknown one
        self.class_of = np.concatenate([classes[:exchanged], self.learnt + shapes[exchanged:]]).astype(np.int64)
        self.place = Places(words)
        self.emit = np.log10((counts + 1) / self.room[self.class_of])
        self.base = np.log10((counts + 1) / (tokens + types + 1))
        self.end_class = k - 1
        self.rare_room = np.log10(self.room[self.learnt : self.learnt + SHAPES])


def fit(texts: DataFrame) -> tuple[Model, DataFrame]:
    """texts: text. The model, and the counts of the words too rare to be part of it (word, n)."""
    counts = saved(unigrams(texts), "unigrams")
    tokens, types, ends = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == END, F.col("n"))), F.lit(0))).first()
    # The least count of a common word, on a scale of a few thousand steps.
    level = F.floor(F.log2("n") * 64).cast("int")
    words = counts.where(F.col("word") != END)
    steps, total, least = sorted(words.groupBy(level.alias("level")).count().collect(), reverse=True), 0, None
    for row in steps:
        total += row["count"]
        if total > COMMON:
            break
        least = row["level"]
    is_common = F.col("n") >= least_count(tokens)
    is_common = is_common if least is None else is_common | (level >= least)
    held = words.where(is_common).toArrow()  # at most COMMON rows, or as many as are exchanged
    word, n, shapes = (held[c].to_numpy() for c in ("word", "n", "shape"))
    order = ranked(n, word)
    word, n, shapes = word[order], n[order], shapes[order].astype(np.int64)
    exchanged = int((n >= least_count(tokens)).sum())
    near = saved(neighbours(bigrams(texts, Places(word[:exchanged]), exchanged), exchanged + SHAPES + 1, np.int32 if tokens < 1 << 31 else np.int64), "neighbours")
    classes, table = exchange(near, exchanged)
    learnt = classes_for(exchanged)
    class_types = np.zeros(learnt + SHAPES + 1)
    np.add.at(class_types, classes[:exchanged], 1)
    for row in words.groupBy("shape").count().collect():
        class_types[learnt + row["shape"]] += row["count"]
    np.add.at(class_types, learnt + shapes[:exchanged], -1)
    return Model(word, n, shapes, exchanged, classes, table, tokens, types, ends, class_types), words.where(~is_common).select("word", F.col("n").alias("c"))


def score(docs: DataFrame, model: Model, rare: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_tokens, n_known, base_score, score.

    Tokens are the lower-cased (A-Z) words and one end; null is an empty text, which is its end alone. base_score is the
    add-one unigram log10 probability, score that of the class model. Without training texts every word is unknown.
    Repeated rows give a row each; other columns don't matter.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), *T._parse_datatype_string("row long, word long, shape int, n long, n_tokens long, n_known long, base double, score double").fields])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        row, end_base = TaskContext.get().partitionId() << 36, np.log10((m.ends + 1) / (m.tokens + m.types + 1))
        for batch, words in batches_of_words(batches, 1):
            count, place = batch.num_rows, m.place.of(words.hashes)
            common = place >= 0
            at = np.maximum(place, 0)
            classes = words.sequence(np.where(common, m.class_of[at] if len(m.class_of) else 0, m.learnt + words.shapes), m.end_class)
            own = lambda values: np.bincount(words.text_of, np.where(common, values[at] if len(values) else 0.0, 0.0)[words.codes], count)  # noqa: B023, E731
            there = np.bincount(words.text_of, common[words.codes], count).astype(np.int64) + (m.ends > 0)
            steps = np.add.reduceat(m.step[classes[:-1], classes[1:]], np.cumsum(words.sizes + 1) - words.sizes - 1) if count else np.zeros(0)
            rows = row + np.arange(count)
            # A row of sums has a key that no word has to match; it keeps such rows from meeting in one place.
            keys = (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows), pa.array(keys), pa.nulls(count, pa.int32()), pa.nulls(count, pa.int64()), pa.array(words.sizes + 1), pa.array(there), pa.array(own(m.base) + end_base), pa.array(own(m.emit) + steps)], schema.fieldNames())
            row += count
            few, n = np.unique((words.text_of * max(1, len(common)) + words.codes)[~common[words.codes]], return_counts=True)
            for i in range(0, len(few), 100_000):
                of, word = np.divmod(few[i : i + 100_000], len(common))
                total = len(of)
                none = [pa.nulls(total, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.nulls(total, batch.schema.field(0).type), pa.array(rows[of]), pa.array(words.hashes[word]), pa.array(words.shapes[word].astype(np.int32)), pa.array(n[i : i + 100_000]), *none], schema.fieldNames())

    parts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(each), schema)
    joined = parts.join(rare, "word", "left")
    c, n = F.coalesce("c", F.lit(0)), F.col("n")
    room = F.element_at(F.array(*(F.lit(float(x)) for x in model.rare_room)), F.col("shape") + 1)
    by_row = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"),
        (F.coalesce(F.max("n_known"), F.lit(0)) + F.coalesce(F.sum(F.when(c > 0, n)), F.lit(0))).alias("n_known"),
        (F.max("base") + F.coalesce(F.sum(n * (F.log10(c + 1) - F.lit(float(np.log10(model.tokens + model.types + 1))))), F.lit(0.0))).alias("base_score"),
        (F.max("score") + F.coalesce(F.sum(n * (F.log10(c + 1) - room)), F.lit(0.0))).alias("score"),
    )
    return by_row.drop("row")


def teaching(docs: DataFrame, *, id_col: str = "doc_id", folds: int = 7, held: int = 2) -> DataFrame:
    """The rows to learn from: crc32 of the id as text, modulo `folds`, isn't `held`. A null id isn't held out."""
    return docs.where(~F.coalesce(crc_mod(F.col(id_col), folds) == held, F.lit(False)))
