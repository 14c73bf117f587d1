"""Quality classifier: kernel ridge by random Fourier features over document statistics, calibrated by isotonic regression.

Statistics of whole texts are written once. Random cosines of the standardised statistics approximate a Gaussian kernel;
each task sums its rows' part of the normal equations, and the sums are added up in Spark. Rows that the fit held back
calibrate the scores: labels are summed on a fixed grid of scores, and neighbours that fall are pooled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, released, saved, sliced, utf8

#: Parameters: random features, ridge (as a share of the rows' weight), bound of standardised statistics, share held back to calibrate.
COSINES, RIDGE, BOUND, HELD_BACK = 256, 1e-4, 4.0, 5
#: The grid on which scores are calibrated: its ends and steps.
LOW, HIGH, STEPS = -0.5, 1.5, 4096
#: Doubles in a row of partial sums, and tasks that add up the sums of one part.
PART, FAN = 2048, 8
#: Classes of bytes whose shares of the characters are statistics.
BYTES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "blank": b" \t", "line": b"\n", "stop": b".", "comma": b",;:", "loud": b"!?", "quote": b"\"'()-", "pipe": b"|", "symbol": b"#$%&*@^~<>=+_\\/{}[]`", "wide": range(0xC0, 0x100), "inner": range(0x80, 0xC0), "control": [*range(9), *range(11, 32), 127]}
WORDS = ["words", "word_length", "word_spread", "long_word", "distinct", "common", "repeated", "adjacent", "ended", "lines", "line_words", "distinct_lines", "chars"]
NAMES = [*BYTES, *WORDS]
_CLASS = np.stack([np.isin(np.arange(256), list(b)) for b in BYTES.values()], axis=1).astype(float)


def statistics_of(text: bytes) -> np.ndarray:
    """All statistics of one whole text; of an empty one zeros."""
    out = np.zeros(len(NAMES))
    if not text:
        return out
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASS
    chars = len(text) - counts[len(BYTES) - 2]
    out[: len(BYTES)] = counts / chars
    words, lines = text.split(), text.split(b"\n")
    n = len(words)
    out[-1] = np.log1p(chars)
    if n:
        lengths, seen = np.fromiter(map(len, words), np.int64, n), Counter(words)
        repeats = sum(c for c in seen.values() if c > 1)
        ends = sum(w[-1] < 128 and not chr(w[-1]).isalnum() for w in words)
        out[len(BYTES) : -1] = (
            np.log1p(n), np.log1p(lengths.mean()), np.log1p(lengths.std()), (lengths > 24).mean(), np.log(len(seen)) / np.log(n + 1), max(seen.values()) / n, repeats / n,
            sum(a == b for a, b in pairwise(words)) / n, ends / n, np.log1p(len(lines)), np.log1p(n / len(lines)), len(set(lines)) / len(lines),
        )
    return out


def statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, stats (of NAMES). A null text counts as empty; texts of any length are read whole;
    repeated rows give a row each; other columns don't matter."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("stats", T.ArrayType(T.DoubleType()))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = np.concatenate([statistics_of(x) for x in utf8(batch, "text")] or [np.zeros(0)])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(NAMES)), pa.array(rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "stats"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(each), schema)


def _numbers(batch: pa.RecordBatch, column: int = 0) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def added_up(rows: DataFrame, size: int, part_of: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum over all tasks of what `part_of` gives for a task's batches: `size` doubles. Tasks pass sums on in parts; a
    bounded number of tasks adds those of one part up, so the driver gets at most FAN times `size` numbers."""
    parts = -(-size // PART)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, lane = part_of(batches), TaskContext.get().partitionId() % FAN
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([lane] * parts, pa.int32()), pa.array([total[i * PART : (i + 1) * PART].tobytes() for i in range(parts)], pa.binary())], ["part", "lane", "sums"])

    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, sums in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held[part] = held.get(part, 0) + np.frombuffer(sums)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([0] * len(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["part", "lane", "sums"])

    kind = "part int, lane int, sums binary"
    out = np.zeros(size)
    for row in rows.mapInArrow(first, kind).repartition("part", "lane").mapInArrow(then, kind).collect():  # FAN rows a part, or fewer
        out[row.part * PART : (row.part + 1) * PART] += np.frombuffer(row.sums)
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    at: np.ndarray  # calibrated scores at these ridge scores, rising
    share: np.ndarray

    def basis(self, stats: np.ndarray) -> np.ndarray:
        """1, the standardised statistics, their random cosines."""
        x = np.clip((stats - self.mean) / self.scale, -BOUND, BOUND)
        rng = np.random.Generator(np.random.PCG64(17))
        waves, phases = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], COSINES)), rng.uniform(0, 2 * np.pi, COSINES)
        return np.hstack([np.ones((len(x), 1)), x, np.sqrt(2 / COSINES) * np.cos(x @ waves + phases)])

    def ridge(self, stats: np.ndarray) -> np.ndarray:
        return self.basis(stats) @ self.weights

    def scores(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.ridge(stats), self.at, self.share)


def pooled(n: np.ndarray, positive: np.ndarray) -> list[tuple[int, int]]:
    """Isotonic regression: bounds of the blocks into which neighbours with falling shares are pooled."""
    blocks: list[list[float]] = []
    for i, (w, p) in enumerate(zip(n.tolist(), positive.tolist(), strict=True)):
        blocks.append([i, i + 1, w, p])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            _, end, w, p = blocks.pop()
            blocks[-1][1:] = [end, blocks[-1][2] + w, blocks[-1][3] + p]
    return [(int(a), int(b)) for a, b, *_ in blocks]


def fit(stats: DataFrame, labels: DataFrame, *, label_col: str = "quality") -> Model:
    """A model of `label_col` (0 or 1) from all rows of `stats` whose doc_id has labels; several labels of an id count by
    their share of ones, and each row of an id teaches. Null labels and ids teach nothing. Without any label all scores are
    0.5; with one class alone they are near it."""
    wide, k = len(NAMES), 1 + len(NAMES) + COSINES
    truth = labels.where(F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.avg((F.col(label_col) > 0).cast("double")).alias("y"))
    held_back = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(HELD_BACK)) == 0
    rows = saved(stats.join(truth, "doc_id").select("stats", "y", held_back.alias("held_back")), "quality-rows")
    learn = rows.where(~F.col("held_back")).select("stats", "y")

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(1 + 2 * wide)
        for batch in batches:
            x = _numbers(batch) if batch.num_rows else np.zeros((0, wide))
            total += np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])
        return total

    sums = added_up(learn, 1 + 2 * wide, moments)
    n = max(1.0, sums[0])
    mean = sums[1 : 1 + wide] / n
    deviation = np.sqrt(np.maximum(sums[1 + wide :] / n - mean**2, 0))
    scale = np.where(deviation > 1e-9, deviation, 1.0)
    blank = Model(mean, scale, np.zeros(k), np.array([0.0]), np.array([0.5]))
    if not sums[0]:
        return blank
    upper = np.triu_indices(k)

    def normal(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        gram, right = np.zeros((k, k)), np.zeros(k)
        for batch in sliced(batches, 4096):
            if batch.num_rows:
                z = blank.basis(_numbers(batch))
                gram += z.T @ z
                right += z.T @ batch.column(1).to_numpy()
        return np.concatenate([gram[upper], right])

    sums = added_up(learn, len(upper[0]) + k, normal)
    gram = np.zeros((k, k))
    gram[upper] = sums[: len(upper[0])]
    gram = gram + np.triu(gram, 1).T
    penalty = np.full(k, RIDGE * n)
    penalty[0] = 0
    right = sums[len(upper[0]) :]
    model = Model(mean, scale, np.linalg.solve(gram + np.diag(penalty + 1e-9 * n), right), blank.at, blank.share)
    prior = right[0] / n

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, ones = np.zeros(STEPS), np.zeros(STEPS)
        for batch in sliced(batches, 4096):
            if batch.num_rows:
                at = np.clip((model.ridge(_numbers(batch)) - LOW) / (HIGH - LOW) * STEPS, 0, STEPS - 1).astype(int)
                n += np.bincount(at, minlength=STEPS)
                ones += np.bincount(at, batch.column(1).to_numpy(), STEPS)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(ones[used])], ["step", "n", "ones"])

    check = rows.where("held_back") if rows.where("held_back").limit(1).count() else rows  # too few rows to hold any back
    grid = check.select("stats", "y").mapInArrow(placed, "step long, n double, ones double").groupBy("step").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).toPandas().sort_values("step")  # STEPS rows at most
    step, weight, ones = (grid[c].to_numpy() for c in ("step", "n", "ones"))
    at, share = [], []
    for a, b in pooled(weight, ones):
        # A block's share leans on the prior by one row, so that none is sure; it holds from its first score to its last.
        level = (ones[a:b].sum() + prior) / (weight[a:b].sum() + 1)
        at += [step[a], step[b - 1] + 1]
        share += [level, level]
    return Model(mean, scale, model.weights, LOW + (HIGH - LOW) * np.array(at) / STEPS, np.maximum.accumulate(share))


def score(stats: DataFrame, model: Model, *, least: float = 0.3) -> DataFrame:
    """One row per row of `stats`: doc_id, score (0 to 1, the calibrated chance of label 1), predicted (score of `least` or
    more). Equal texts have equal scores. An empty table gives no rows."""
    sent = stats.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([stats.schema["doc_id"], *T._parse_datatype_string("score double, predicted int").fields])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 4096):
            if batch.num_rows:
                found = sent.value.scores(_numbers(batch, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array((found >= least).astype(np.int32))], schema.fieldNames())

    return stats.select("doc_id", "stats").mapInArrow(released(each), schema)


def held_out(column: Column, *, folds: int = 5, held: int = 0) -> Column:
    """crc32 of the id as text, modulo `folds`, is `held`. A null id isn't held out."""
    return F.coalesce(crc_mod(column, folds) == held, F.lit(False))
