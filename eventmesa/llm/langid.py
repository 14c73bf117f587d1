"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its words' letter n-grams, hashed into a fixed number of rows; a linear layer
and softmax over the languages follow. Training is stochastic gradient descent in numpy on a bounded sample of labelled
rows; a held-back part of it calibrates a temperature and the confidence below which a text is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CACHE_WORDS, crc_mod, released, sliced, utf8

#: About how many labelled rows training looks at, as equal shares of the languages. The only bound in this operator.
SAMPLE_ROWS = 6000
BUCKETS, WIDTH, LONGEST = 1 << 14, 16, 4
#: Words that a task keeps the scores of (a row of languages each), and of whose letters it makes n-grams at a time.
KNOWN_WORDS, LEARNT_AT_ONCE = CACHE_WORDS // 4, 4096
#: Texts without any letter.
UNKNOWN = "und"


def letters(word: bytes) -> str:
    text = word.decode(errors="ignore").lower()
    return text if text.isalpha() else "".join(filter(str.isalpha, text))


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of its word) of all n-grams of 1 to LONGEST letters, a mark at either end of a word counting as one."""
    chars = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    own = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    buckets, owners = [], []
    rolled = np.zeros(len(chars), np.uint64)
    for n in range(1, LONGEST + 1):
        rolled = rolled[: len(chars) - n + 1] * np.uint64(0x100000001B3) + chars[n - 1 :]
        inside = own[: len(rolled)] == own[n - 1 :]
        if n == 1:
            inside &= (chars != ord("<")) & (chars != ord(">"))
        mixed = (rolled[inside] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        buckets.append((mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64))
        owners.append(own[: len(rolled)][inside])
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    scores: np.ndarray  # of each bucket for each language: embedding times linear layer
    bias: np.ndarray
    temperature: float
    reject_below: float

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=-1, keepdims=True))
        return z / z.sum(axis=-1, keepdims=True)


class WordScores(dict):
    """word -> row of a growing table with the word's summed scores and its number of subwords."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.width = model, len(model.languages) + 1
        self.table = np.zeros((1024, self.width))

    def learn(self, words: set[bytes]) -> None:
        first, forms = len(self), [letters(w) for w in words]
        self.update(zip(words, range(first, first + len(forms)), strict=True))
        if len(self) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(len(self.table), len(self) - len(self.table)), self.width))])
        for at in range(0, len(forms), LEARNT_AT_ONCE):
            some = forms[at : at + LEARNT_AT_ONCE]
            rows, (buckets, owners) = self.table[first + at : first + at + len(some)], subwords(some)
            for i in range(self.width - 1):
                rows[:, i] = np.bincount(owners, self.model.scores[buckets, i], len(some))
            rows[:, -1] = np.bincount(owners, minlength=len(some))
            rows[np.array([not f for f in some])] = 0

    def logits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text, and its number of subwords."""
        split = [t.split() for t in texts]
        words = set().union(*split)
        if fresh := words - self.keys():
            if self and len(self) + len(fresh) > KNOWN_WORDS:
                self.clear()
                fresh = words  # those that were known are needed too
            self.learn(fresh)
        sums = np.array([self.table[np.fromiter(map(self.__getitem__, w), np.int64, len(w))].sum(axis=0) if w else np.zeros(self.width) for w in split]).reshape(-1, self.width)
        return sums[:, :-1] / np.maximum(sums[:, -1:], 1) + self.model.bias, sums[:, -1]


@dataclass(frozen=True)
class Counts:
    """The bucket counts of training rows, as flat arrays: row i has the entries from starts[i] to starts[i + 1]."""

    starts: np.ndarray
    at: np.ndarray  # int16, a bucket
    share: np.ndarray  # float32, of the row's subwords

    def __len__(self) -> int:
        return len(self.starts) - 1

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.starts[i], self.starts[i + 1]
        return self.at[a:b], self.share[a:b]

    def some(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place among `rows`, bucket, share) of all their entries."""
        parts = [self.row(i) for i in rows]
        return np.repeat(np.arange(len(rows)), [len(x) for x, _ in parts]), np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])


def trained(counts: Counts, targets: np.ndarray, languages: list[str], *, epochs: int = 12, batch: int = 32, rate: float = 4.0, seed: int = 11) -> Model:
    """Every fifth row calibrates and isn't learnt from."""
    rng = np.random.default_rng(seed)
    n, k = len(counts), len(languages)
    table, layer, bias = rng.normal(0, 0.1, (BUCKETS, WIDTH)), np.zeros((WIDTH, k)), np.zeros(k)
    held = np.arange(n) % 5 == 4 if n >= 20 else np.zeros(n, bool)
    learn = np.flatnonzero(~held)
    steps, step = max(1, epochs * -(-len(learn) // batch)), 0
    for _ in range(epochs):
        order = rng.permutation(learn)
        for i in range(0, len(order), batch):
            some, lr = order[i : i + batch], rate * (1 - step / steps)
            step += 1
            rows, at, share = counts.some(some)
            used, inverse = np.unique(at, return_inverse=True)
            dense = np.zeros((len(some), len(used)))
            dense[rows, inverse] = share
            mean = dense @ table[used]
            z = mean @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), targets[some]] -= 1
            p /= len(some)
            back = p @ layer.T
            layer -= lr * mean.T @ p
            bias -= lr * p.sum(axis=0) * 0.1
            table[used] -= lr * 16 * dense.T @ back
    scores = table @ layer
    model = Model(languages, scores, bias, 1.0, 0.0)
    check = np.flatnonzero(held) if held.any() else np.arange(n)
    logits = np.array([share @ scores[at] + bias for at, share in map(counts.row, check)]).reshape(-1, k)
    # Sharpening past the likelihood that training fitted (below 1) would make every text look sure.
    loss = {t: -np.log(np.maximum(Model(languages, scores, bias, t, 0).probabilities(logits)[np.arange(len(check)), targets[check]], 1e-12)).mean() for t in np.geomspace(1, 8, 24)} if len(check) else {1.0: 0}
    temperature = float(min(loss, key=loss.get))
    best = Model(languages, scores, bias, temperature, 0).probabilities(logits)
    right = np.sort(best.max(axis=1)[best.argmax(axis=1) == targets[check]]) if len(check) else np.zeros(0)
    # A text is rejected when it is less sure, by a tenth, than all but one in two hundred of the right answers.
    least = float(right[len(right) // 200]) * 0.9 if len(right) else 0.0
    return Model(model.languages, scores, bias, temperature, least)


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of the languages in `lang_col`, from about `sample_rows` rows chosen by a hash of their ids, whole texts.

    Rows with null text or language teach nothing; repeated rows each teach. With no labelled row there is no language,
    and all texts are unknown. The driver holds at most BUCKETS entries of 6 bytes for each sampled row.
    """
    labelled = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).na.drop(subset=["text", "lang"])
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, sample_rows / len(languages) / sizes[lang])))])
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = []
            for text in utf8(batch, "text"):
                forms = [f for f in map(letters, text.split()) if f]
                at, n = np.unique(subwords(forms)[0], return_counts=True) if forms else (np.zeros(0, int), np.zeros(0, int))
                found.append((at.astype(np.int16), (n / max(1, n.sum())).astype(np.float32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x for x, _ in found], pa.list_(pa.int16())), pa.array([x for _, x in found], pa.list_(pa.float32()))], ["key", "lang", "at", "share"])

    rows = labelled.where(draw < share[F.col("lang")]).select(F.xxhash64("doc_id", "text").alias("key"), "text", "lang").mapInArrow(released(count), "key long, lang string, at array<short>, share array<float>").toArrow()
    order = np.argsort(rows["key"].to_numpy(), kind="stable")  # a sample reads alike however Spark cut it into tasks
    targets = np.array([languages.index(x) for x in rows["lang"].to_pylist()], np.int64)[order]
    sizes_of = rows["at"].combine_chunks().value_lengths().to_numpy() if rows.num_rows else np.zeros(0, np.int64)
    at, shares = (np.concatenate([c.flatten().to_numpy() for c in rows[name].chunks] or [np.zeros(0, kind)]) for name, kind in (("at", np.int16), ("share", np.float32)))
    del rows
    ends = np.cumsum(sizes_of)
    places = np.concatenate([np.arange(ends[i] - sizes_of[i], ends[i], dtype=np.int32) for i in order] or [np.zeros(0, np.int32)])
    return trained(Counts(np.concatenate([[0], np.cumsum(sizes_of[order])]), at[places], shares[places]), targets, languages)


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, lang_pred, score (calibrated probability), rejected.

    A null text or one without a letter is `und` with score 0 and rejected. Texts of any length are read whole. Ties go
    to the language that sorts first. Only the text matters; other columns don't.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *T._parse_datatype_string("lang_pred string, score double, rejected boolean").fields])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        words = WordScores(model)
        for batch in sliced(batches):
            if model.languages:
                logits, sizes = words.logits(utf8(batch, "text"))
                p = model.probabilities(logits)
                best, score, known = p.argmax(axis=1), p.max(axis=1), sizes > 0
                names = [model.languages[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)]
            else:
                names, score, known = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            score = np.where(known, score, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(~known | (score < model.reject_below))], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(each), schema)


def keep_known(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, whose language isn't rejected. A null text or one without a letter is
    rejected; repeated rows share a verdict; other columns don't matter, whatever their names. A model without languages
    keeps nothing, and an empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        words = WordScores(model)
        for batch in sliced(batches):
            if model.languages:
                texts = [x or b"" for x in batch.column(at).cast(pa.large_binary()).to_pylist()]
                logits, sizes = words.logits(texts)
                kept = (sizes > 0) & (model.probabilities(logits).max(axis=1) >= model.reject_below)
                yield batch.filter(pa.array(kept))

    return docs.mapInArrow(released(each), docs.schema)


def teaching(docs: DataFrame, *, id_col: str = "doc_id", folds: int = 4, held: int = 2) -> DataFrame:
    """The rows that may be learnt from: crc32 of the id as text, modulo `folds`, isn't `held`. A null id isn't held out."""
    return docs.where(~F.coalesce(crc_mod(F.col(id_col), folds) == held, F.lit(False)))
