"""Class bigrams: words of a batch against Python's, probabilities that sum to 1, joined words against common ones, and a
gain over single words on held-out texts."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from eventmesa.llm import classlm

ODD = ["", " ", "\t a\x0b\x0cb \r\n", "É Ü a", "x\x1cy\x85z w", "A1. 12345678 ... ö! aaaaaaaaaaaaaaaaa", None, "b" * 70_000, "c " * 30_000]


def plain_shape(w):
    return min(3, len(w) // 4) + 4 * any(48 <= b <= 57 for b in w) + 8 * (w[-1] < 128 and not chr(w[-1]).isalnum())


def test_words_of_a_batch():
    words = classlm.Words(pa.array(ODD))
    tokens = [[w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] for t in ODD]
    assert words.sizes.tolist() == [len(x) for x in tokens]
    flat = [w for x in tokens for w in x]
    assert words.hashes[words.codes].tolist() == [int(np.uint64(xxhash.xxh3_64_intdigest(w)).view(np.int64)) for w in flat]
    assert words.shapes[words.codes].tolist() == [plain_shape(w) for w in flat]
    ends = np.flatnonzero(words.sequence(np.ones(len(words.hashes), np.int64), 9) == 9)
    assert np.diff(ends).tolist() == [len(x) + 1 for x in tokens]
    assert len(classlm.Words(pa.array([], pa.string())).codes) == 0
    for i in range(60):  # slices read no other texts
        some = classlm.Words(pa.array((ODD[:6] * 12)).slice(i, 6))
        assert some.sizes.tolist() == [len(tokens[k % 6]) for k in range(i, i + 6)] and set(some.hashes.tolist()) == set(words.hashes[np.unique(words.codes[: sum(map(len, tokens[:6]))])].tolist())


def sentences(n, seed):
    """Nouns follow articles, verbs nouns: a pattern that classes can learn and single words can't."""
    r = random.Random(seed)
    pick = lambda kind, k: f"{kind}{int(k * r.random() ** 2)}"
    return [" ".join(x for _ in range(r.randint(3, 9)) for x in (pick("the", 4), pick("noun", 60), pick("verb", 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(sentences(700, 1) + ODD)], "doc_id long, text string").cache()
    return docs, *classlm.fit(docs.select("text"))


def test_probabilities_sum_to_one(fitted):
    _, model, rare = fitted
    assert rare.count() == 0
    assert np.allclose((10**model.step).sum(axis=1), 1)
    emitted = np.bincount(model.class_of, 10**model.emit, len(model.room))
    known = np.bincount(model.class_of, minlength=len(model.room))
    # Of a class: its words, and room for one unknown word. The end is a class of its own.
    words = np.arange(len(model.room)) < model.end_class
    assert np.allclose((emitted + 1 / model.room)[words], 1) and known.sum() == model.types - 1


def test_held_out_gain_over_single_words(spark, fitted):
    _, model, rare = fitted
    fresh = spark.createDataFrame(list(enumerate(sentences(150, 2))), "doc_id long, text string")
    x = classlm.score(fresh, model, rare).toPandas()
    assert (x.score > x.base_score).mean() > 0.95 and x.score.sum() > 0.9 * x.base_score.sum()


def test_joined_words_score_like_common_ones(spark, fitted, monkeypatch):
    docs, model, rare = fitted
    monkeypatch.setattr(classlm, "COMMON", 5)
    monkeypatch.setattr(classlm, "least_count", lambda tokens: 40)
    few, others = classlm.fit(docs.select("text"))
    assert others.count() > 30
    monkeypatch.setattr(classlm, "COMMON", 1 << 18)
    all_common, none = classlm.fit(docs.select("text"))
    assert none.count() == 0
    order = ["doc_id", "n_tokens", "n_known"]
    a, b = (classlm.score(docs, m, x).toPandas().sort_values(order).reset_index() for m, x in ((few, others), (all_common, none)))
    assert np.allclose(a.base_score, b.base_score) and np.allclose(a.score, b.score) and (a[order] == b[order]).all().all()


def test_small_slices_change_nothing(spark, fitted, monkeypatch):
    docs, model, rare = fitted
    for name, n in (("SLICE_BYTES", 300), ("HELD", 10), ("HELD_PAIRS", 50)):
        monkeypatch.setattr(classlm, name, n)
    again, none = classlm.fit(docs.repartition(5).select("text"))
    assert again.tokens == model.tokens and np.allclose(again.step, model.step) and np.allclose(again.emit, model.emit)
