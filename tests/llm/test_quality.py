"""Quality classifier: exact sums against numpy, isotonic blocks against a plain version, held-out accuracy, odd inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventmesa.llm import quality, queries

SF = "/root/testdata/sf0.01"


def plain_isotonic(n, ones):
    """The greatest-lower-bound formula: max over starts of min over ends of the mean."""
    out = []
    for i in range(len(n)):
        out.append(max(min(ones[a:b].sum() / n[a:b].sum() for b in range(i + 1, len(n) + 1)) for a in range(i + 1)))
    return np.array(out)


def test_pooled_blocks_are_isotonic_regression():
    r = np.random.default_rng(2)
    for _ in range(40):
        n = r.integers(1, 6, 25).astype(float)
        ones = np.floor(r.random(25) * (n + 1))
        fitted = np.zeros(25)
        for a, b in quality.pooled(n, ones):
            fitted[a:b] = ones[a:b].sum() / n[a:b].sum()
        assert np.allclose(fitted, plain_isotonic(n, ones))
    assert quality.pooled(np.zeros(0), np.zeros(0)) == []


def test_statistics_of_odd_texts():
    at = {name: i for i, name in enumerate(quality.NAMES)}
    assert not quality.statistics_of(b"").any()
    x = quality.statistics_of("Été été A!! A!!\nb | c".encode())
    assert np.isclose(x[at["pipe"]], 1 / 21) and np.isclose(x[at["loud"]], 4 / 21) and np.isclose(x[at["adjacent"]], 1 / 7) and np.isclose(x[at["wide"]], 4 / 21)
    assert np.isfinite(quality.statistics_of(bytes(range(256)) * 300)).all() and np.isfinite(quality.statistics_of(b" \n ")).all()


def test_weights_solve_the_normal_equations_of_all_rows(spark):
    r = random.Random(5)
    texts = [(i, " ".join(r.choice(["good", "words", "here.", "BAD!!", "###", "a|b"][: 3 if i % 4 else 6]) for _ in range(r.randint(1, 60)))) for i in range(900)]
    docs = spark.createDataFrame([*texts, (3, texts[3][1])], "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(900)] + [(0, 1), (1, None), (None, 1), (5000, 1)], "doc_id long, quality int")
    stats = quality.statistics(docs)
    model = quality.fit(stats, labels)
    held = {x.doc_id for x in docs.where(F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(quality.HELD_BACK)) == 0).collect()}
    rows = [(i, t) for i, t in [*texts, (3, texts[3][1])] if i not in held]
    x = np.array([quality.statistics_of(t.encode()) for _, t in rows])
    y = np.array([0.5 if i == 0 else float(i % 4 > 0) for i, _ in rows])
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale[x.std(axis=0) > 1e-6], x.std(axis=0)[x.std(axis=0) > 1e-6])
    z = model.basis(x)
    # The ridge solution is where the gradient over all rows vanishes.
    slope = z.T @ (z @ model.weights - y) + quality.RIDGE * len(y) * np.append(0, model.weights[1:])
    assert np.abs(slope).max() < 1e-3
    assert (np.diff(model.share) >= 0).all() and (np.diff(model.at) >= 0).all() and 0 < model.share[0] <= model.share[-1] < 1


def test_cosines_approximate_the_gaussian_kernel():
    n = len(quality.NAMES)
    model = quality.Model(np.zeros(n), np.ones(n), np.zeros(1), np.zeros(1), np.zeros(1))
    x = np.random.default_rng(8).normal(0, 0.7, (60, n))
    z = model.basis(x)[:, 1 + n :]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * n))
    assert np.abs(z @ z.T - exact).max() < 0.35 and np.abs(z @ z.T - exact).mean() < 0.06


@pytest.mark.parametrize("labels", ["", "x string", "1"])
def test_odd_inputs(spark, labels):
    docs = spark.createDataFrame([(1, None, "z"), (2, "", "z"), (None, "some text", "z"), (2, "w " * 90_000, "z")], "doc_id long, text string, stats string")
    given = {"": [], "x string": [(1, None)], "1": [(1, 1), (2, 1)]}[labels]
    model = quality.fit(quality.statistics(docs), spark.createDataFrame(given, "doc_id long, quality int"))
    rows = quality.score(quality.statistics(docs), model).collect()
    assert len(rows) == 4 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in rows)
    assert quality.score(quality.statistics(docs.limit(0)), model).count() == 0


def test_held_out_accuracy(spark):
    got = queries.QUERIES["op11_quality"](spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert len(got) > 50 and (got.predicted == got.quality).mean() > 0.97
    assert got[got.quality == 0].score.max() < got[got.quality == 1].score.median()
