"""Fits of many groups at once against single-node arithmetic."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from eventmesa.plans import grouped as G


@pytest.fixture(scope="module")
def rows():
    """Three models over 900 rows: the first two share rows, the third has too few to split often. The second feature is a
    category of four values, and the third is often missing."""
    r, n = np.random.default_rng(5), 900
    x = np.stack([r.normal(size=n), r.integers(0, 4, n), np.where(r.random(n) < 0.3, -1e9, r.normal(size=n).round(1)), np.ones(n)], axis=1)
    y = 2 * x[:, 0] + 3 * (x[:, 1] == 2) + 0.1 * r.normal(size=n)
    trains = [[m for m, own in ((0, i % 2 == 0), (1, i % 3 == 0), (2, i % 300 == 1)) if own] for i in range(n)]
    tests = [{5: 0.0, 7: 1.0, 11: 2.0}.get(i % 13) for i in range(n)]
    return pd.DataFrame({"key": np.arange(n) * 7919 - 1000, "y": y, "x": x.tolist(), "trains": trains, "tests": tests})


def table(spark, rows, parts):
    df = spark.createDataFrame(rows, "key long, y double, x array<double>, trains array<int>, tests double").repartition(parts)
    return G.binned(df.select("key", "y", array_to_vector("x").alias("features"), "trains", F.when(~F.isnan("tests"), F.col("tests").cast("int")).alias("tests")), {1: 4})


def plain(t, local, model, rounds):
    """A model's trees one node at a time: the predictions of all rows, by squares of every split that there is."""
    bins = np.stack([np.frombuffer(b, np.uint16) for b in local["bins"]]).astype(int)
    own = np.array([model in m for m in local["trains"]])
    pred = np.zeros(len(local))
    y = local["y"].to_numpy()

    def grow(mask, fitted, level, rest):
        value = rest[fitted & mask].mean()
        best, found = 1e-9, None
        if level < G.DEPTH:
            for j in range(bins.shape[1]):
                seen = np.unique(bins[fitted & mask, j])
                if t.nominal[j]:
                    seen = sorted(seen, key=lambda b: rest[fitted & mask & (bins[:, j] == b)].mean())
                for i in range(1, len(seen)):
                    goes = np.isin(bins[:, j], seen[:i]) if t.nominal[j] else bins[:, j] <= seen[i - 1]
                    a, b = rest[fitted & mask & goes], rest[fitted & mask & ~goes]
                    gain = a.sum() ** 2 / len(a) + b.sum() ** 2 / len(b) - (a.sum() + b.sum()) ** 2 / (len(a) + len(b))
                    if gain > best * (1 + 1e-9):
                        best, found = gain, goes
        if found is None:
            return np.where(mask, value, 0.0)
        return grow(mask & found, fitted, level + 1, rest) + grow(mask & ~found, fitted, level + 1, rest)

    for k in range(rounds):
        fitted = own & G.drawn(local["key"].to_numpy(), k)
        if fitted.any():
            pred += G.weight(k) * grow(np.ones(len(local), bool), fitted, 0, y - pred)
    return bins, own, pred


def test_fits_equal_plain_ones_and_do_not_follow_the_parts(spark, rows):
    t = table(spark, rows, 5)
    forests = G.fit(t, 3, 4)
    local = t.rows.orderBy("key").toPandas()
    for model in range(3):
        bins, own, want = plain(t, local, model, 4)
        got = forests.predict(bins, np.full(len(bins), model), 4)
        assert np.allclose(got[own], want[own], atol=1e-4)
        assert np.allclose(forests.ensemble(model).predict(bins.astype(float)), got, atol=1e-9)
    again = G.fit(table(spark, rows.sample(frac=1, random_state=1), 2), 3, 4)
    assert (again.value == forests.value).all() and (again.goes == forests.goes).all() and (again.feature == forests.feature).all()


def test_importance_is_the_mean_size_of_shapley_values(spark, rows):
    t = table(spark, rows, 3)
    forests = G.fit(t, 3, 4)
    got = G.importance(t, forests).toPandas().pivot(index="model", columns="place", values="importance")
    local = t.rows.where("tests is not null").toPandas()
    for model, own in local.groupby("tests"):
        bins = np.stack([np.frombuffer(b, np.uint16) for b in own["bins"]]).astype(float)
        values = forests.ensemble(int(model)).shapley(bins)
        assert np.allclose(values.sum(axis=1), forests.predict(bins.astype(int), np.full(len(bins), int(model)), 4) - forests.ensemble(int(model)).expected())
        assert np.allclose(got.loc[int(model)], np.abs(values).mean(axis=0))
    assert got.loc[0].idxmax() in (0, 1) and got.loc[0, 3] == 0


def test_rounds_read_their_share_by_key(rows):
    keys = rows["key"].to_numpy()
    took = np.stack([G.drawn(keys, k) for k in range(20)])
    assert abs(took.mean() - G.SHARE) < 0.02 and (took.std(axis=0) > 0).mean() > 0.9


def test_splits_of_many_nodes_are_those_of_each():
    """Every split of every node one at a time, on whole residuals; the last nodes have equal residuals, which nothing parts."""
    r, sizes, nominal = np.random.default_rng(3), np.array([5, 1, 4]), np.array([False, False, True])
    nodes = 60
    counts = np.concatenate([r.multinomial(40, np.ones(k) / k, nodes) for k in sizes], axis=1)
    sums = np.concatenate([counts[:, a:b] * r.integers(-9, 9, (nodes, b - a)) for a, b in ((0, 5), (5, 6), (6, 10))], axis=1)
    sums[:, 5] = sums[:, :5].sum(axis=1)
    sums[:, 9] += sums[:, 5] - sums[:, 6:].sum(axis=1)
    sums[-5:] = 4 * counts[-5:]
    feature, goes = G.best_splits(sums, counts, sizes, nominal)
    for p in range(nodes):
        best, found = 1e-5, None
        for j, (a, b) in enumerate(((0, 5), (5, 6), (6, 10))):
            s, n = sums[p, a:b], counts[p, a:b]
            order = sorted(np.flatnonzero(n), key=lambda i: s[i] / n[i]) if nominal[j] else list(range(b - a))
            for i in range(1, len(order)):
                left = order[:i]
                ln, ls = n[left].sum(), s[left].sum()
                if 0 < ln < n.sum():
                    gain = ls**2 / ln + (s.sum() - ls) ** 2 / (n.sum() - ln) - s.sum() ** 2 / n.sum()
                    if gain > best + 1e-5:
                        best, found = gain, (j, set(left))
        if found is None:
            assert feature[p] == 0 and goes[p].all()
        else:
            assert (feature[p], set(np.flatnonzero(goes[p]))) == found


def test_batches_are_gathered_and_none_is_lost():
    batches = [pd.DataFrame({"x": range(i)}) for i in (3, 0, 4, 9, 1, 2)]
    got = list(G.gathered(iter(batches), 7))
    assert [len(x) for x in got] == [7, 9, 3] and list(pd.concat(got)["x"]) == list(pd.concat(batches)["x"])
