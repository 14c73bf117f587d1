"""Trees of many models at once against single-node arithmetic."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventmesa.plans import attribution as T
from eventmesa.plans import grouped
from eventmesa.plans import grove as G
from eventmesa.plans import models as M
from eventmesa.plans import search
from eventmesa.sources.staging import fresh_path

from .test_models import QUARTERS, events

SIZES, NOMINAL = np.array([40, 4, 9]), np.array([False, True, False])


@pytest.fixture(scope="module")
def local():
    r, n = np.random.default_rng(4), 3000
    bins = np.stack([r.integers(0, k, n) for k in SIZES], axis=1)
    y = bins[:, 0] / 10 + 2.0 * (bins[:, 1] == 2) + r.normal(size=n)
    return pd.DataFrame({"key": r.permutation(n), "role": r.integers(0, 3, n), "y": y.round(3), "bins": bins.tolist()})


def blocks(spark, local, parts):
    rows = spark.createDataFrame(local, "key long, role int, y double, bins array<int>").select("key", "role", F.array("y").alias("y"), "bins").repartition(parts)
    return G.packed(rows, SIZES, NOMINAL, [[0, 1, 2], [0, 2], []], 1, lambda b: b.column("bins").flatten().to_numpy().reshape(b.num_rows, -1))


SPECS = [G.Spec(0, G.BAG, 3, 3, 1.0, 0.7, 20, 2), G.Spec(0, G.SQUARE, 3, 2, 0.2, 0.8), G.Spec(0, G.SQUARE, 4, 2, 0.2, 0.8)]


def grown(bins, rest, n, own, spec, t, node=0, mask=None):
    """Values and nodes of all rows, one node at a time, over every split that there is."""
    mask = np.ones(len(bins), bool) if mask is None else mask
    fitted, best, found = mask & own, 1e-9, None
    total = (rest * n)[fitted].sum()
    if node < 2**spec.depth - 1:
        for j in G.choices(t, node, bins.shape[1], spec.features):
            seen = np.unique(bins[fitted & (n > 0), j]).tolist()
            if NOMINAL[j]:
                seen.sort(key=lambda b: np.average(rest[fitted & (bins[:, j] == b)], weights=n[fitted & (bins[:, j] == b)]))
            for i in range(1, len(seen)):
                goes = np.isin(bins[:, j], seen[:i]) if NOMINAL[j] else bins[:, j] <= seen[i - 1]
                a, b = n[fitted & goes].sum(), n[fitted & ~goes].sum()
                gain = ((rest * n)[fitted & goes].sum() ** 2 / a + (rest * n)[fitted & ~goes].sum() ** 2 / b - total**2 / (a + b)) if min(a, b) >= spec.least else 0
                if gain > best * (1 + 1e-9):
                    best, found = gain, goes
    if found is None:
        return np.where(mask, total / max(n[fitted].sum(), 1), 0.0), np.where(mask, node, 0)
    (v, a), (w, b) = (grown(bins, rest, n, own, spec, t, 2 * node + 1 + side, mask & (~found if side else found)) for side in (0, 1))
    return v + w, a + b


def test_trees_of_all_models_are_plain_ones(spark, local):
    bins, y, key, role = np.stack(local["bins"]), local["y"].to_numpy(), local["key"].to_numpy(), local["role"].to_numpy()
    b = blocks(spark, local, 3)
    grove = G.grown(b, SPECS, G.Edges.all_of(3, SIZES))
    quantiles = G.leaf_quantiles(b, grove, [0], np.array([0.0, 1.0, 2.5]), (0.1, 0.5, 0.9))
    for m, (spec, roles) in enumerate(zip(SPECS, ((0, 1), (0,), (0, 1)), strict=True)):
        own, f, trees = np.isin(role, roles), np.zeros(len(y)), grove.ensemble(m).trees
        for t in range(spec.trees):
            n = G.times(key, t, spec.share).astype(int) if spec.kind == G.BAG else G.drawn(key, t, spec.share).astype(int)
            value, node = grown(bins, y - f if spec.kind == G.SQUARE else y, n, own, spec, t)
            assert np.allclose(trees[t].predict(bins.astype(float)), value, atol=1e-4) and (trees[t].leaf(bins.astype(float)) == node).all()
            f += grove.weight(m, t) * value
            if spec.kind == G.BAG:
                for leaf in np.unique(node[own]):
                    known = np.sort(y[own & (node == leaf)])
                    at = G.leftmost(int(leaf), 7) - 7
                    assert quantiles[m, t][at].tolist() == [known[max(0, int(np.ceil(q * len(known))) - 1)] for q in (0.1, 0.5, 0.9)]
    again = G.grown(blocks(spark, local.sample(frac=1, random_state=3), 1), SPECS, G.Edges.all_of(3, SIZES))
    assert all((x == z).all() for name in ("feature", "cut", "value") for x, z in zip(getattr(grove, name), getattr(again, name), strict=True))


def test_all_folds_grow_in_the_passes_of_one(spark, monkeypatch):
    """Passes follow from trees and levels, not from folds."""
    table, passes, level = events(spark, 30), [], G.grow_level
    monkeypatch.setattr(G, "grow_level", lambda *a: passes.append(len({m for m, _ in a[3]})) or level(*a))
    monkeypatch.setattr(M, "ROUNDS", 2)
    monkeypatch.setattr(M, "boosted_spec", lambda rounds=2: G.Spec(1, G.SQUARE, 2, 3, 0.2, 0.8))
    monkeypatch.setattr(M, "classes_spec", lambda rounds=2: G.Spec(2, G.LOGIT, 2, 3, 0.1))
    assert [f.k for f in M.fitted_folds(table, [QUARTERS[11]])] == [11]
    one, passes[:] = len(passes), []
    assert len(M.fitted_folds(table)) == 2 and len(passes) == one and max(passes) == 6


def test_folds_are_attributed_together_as_each_alone(spark, monkeypatch):
    """The tested rows are written and gone through once, however many folds there are."""
    monkeypatch.setattr(M, "ROUNDS", 2)
    monkeypatch.setattr(M, "boosted_spec", lambda rounds=2: G.Spec(1, G.SQUARE, 2, 2, 0.2, 0.8))
    monkeypatch.setattr(M, "classes_spec", lambda rounds=2: G.Spec(2, G.LOGIT, 1, 1, 0.1))
    folds, names, written = M.fitted_folds(events(spark, 30)), [], T.written
    monkeypatch.setattr(T, "written", lambda df, name: names.append(name) or written(df, name))
    got = {(r.fold, r.feature): r for r in T.of_folds(folds).collect()}
    assert names == ["tested", "fold-attribution"] and {k for k, _ in got} == {f.k for f in folds}
    schema = folds[1].heads[0]
    rows = M.vectors(M.aligned(folds[1].tested, schema), schema)
    for r in T.shapley_importance(folds[1].heads[2], rows, schema.columns).collect():
        assert got[folds[1].k, r.feature].importance == pytest.approx(r.importance) and got[folds[1].k, r.feature].direction == pytest.approx(r.direction)
    for r in T.permutation_importance(folds[1].heads[2], rows, schema.columns, M.Z).collect():
        assert got[folds[1].k, r.feature].perm == pytest.approx(r.perm)


def test_trials_of_a_rung_grow_together_over_one_table(spark, monkeypatch):
    """Tables are binned once for all folds and trials, and forests grow once a rung."""
    table, calls, grown, packed = events(spark, 30), [], G.grown, G.packed
    monkeypatch.setattr(G, "grown", lambda *a: calls.append(len(a[1])) or grown(*a))
    monkeypatch.setattr(G, "packed", lambda *a: calls.append("packed") or packed(*a))
    monkeypatch.setattr(search, "drawn", lambda trial, seed=7: {"numTrees": 2 + trial, "maxDepth": 2, "minInstancesPerNode": 20, "subsamplingRate": 0.5, "featureSubsetStrategy": "0.9"})
    found = search.param_search(table, trials=2, root=fresh_path(spark, "search"))
    assert calls == ["packed", 4, 1] and found.trials.count() == 3


def test_subgroups_grow_in_a_pass_a_level(spark, local, monkeypatch):
    passes, level = [], G.grow_level
    monkeypatch.setattr(G, "grow_level", lambda *a: passes.append(len(a[3])) or level(*a))
    own = local.assign(trains=[[0, 1] if r else [1] for r in local["role"]], bins=[np.array(b, np.uint16).tobytes() for b in local["bins"]])
    rows = spark.createDataFrame(own.drop(columns="role"), "key long, y double, bins binary, trains array<int>")
    forests = grouped.fit(grouped.Binned(rows, SIZES, NOMINAL), 2, 2)
    assert passes == [2] * (2 * grouped.DEPTH) and forests.split[:, :, 0].all()
