"""Fitted tree ensembles as plain arrays inside tasks: predictions of changed rows, and exact Shapley values.

A leaf's part in a prediction is a product over the features on its path: for a known feature 1 or 0, whether the row goes
there; for an unknown one, the share of the training rows that did. The Shapley values of such a product are sums over how
many of the other features are known, so a tree of depth d costs 2 ^ d leaves times d ^ 2 steps a row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import fresh_path


@dataclass(frozen=True)
class Tree:
    """Nodes by id: the feature and what goes left (a threshold, or categories), children (-1: a leaf), value, rows trained on."""

    feature: np.ndarray
    threshold: np.ndarray
    categories: dict[int, np.ndarray]
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    def goes_left(self, node: int, x: np.ndarray) -> np.ndarray:
        return self.passes(node, x[:, self.feature[node]])

    def passes(self, node: int, column: np.ndarray) -> np.ndarray:
        return np.isin(column, self.categories[node]) if node in self.categories else column <= self.threshold[node]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The node in which each row ends."""
        out = np.empty(len(x), np.int64)
        waiting = [(0, np.arange(len(x)))]
        while waiting:
            node, rows = waiting.pop()
            if self.left[node] < 0:
                out[rows] = node
            else:
                goes = self.passes(node, x[rows, self.feature[node]])
                waiting += [(self.left[node], rows[goes]), (self.right[node], rows[~goes])]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaf(x)]

    def leaves(self) -> list[tuple[int, dict[int, list[tuple[int, bool]]]]]:
        """(leaf, its path by feature: nodes, and whether the path goes left there)."""
        out, waiting = [], [(0, {})]
        while waiting:
            node, path = waiting.pop()
            if self.left[node] < 0:
                out.append((node, path))
                continue
            f = int(self.feature[node])
            for child, side in ((self.left[node], True), (self.right[node], False)):
                waiting.append((int(child), {**path, f: [*path.get(f, []), (node, side)]}))
        return out

    def share(self, steps: list[tuple[int, bool]]) -> float:
        """Of the training rows at those nodes, the share that took these steps."""
        out = 1.0
        for node, side in steps:
            out *= self.cover[self.left[node] if side else self.right[node]] / self.cover[node]
        return out

    def expected(self) -> float:
        return float(sum(self.value[leaf] * np.prod([self.share(s) for s in path.values()]) for leaf, path in self.leaves()))

    def shapley(self, x: np.ndarray, into: np.ndarray, weight: float) -> None:
        """Adds the values of all features to `into` (rows by features)."""
        went = {node: self.goes_left(node, x) for node in np.flatnonzero(self.left >= 0).tolist()}
        for leaf, path in self.leaves():
            d = len(path)
            known = {f: np.all([went[n] if side else ~went[n] for n, side in steps], axis=0).astype(float) for f, steps in path.items()}
            share = {f: self.share(steps) for f, steps in path.items()}
            for f in path:
                # by[k]: the sum over sets of k other known features of their product with the shares of the unknown ones
                by = [np.ones(len(x))]
                for g in path:
                    if g != f:
                        by = [(by[k] * share[g] if k < len(by) else 0) + (by[k - 1] * known[g] if k else 0) for k in range(len(by) + 1)]
                total = sum(factorial(k) * factorial(d - 1 - k) / factorial(d) * by[k] for k in range(d))
                into[:, f] += weight * self.value[leaf] * (known[f] - share[f]) * total


@dataclass(frozen=True)
class Ensemble:
    trees: list[Tree]
    weights: list[float]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sum((w * t.predict(x) for t, w in zip(self.trees, self.weights, strict=True)), np.zeros(len(x)))

    def changed(self, x: np.ndarray, other: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each feature that a tree splits on: the predictions of the rows with that feature's values from `other`. Only
        the trees that split on it are gone through again; of all other features the predictions stay."""
        own = [w * t.predict(x) for t, w in zip(self.trees, self.weights, strict=True)]
        base, x = sum(own, np.zeros(len(x))), x.copy()
        using: dict[int, list[int]] = {}
        for i, tree in enumerate(self.trees):
            for j in np.unique(tree.feature[tree.left >= 0]).tolist():
                using.setdefault(j, []).append(i)
        for j, some in using.items():
            kept, x[:, j] = x[:, j].copy(), other[:, j]
            yield j, base + sum(self.weights[i] * self.trees[i].predict(x) - own[i] for i in some)
            x[:, j] = kept

    def expected(self) -> float:
        """The prediction of a row of which nothing is known."""
        return sum(w * t.expected() for t, w in zip(self.trees, self.weights, strict=True))

    def shapley(self, x: np.ndarray) -> np.ndarray:
        """Rows by features; a row's values add up to its prediction minus the expected one."""
        out = np.zeros(x.shape)
        for tree, weight in zip(self.trees, self.weights, strict=True):
            tree.shapley(x, out, weight)
        return out


@dataclass(frozen=True)
class Grown:
    """A fitted model. kind: "boosted" (gives a prediction), "classes" (the probabilities of 0 and 1) or "forest" (each tree's
    leaf; `quantiles` has those of the labels by tree and node)."""

    kind: str
    ensemble: Ensemble
    quantiles: list[np.ndarray] | None = None

    def leaves(self, x: np.ndarray) -> np.ndarray:
        return np.stack([t.leaf(x) for t in self.ensemble.trees], axis=1)

    def means(self, x: np.ndarray) -> np.ndarray:
        """Rows by shares: the mean over trees of the leaves' quantiles, in order."""
        return np.sort(np.nanmean([q[t.leaf(x)] for t, q in zip(self.ensemble.trees, self.quantiles, strict=True)], axis=0), axis=1)

    def up(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-2 * self.ensemble.predict(x)))

    def transform(self, rows: DataFrame) -> DataFrame:
        """The rows, each with what the model says of its `features`."""
        sent = rows.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<double>")
        def said(x: pd.Series) -> pd.Series:
            model, data = sent.value, matrix(x)
            if not len(data):
                return pd.Series([], dtype=object)
            if model.kind == "forest":
                return pd.Series(list(model.leaves(data).astype(float)))
            if model.kind == "classes":
                up = model.up(data)
                return pd.Series(list(np.stack([1 - up, up], axis=1)))
            return pd.Series(list(model.ensemble.predict(data)[:, None]))

        found = said(vector_to_array("features"))
        if self.kind == "boosted":
            return rows.withColumn("prediction", found[0])
        return rows.withColumn("leaf" if self.kind == "forest" else "probability", array_to_vector(found))


def matrix(x: pd.Series) -> np.ndarray:
    return np.stack(x.to_numpy()) if len(x) else np.zeros((0, 0))


#: A tree of a saved model; categories are JSON.
SAVED = "head string, kind string, tree int, weight double, feature array<int>, threshold array<double>, categories string, below array<int>, beside array<int>, value array<double>, cover array<double>, quantiles array<array<double>>"


def to_rows(head: str, model: Grown) -> list[tuple]:
    """One row a tree, as SAVED says."""
    out = []
    for i, (t, w) in enumerate(zip(model.ensemble.trees, model.ensemble.weights, strict=True)):
        sets = json.dumps({str(k): v.tolist() for k, v in t.categories.items()})
        out.append((head, model.kind, i, float(w), t.feature.tolist(), t.threshold.tolist(), sets, t.left.tolist(), t.right.tolist(), t.value.tolist(), t.cover.tolist(), model.quantiles[i].tolist() if model.quantiles else None))
    return out


def from_rows(rows: list) -> Grown:
    rows, whole = sorted(rows, key=lambda r: r.tree), lambda x: np.array(x, np.int64)
    trees = [Tree(whole(r.feature), np.array(r.threshold), {int(k): np.array(v) for k, v in json.loads(r.categories).items()}, whole(r.below), whole(r.beside), np.array(r.value), np.array(r.cover)) for r in rows]
    return Grown(rows[0].kind, Ensemble(trees, [r.weight for r in rows]), [np.array(r.quantiles, float) for r in rows] if rows[0].quantiles is not None else None)


def ensemble_of(spark, model) -> Ensemble:
    """The trees of a fitted model; those of Spark's own forests and boosted models are read from their saved form: trees times
    2 ^ depth nodes at most."""
    if isinstance(model, Grown):
        return model.ensemble
    path = fresh_path(spark, "trees")
    model.write().save(path)
    nodes: dict[int, list] = {}
    for row in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():
        nodes.setdefault(row.treeID, []).append(row)
    trees = []
    for k in sorted(nodes):
        rows = sorted(nodes[k], key=lambda r: r.id)
        ids = {r.id: i for i, r in enumerate(rows)}
        at = lambda i, ids=ids: ids.get(i, -1)
        trees.append(Tree(
            np.array([r.split.featureIndex for r in rows]), np.array([r.split.leftCategoriesOrThreshold[0] if r.split.numCategories == -1 and r.split.leftCategoriesOrThreshold else np.nan for r in rows]),
            {ids[r.id]: np.array(r.split.leftCategoriesOrThreshold) for r in rows if r.split.numCategories != -1},
            np.array([at(r.leftChild) for r in rows]), np.array([at(r.rightChild) for r in rows]), np.array([r.prediction for r in rows]), np.array([float(r.rawCount) for r in rows]),
        ))
    weights = list(model.treeWeights)
    return Ensemble(trees, weights if "GBT" in type(model).__name__ else [w / sum(weights) for w in weights])
