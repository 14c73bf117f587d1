"""Boosted trees of many overlapping groups of rows at once: one binned table, and one pass a level for all models.

A row names the models that train on it; those of the same set of models are a role of `grove.py`, where the trees grow."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import core as O
from ..sources.staging import written
from . import grove as V
from .grove import best_splits as best_splits
from .trees import Ensemble, Tree

#: Cuts of a number; levels of splits; what later trees weigh; share of the rows that a round reads; fewest rows of a leaf.
CUTS, DEPTH, STEP, SHARE, LEAST_LEAF = 31, 3, 0.2, 0.8, 1
#: Fewest and most pairs of row and model of a part.
PART_PAIRS = (50_000, 10_000_000)
INNER, LEAVES = 2**DEPTH - 1, 2**DEPTH
#: Rows that a task gathers before it goes through the models that they test.
AT_ONCE = 65_536
#: Below all known numbers: what stands for a missing one lies under it.
MISSING_BELOW = -1e8


@dataclass(frozen=True)
class Binned:
    """rows: key, y, bins (two bytes a feature), trains (models), tests (a model or null). nominal: which features are."""

    rows: DataFrame
    sizes: np.ndarray
    nominal: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes


def binned(rows: DataFrame, levels: dict[int, int]) -> Binned:
    """rows: key (long), y, features (a vector), trains, tests. `levels`: the places of categories in the vector and how many
    values each has; a number is cut at exact quantiles of all rows, missing ones are a bin of their own."""
    x = written(rows.select("key", F.col("y").cast("double").alias("y"), vector_to_array("features").alias("x"), "trains", "tests"), "vectors")  # read four times
    width = x.agg(F.max(F.size("x"))).first()[0] or 0
    numbers = [j for j in range(width) if j not in levels]
    names = [f"q{i}" for i in range(CUTS)]
    known = x.select(F.posexplode("x").alias("place", "value")).where(F.col("place").isin(numbers) & (F.col("value") > MISSING_BELOW))
    found = {r.place: r[1:] for r in O.quantiles_within(known, ["place"], "value", [(i + 1) / (CUTS + 1) for i in range(CUTS)], names).select("place", *names).collect()}  # one row a feature
    cuts = {j: np.unique(np.array([MISSING_BELOW, *found.get(j, ())])) for j in numbers}
    nominal = np.array([j in levels for j in range(width)], bool)
    sizes = np.array([levels[j] if j in levels else len(cuts[j]) + 1 for j in range(width)], np.int64)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                values = np.stack(batch["x"].to_numpy())
                out = np.empty(values.shape, np.uint16)
                for j in range(width):
                    out[:, j] = np.searchsorted(cuts[j], values[:, j]) if j in cuts else values[:, j]
                yield batch.drop(columns="x").assign(bins=[r.tobytes() for r in out])

    pairs = x.agg(F.sum(F.size("trains") + 1)).first()[0] or 0
    fewest, most = (-(-pairs // n) for n in reversed(PART_PAIRS))
    parts = max(1, fewest, min(most, rows.sparkSession.sparkContext.defaultParallelism))  # a part's histograms have a fixed size
    return Binned(written(x.repartition(parts, "key").mapInPandas(each, "key long, y double, trains array<int>, tests int, bins binary"), "binned"), sizes, nominal)


@dataclass
class Forests:
    """Trees of all models, each as full trees: of an inner node the feature and which bins go left (a node that isn't split
    sends all of them), of a leaf its value; rows trained on at all nodes, in the order of levels."""

    feature: np.ndarray
    goes: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    split: np.ndarray

    @staticmethod
    def empty(models: int, rounds: int, bins: int) -> Forests:
        return Forests(np.zeros((models, rounds, INNER), np.int16), np.ones((models, rounds, INNER, bins), bool), np.zeros((models, rounds, LEAVES)), np.zeros((models, rounds, INNER + LEAVES)), np.zeros((models, rounds, INNER), bool))

    def down(self, t: int, bins: np.ndarray, model: np.ndarray, levels: int, row: np.ndarray | None = None) -> np.ndarray:
        """The node of each pair of row and model in the model's tree t, after so many levels; without `row`, pair i is row i."""
        node, flat, most = np.zeros(len(model), np.int64), bins.ravel(), self.goes.shape[-1]
        first = (np.arange(len(bins)) if row is None else row) * bins.shape[1]
        feature, goes = self.feature[:, t].ravel(), self.goes[:, t].ravel()
        for _ in range(levels):
            at = model * INNER + node
            left = goes.take(at * most + flat.take(first + feature.take(at)))
            node = 2 * node + 2 - left
        return node

    def predict(self, bins: np.ndarray, model: np.ndarray, rounds: int, row: np.ndarray | None = None) -> np.ndarray:
        out = np.zeros(len(model))
        for t in range(rounds):
            out += weight(t) * self.value[:, t].ravel().take(model * LEAVES + self.down(t, bins, model, DEPTH, row) - INNER)
        return out

    def ensemble(self, model: int) -> Ensemble:
        """The model's trees, over bins; a node that isn't split is a leaf."""
        trees, k = [], INNER + LEAVES
        for t in range(self.value.shape[1]):
            real = np.flatnonzero(self.split[model, t])
            left, right = np.full(k, -1), np.full(k, -1)
            left[real], right[real] = 2 * real + 1, 2 * real + 2
            value = np.zeros(k)
            for node in range(k):
                end = node
                while end < INNER:
                    end = 2 * end + 1
                value[node] = self.value[model, t, end - INNER]
            feature = np.concatenate([self.feature[model, t].astype(np.int64), np.zeros(LEAVES, np.int64)])
            trees.append(Tree(feature, np.full(k, np.nan), {int(i): np.flatnonzero(self.goes[model, t, i]) for i in real}, left, right, value, self.cover[model, t]))
        return Ensemble(trees, [weight(t) for t in range(len(trees))])


def weight(t: int) -> float:
    return 1.0 if t == 0 else STEP


def drawn(key: np.ndarray, t: int) -> np.ndarray:
    """Which rows round t reads: a share of them, by a hash of key and round."""
    return V.drawn(key, t, SHARE)


def fit(table: Binned, models: int, rounds: int) -> Forests:
    """The models 0 to models - 1, each over the rows that name it."""
    spark, sizes = table.rows.sparkSession, table.sizes
    sets = sorted(tuple(r.trains) for r in table.rows.select("trains").distinct().collect())  # one row a set of models
    of = F.broadcast(spark.createDataFrame([(i, list(s)) for i, s in enumerate(sets)], "role int, trains array<int>"))
    rows = table.rows.where(F.size("trains") > 0).join(of, "trains").select("key", "role", F.array("y").alias("y"), "bins")
    blocks = V.packed(rows, sizes, table.nominal, [list(s) for s in sets], 1, lambda b: np.frombuffer(b"".join(b.column("bins").to_pylist()), np.uint16).reshape(b.num_rows, -1))
    grove = V.grown(blocks, [V.Spec(0, V.SQUARE, rounds, DEPTH, STEP, SHARE, LEAST_LEAF)] * models, V.Edges.all_of(models, sizes))
    out = Forests.empty(models, rounds, int(sizes.max(initial=1)))
    for m in range(models):
        out.value[m], out.cover[m], out.split[m] = grove.value[m], grove.cover[m], grove.cut[m] != V.ALL_LEFT
        out.feature[m] = np.where(out.split[m], grove.feature[m], 0)
        for t, node in np.argwhere(out.split[m]).tolist():
            cut, goes = int(grove.cut[m][t, node]), out.goes[m, t, node]
            goes[:] = False
            if cut < 0:
                goes[: len(grove.sets[m, t, node])] = grove.sets[m, t, node]
            else:
                goes[: cut + 1] = True
    return out


def gathered(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The batches, some put together until they have so many rows."""
    some, n = [], 0
    for batch in batches:
        some.append(batch)
        n += len(batch)
        if n >= rows:
            yield pd.concat(some)
            some, n = [], 0
    if n:
        yield pd.concat(some)


def importance(table: Binned, forests: Forests) -> DataFrame:
    """model, place, importance: the mean absolute Shapley value of the feature there, over the rows that test the model."""
    spark, width = table.rows.sparkSession, len(table.sizes)
    sent = spark.sparkContext.broadcast(forests)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ensembles: dict[int, Ensemble] = {}
        for batch in gathered(batches, AT_ONCE):
            for model, own in batch.groupby("tests"):
                if model not in ensembles:
                    ensembles[model] = sent.value.ensemble(model)
                values = ensembles[model].shapley(np.frombuffer(b"".join(own["bins"]), np.uint16).reshape(len(own), -1).astype(float))
                yield pd.DataFrame({"model": model, "place": np.arange(width), "size": np.abs(values).sum(axis=0), "n": len(own)})

    sums = table.rows.where("tests is not null").select("tests", "bins").mapInPandas(each, "model int, place int, size double, n long")
    return sums.groupBy("model", "place").agg((F.sum("size") / F.sum("n")).alias("importance"))
