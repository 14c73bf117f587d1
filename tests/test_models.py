"""Backtest, attribution and slopes of drift models against single-node arithmetic."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from eventmesa.plans import attribution as T
from eventmesa.plans import models as M
from eventmesa.plans import validation as V
from eventmesa.plans.trees import ensemble_of

QUARTERS = [f"{y}Q{q}" for y in (2018, 2019, 2020) for q in (1, 2, 3, 4)]


def events(spark, n=70):
    """Drift follows `lead`, and the kind a little; `noise` and `gap` don't matter, the latter is often missing."""
    r = np.random.default_rng(3)
    size = n * len(QUARTERS)
    lead, noise, kind = r.normal(size=size), r.normal(size=size), r.choice(["a", "b", "c"], size)
    z = 1.5 * lead + (kind == "b") + 0.2 * r.normal(size=size)
    rows = pd.DataFrame({"event_id": np.arange(size), "oftic": "T", "anndats": pd.Timestamp("2018-01-01").date(), "pos0": 1, "cal_q": np.repeat(QUARTERS, n), "lead": lead, "noise": noise, "gap": np.where(r.random(size) < 0.5, None, noise.round(1)), "kind": np.where(r.random(size) < 0.1, None, kind)})
    rows["gap"] = rows["gap"].astype(float)
    rows[M.RAW], rows[M.Z] = z / 10, z
    rows[M.CLASS] = np.where(z > 0.7, 1, np.where(z < -0.7, 0, -1))
    table = spark.createDataFrame(rows)
    return table.withColumn("gap", F.when(~F.isnan("gap"), F.col("gap"))).withColumn(M.CLASS, F.when(F.col(M.CLASS) >= 0, F.col(M.CLASS)))


@pytest.fixture(scope="module")
def table(spark):
    return events(spark).cache()


@pytest.fixture(scope="module")
def folds(table):
    return M.fitted_folds(table)


def ready(fold, rows=None):
    schema = fold.heads[0]
    return M.vectors(M.aligned(fold.tested if rows is None else rows, schema), schema)


def matrix(rows):
    got = rows.select("event_id", vector_to_array("features").alias("x")).orderBy("event_id").toPandas()
    return np.stack(got["x"].to_numpy())


def test_every_fold_has_a_fit_and_no_row_near_it(table, folds):
    assert [f.k for f in folds] == [10, 11]
    assert [(k, train[-1], test) for k, train, test in M.folds(QUARTERS)] == [(10, QUARTERS[7], [QUARTERS[10]]), (11, QUARTERS[8], [QUARTERS[11]])]
    assert [x.cal_q for x in M.walk_forward(table, [QUARTERS[11]]).select("cal_q").distinct().collect()] == [QUARTERS[11]]
    with pytest.raises(ValueError):
        M.walk_forward(table, ["1999Q1"])


def test_predictions_are_single_node_arithmetic_over_the_saved_trees(spark, table, folds):
    fold = folds[0]
    _, (forest, _), z, up = fold.heads
    got = M.tested_rows(fold).orderBy("event_id").toPandas()
    x = matrix(ready(fold))
    assert np.allclose(got["drift_z_pred"], ensemble_of(spark, z).predict(x))
    margin = ensemble_of(spark, up).predict(x)
    assert np.allclose(got["prob_up"], 1 / (1 + np.exp(-2 * margin)))
    trained = table.where(F.col("cal_q").isin(QUARTERS[:8]))
    xs, y = matrix(ready(fold, trained)), trained.orderBy("event_id").toPandas()[M.RAW].to_numpy()
    means = np.zeros((len(x), 5))
    trees = ensemble_of(spark, forest).trees
    for tree in trees:
        at = tree.leaf(xs)
        for i, leaf in enumerate(tree.leaf(x)):
            own = np.sort(y[at == leaf])
            means[i] += [own[max(0, math.ceil(q * len(own)) - 1)] for q in M.QUANTILES]
    assert np.allclose(got[M.NAMES], np.sort(means / len(trees), axis=1))
    assert (np.diff(got[M.NAMES], axis=1) >= 0).all() and np.corrcoef(got["pred_q50"], got["drift_raw"])[0, 1] > 0.8


def test_equal_rows_give_equal_models(table, folds):
    again = M.fitted_folds(table.repartition(7, "noise"), [QUARTERS[10]])
    a, b = (M.tested_rows(f).orderBy("event_id").toPandas() for f in (folds[0], again[0]))
    assert np.allclose(a[[*M.NAMES, "drift_z_pred", "prob_up"]], b[[*M.NAMES, "drift_z_pred", "prob_up"]], rtol=0, atol=0)


def known_value(tree, x, known, node=0):
    """What the tree predicts of one row of which some features are known: others are averaged by the training rows."""
    if tree.left[node] < 0:
        return tree.value[node]
    sides = [int(tree.left[node]), int(tree.right[node])]
    if tree.feature[node] in known:
        return known_value(tree, x, known, sides[0] if tree.goes_left(node, x[None])[0] else sides[1])
    return sum(tree.cover[s] / tree.cover[node] * known_value(tree, x, known, s) for s in sides)


def test_shapley_values_are_exact(spark, folds):
    model = ensemble_of(spark, folds[0].heads[2])
    x = matrix(ready(folds[0]))
    values = model.shapley(x)
    assert np.allclose(values.sum(axis=1), model.predict(x) - model.expected())
    k = x.shape[1]
    for row in x[:3]:
        worth = {s: sum(w * known_value(t, row, s) for t, w in zip(model.trees, model.weights, strict=True)) for n in range(k + 1) for s in map(frozenset, itertools.combinations(range(k), n))}
        for j in range(k):
            exact = sum(math.factorial(len(s)) * math.factorial(k - 1 - len(s)) / math.factorial(k) * (worth[s | {j}] - v) for s, v in worth.items() if j not in s)
            assert np.isclose(exact, model.shapley(row[None])[0, j])


def test_shapley_importance_adds_up_all_rows_and_ranks_the_planted_feature(spark, folds):
    fold = folds[0]
    rows, columns = ready(fold), fold.heads[0].columns
    got = T.shapley_importance(fold.heads[2], rows.repartition(5), columns).toPandas().set_index("feature")
    values = ensemble_of(spark, fold.heads[2]).shapley(matrix(rows))
    assert np.allclose(got.loc[columns, "importance"], np.abs(values).mean(axis=0)) and np.allclose(got.loc[columns, "direction"], values.mean(axis=0))
    assert got["importance"].idxmax() == "lead" and (got["n"] == len(values)).all()
    assert T.shapley_importance(fold.heads[2], rows.limit(0), columns).count() == 0


def test_permutation_importance_equals_a_plain_loop(spark, folds):
    fold = folds[0]
    rows, columns = ready(fold), fold.heads[0].columns
    got = T.permutation_importance(fold.heads[2], rows, columns, M.Z, repeats=3).toPandas().set_index("feature")["perm"]
    pairs, x, model = T.permuted_pairs(rows.where(F.col(M.Z).isNotNull()), 3).toPandas(), matrix(rows), ensemble_of(spark, fold.heads[2])
    known = rows.select("event_id", M.Z).orderBy("event_id").toPandas()
    y, place = known[M.Z].to_numpy(), {e: i for i, e in enumerate(known["event_id"])}
    losses = {c: [] for c in columns}
    for _, turn in pairs.groupby("turn"):
        own, donor = turn["event_id"].map(place).to_numpy(), turn["donor"].map(place).to_numpy()
        assert sorted(own) == sorted(donor) == list(range(len(y)))
        for j, c in enumerate(columns):
            changed = x.copy()
            changed[own, j] = x[donor, j]
            losses[c].append(((model.predict(changed) - y) ** 2).mean() - ((model.predict(x) - y) ** 2).mean())
    assert {c: pytest.approx(np.mean(v)) for c, v in losses.items()} == got.to_dict()
    assert got.idxmax() == "lead"


FOLDS = [(k, f, imp, sign * imp, perm) for k, three in enumerate([(1.0, 0.5, 0.2), (0.9, 0.4, 0.3), (1.2, 0.6, 0.1)]) for f, imp, sign, perm in zip("abc", three, (1, -1, None), (0.4 + 0.2 * k, None, 0.1), strict=True) for sign in [sign or 0]]


def test_driver_table_joins_pools_and_scores(spark):
    folds = spark.createDataFrame(FOLDS, "fold int, feature string, importance double, direction double, perm double")
    folds = folds.withColumn("direction", F.when(F.col("feature") != "c", F.col("direction")))
    slopes = spark.createDataFrame([("a", 0.3, 3.0, 0.9), ("b", 0.4, 1.0, 0.8), ("c", 0.1, None, 0.5)], "feature string, coef double, t double, frac_positive double")
    got = {r.feature: r for r in T.driver_table(folds, slopes).collect()}
    assert (got["a"].sign_agreement, got["b"].sign_agreement, got["c"].sign_agreement) == (True, False, None)
    assert got["a"].mean_rank == 1 and got["a"].rank_std == 0 and got["a"].hit_rate == 1 and got["a"].n_folds == 3
    assert got["a"].perm_importance == pytest.approx(0.6) and got["b"].perm_importance is None
    assert got["a"].importance_std == pytest.approx(np.std([1, 0.9, 1.2], ddof=1)) and got["b"].direction == pytest.approx(-0.5)
    # No rank moves, so all are steady.
    assert got["a"].score == pytest.approx(1.0) and got["b"].score == pytest.approx(0.5 + 0.3 + 0.1) and got["c"].score == pytest.approx(0.8)
    assert T.driver_table(folds.limit(0), slopes).count() == 0


def test_subgroup_models_find_what_leads_in_each(spark, table, monkeypatch):
    monkeypatch.setattr(T, "LEAST_GROUP", 120)
    r = table.withColumn("gics_sector", F.when(F.col("event_id") % 2 == 0, "Tech").otherwise("Fin")).withColumn("mktcap", F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 97).cast("double")).withColumn("surprise_raw", F.lit(1.0))
    r = r.withColumn(M.Z, F.when(F.col("gics_sector") == "Fin", 2 * F.col("noise")).otherwise(F.col(M.Z))).where(F.col("event_id") % 3 > 0)
    got = T.subgroup_drivers(r).toPandas()
    first = {(x.grouping, x.subgroup): x.feature for x in got.itertuples() if x.rank == 1}
    assert first[("gics_sector", "Tech")] == "lead" and first[("gics_sector", "Fin")] == "noise"
    assert {g for g, _ in first} == {"gics_sector", "size_tercile", "surprise_sign"} and ("surprise_sign", "positive") in first and got["rank"].max() <= T.LISTED
    assert T.subgroup_drivers(table.limit(50).withColumns({"gics_sector": F.lit("x"), "mktcap": F.lit(1.0), "surprise_raw": F.lit(0.0)})).count() == 0


def test_slopes_at_full_width_equal_least_squares(spark):
    r, k = np.random.default_rng(1), 30
    x = r.normal(size=(200, k))
    y = x @ np.arange(k) + r.normal(size=200)
    frame = pd.DataFrame(x, columns=[f"f{i}" for i in range(k)]).assign(y=y, q=np.where(np.arange(200) < 90, "A", np.where(np.arange(200) < 170, "B", "C")))
    frame.loc[::7, "f3"] = np.nan
    got = {(s.quarter, s.feature): s.b for s in V.slopes(spark.createDataFrame(frame).repartition(6), [f"f{i}" for i in range(k)], "y", "q").collect()}
    for q in "AB":
        own = frame[frame["q"] == q]
        z = ((own[[f"f{i}" for i in range(k)]] - own[[f"f{i}" for i in range(k)]].mean()) / own[[f"f{i}" for i in range(k)]].std(ddof=0)).fillna(0).to_numpy()
        b = np.linalg.lstsq(z, own["y"].to_numpy(), rcond=None)[0]
        assert np.allclose([got[q, f"f{i}"] for i in range(k)], b, atol=1e-8)
    assert {q for q, _ in got} == {"A", "B"}  # C has fewer rows than features


def test_folds_share_their_rows_and_keep_nothing_cached(spark, table, monkeypatch):
    """The rows are dealt out once, however many folds there are, with the columns that fits read; a fold whose training rows
    lack a level has rows of its own."""
    spark.catalog.clearCache()
    dealt, seen = M.dealt, []

    def noted(rows, n):
        seen.append((rows.columns, n))
        return dealt(rows, n)

    monkeypatch.setattr(M, "dealt", noted)
    assert [f.k for f in M.fitted_folds(table)] == [10, 11]
    assert seen == [(["event_id", "cal_q", M.RAW, M.Z, M.CLASS, "features"], 9 * 70)]
    late = table.withColumn("kind", F.when((F.col("cal_q") == QUARTERS[8]) & (F.col("event_id") % 2 == 0), "d").otherwise(F.col("kind")))
    assert [f.heads[0].levels["kind"] for f in M.fitted_folds(late)] == [["a", "b", "c"], ["a", "b", "c", "d"]] and [n for _, n in seen[1:]] == [8 * 70, 9 * 70]


def test_changed_predictions_are_those_of_changed_rows(spark, folds):
    model, x = ensemble_of(spark, folds[0].heads[2]), matrix(ready(folds[0]))
    other = x[::-1].copy()
    split, got = {int(f) for t in model.trees for f in t.feature[t.left >= 0]}, dict(model.changed(x, other))
    assert set(got) == split
    for j in range(x.shape[1]):
        own = x.copy()
        own[:, j] = other[:, j]
        assert np.allclose(got.get(j, model.predict(x)), model.predict(own))


def test_quantiles_are_looked_up_where_a_row_is(spark, folds):
    model, leaves = folds[0].heads[1]
    rows = ready(folds[0])
    got = M.quantiles_of(model, leaves, rows)
    assert "Exchange" not in got._jdf.queryExecution().sparkPlan().toString() + got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    known = {(r.tree, r.leaf): r.q for r in leaves.collect()}
    own = {r.event_id: np.mean([known[t, leaf] for t, leaf in enumerate(r.leaf)], axis=0) for r in model.transform(rows).select("event_id", vector_to_array("leaf").alias("leaf")).collect()}
    for r in got.collect():
        assert np.allclose([r[name] for name in M.NAMES], np.sort(own[r.event_id]))
