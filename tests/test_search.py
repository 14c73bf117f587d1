"""Parameter search against plain arithmetic, its resumption, and its errors."""

import pytest
from pyspark.sql import functions as F

from eventmesa.plans import models as M
from eventmesa.plans import search
from eventmesa.sources.staging import fresh_path

from .test_models import events

P = [search.Prepared(k, None, None) for k in range(10, 21)]


def test_draws_depend_on_the_trial_alone_and_lie_in_their_ranges():
    draws = [search.drawn(i) for i in range(200)]
    assert draws[5] == search.drawn(5) != search.drawn(5, seed=8)
    assert all(10 <= d["numTrees"] <= 60 and 3 <= d["maxDepth"] <= 8 and 5 <= d["minInstancesPerNode"] <= 200 and 0.4 <= d["subsamplingRate"] <= 1 and 0.2 <= float(d["featureSubsetStrategy"]) <= 1 for d in draws)
    assert len({d["maxDepth"] for d in draws}) == 6


def test_rungs_grow_to_all_folds_and_nest():
    assert search.rungs_of(17, 8) == [4, 8, 16, 17] and search.rungs_of(1, 6) == [1] and search.rungs_of(8, 1) == [8]
    some = [search.spread_out(P, n) for n in (1, 2, 4, 8, 11)]
    assert [len(x) for x in some] == [1, 2, 4, 8, 11] and some[0][0].k == 20
    assert all({f.k for f in a} <= {f.k for f in b} for a, b in zip(some, some[1:]))


def test_search_finds_scores_and_resumes(spark):
    table, root, reports = events(spark, 40), fresh_path(spark, "search"), []
    few = search.param_search(table, trials=2, root=root)
    assert few.n_trials == 2 and few.best_params in (search.drawn(0), search.drawn(1)) and few.best_value > 0
    before = search.read(spark, root).count()
    found = search.param_search(table, trials=4, root=root, every=1, report=lambda t: reports.append(t.count()))
    rows = {r.trial: r for r in found.trials.collect()}
    assert set(rows) == {search.BASELINE, 0, 1, 2, 3} and sum(r.best for r in rows.values()) == 1 and not rows[search.BASELINE].best
    assert search.read(spark, root).count() > before and reports and reports[-1] <= 5
    finished = [r for r in rows.values() if r.finished and r.trial >= 0]
    best = min(finished, key=lambda r: (r.value, r.trial))
    assert best.best and found.best_params == search.drawn(best.trial) and found.best_value == pytest.approx(best.value)
    assert found.baseline_value == pytest.approx(rows[search.BASELINE].value) and rows[search.BASELINE].finished
    # A trial's loss by plain arithmetic.
    fold = search.prepared(table)[-1]
    forest, leaves = M.forest(fold.train, M.RAW, search.drawn(best.trial))
    got = M.quantiles_of(forest, leaves, fold.tested).join(fold.tested.select("event_id", M.RAW), "event_id").toPandas()
    loss = sum(max(q * (y - p), (q - 1) * (y - p)) for name, q in zip(M.NAMES, M.QUANTILES) for y, p in zip(got[M.RAW], got[name])) / len(got) / len(M.NAMES)
    known = search.read(spark, root).where((F.col("trial") == best.trial) & (F.col("fold") == fold.k)).first()
    assert known.loss == pytest.approx(loss) and known.n == len(got)
    # Nothing is scored again.
    again = search.param_search(table, trials=4, root=root, every=1, report=lambda t: pytest.fail("scored again"))
    assert again.best_value == found.best_value
    search.save_best(spark, found, root)
    assert search.load_best(spark, root) == found.best_params


def test_searches_that_cannot_be(spark):
    table = events(spark, 4)
    with pytest.raises(ValueError, match="split"):
        search.param_search(table.where("cal_q < '2019Q2'"), trials=1)
    with pytest.raises(ValueError, match="rejected"):
        search.param_search(table, trials=1)


def test_tuning_quarters_are_the_earlier_ones(spark):
    table = events(spark, 2)
    assert max(r.cal_q for r in search.tuning_rows(table).select("cal_q").collect()) == "2020Q1"
    assert search.tuning_rows(table.where("cal_q = '2018Q1'")).count() == 2
