"""Report tables and batch scoring against plain pandas, with few and odd rows."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventmesa.plans import models as M
from eventmesa.plans import reports as R
from eventmesa.plans import scoring
from eventmesa.sources.staging import fresh_path

SCHEMA = "event_id int, drift_raw double, pred_q50 double, pred_q10 double, pred_q90 double, prob_up double"


def results(n, seed=1):
    r = np.random.default_rng(seed)
    y, p = r.normal(size=n).round(2), r.normal(size=n).round(1)
    rows = [(i, float(a), float(b), float(b) - 1, float(b) + 1, float(u)) for i, (a, b, u) in enumerate(zip(y, p, r.random(n).round(2), strict=True))]
    return rows + [(n, None, 1.0, 0.0, 2.0, 0.9), (n + 1, 0.5, None, None, None, None), (n + 2, float("nan"), 0.3, 0.0, 1.0, 0.4)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 9, 10, 137])
def test_tables_follow_pandas_with_few_rows(spark, n):
    rows = results(n)
    df, x = spark.createDataFrame(rows, SCHEMA), pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    got = R.headline(df).first()
    both = x.dropna(subset=["drift_raw", "pred_q50"])
    y, p = both["drift_raw"], both["pred_q50"]
    assert got.n_events == n + 3
    if len(both) < 3:
        assert got.spearman_ic is None and got.r2 is None
    else:
        assert got.spearman_ic == pytest.approx(y.rank().corr(p.rank())) and got.r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert (got.decile_spread is None) == (len(both) < 10)
    inside = ((both["drift_raw"] >= both["pred_q10"]) & (both["drift_raw"] <= both["pred_q90"])).mean()
    assert got.coverage is None if not len(both) else got.coverage == pytest.approx(inside)
    table = {r.bin: r for r in R.calibration(df).collect()}
    if len(both) < 10:
        assert table == {}
    else:
        order = both.sort_values(["pred_q50", "event_id"])
        bins = pd.qcut(np.arange(len(order)), 10, labels=False) + 1
        assert {b: (len(g), pytest.approx(g["pred_q50"].mean()), pytest.approx(g["drift_raw"].mean())) for b, g in order.groupby(bins)} == {b: (r.n, r.predicted, r.realised) for b, r in table.items()}
    up = x.dropna(subset=["drift_raw", "prob_up"]).sort_values(["prob_up", "event_id"])
    curve = {r.bin: r for r in R.reliability(df).collect()}
    k = min(10, len(up))
    bins = np.ones(len(up), int) if k == 1 else pd.qcut(np.arange(len(up)), k, labels=False) + 1 if k else []
    assert {b: (len(g), pytest.approx((g["drift_raw"] > 0).mean())) for b, g in up.groupby(bins)} == {b: (r.n, r.realised) for b, r in curve.items()} if k else curve == {}


def test_contrast_needs_three_values_on_either_side(spark):
    rows = [(10, 1.0, 2.0, 1.0, "x"), (10, 2.0, None, 1.0, "y"), (10, 6.0, 4.0, 1.0, "x"), (1, 0.0, 1.0, 1.0, "x"), (1, 1.0, 1.0, 1.0, "x"), (1, 5.0, 3.0, 1.0, "x"), (5, 99.0, 99.0, 0.0, "x"), (1, float("nan"), 0.0, 1.0, "x")]
    df = spark.createDataFrame(rows, "bin int, a double, b double, flat double, text string")
    got = {r.feature: r for r in R.contrast(df, ["a", "b", "flat", "text"], "bin").collect()}
    top, low = np.array([1.0, 2, 6]), np.array([0.0, 1, 5])
    assert set(got) == {"a", "flat"} and got["flat"].d is None and got["flat"].diff == 0
    assert got["a"].d == pytest.approx((top.mean() - low.mean()) / np.sqrt((top.var(ddof=1) + low.var(ddof=1)) / 2))


def test_each_request_has_its_own_error_or_prediction(spark):
    r = np.random.default_rng(2)
    n, day = 300, dt.date(2019, 1, 1)
    rows = [(i, "AB"[i % 2], day + dt.timedelta(i), i, f"{2019 + i // 150}Q{1 + i // 40 % 4}", float(x), float(x), "k" if i % 2 else "j", float(x) / 10, float(x), int(x > 0)) for i, x in enumerate(r.normal(size=n))]
    table = spark.createDataFrame(rows, f"event_id int, oftic string, anndats date, pos0 int, cal_q string, sue_std double, surprise_raw double, kind string, {M.RAW} double, {M.Z} double, {M.CLASS} int")
    root = fresh_path(spark, "models")
    M.train_final(spark, table, root, "2021-01-01")
    consensus = table.select("event_id", "oftic", "anndats", F.lit(2.0).alias("actual"), F.when(F.col("event_id") != 7, 1.0).alias("meanest"), F.lit(0.5).alias("stdev"), F.lit(3).alias("numest"), F.lit(1).alias("numup"), F.lit(0).alias("numdown"))
    d = lambda i: str(day + dt.timedelta(i))
    asked = [(1, "a", d(4), None), (2, "a", d(4), "3.0"), (3, None, d(4), None), (4, " ", d(4), None), (5, "A", "soon", None), (6, "A", None, None), (7, "b", d(7), None), (8, "C", d(4), "1"), (9, "A", d(5), "1"), (10, "B", d(5), "inf"), (1, "a", d(4), None)]
    requests = spark.createDataFrame(asked, "request int, ticker string, anndate string, actual string")
    requests = requests.withColumn("meanest", F.when(F.col("request").isin(8, 9), 1.0))
    judged = scoring.judged(scoring.resolved(requests, consensus), spark.createDataFrame([("A",), ("B",), ("A",)], "tic string"), table)
    errors = {x.request: x.error for x in judged.collect()}
    assert judged.count() == len(asked) and errors == {1: None, 2: None, 3: "ticker is required", 4: "ticker is required", 5: "invalid anndate: soon", 6: "invalid anndate: none", 7: "actual and meanest are required", 8: "no prices of C", 9: "A 2019-01-06 can't be located", 10: None}
    surprises = table.select("event_id", F.lit(10.0).alias("pre_price"))
    once = judged.dropDuplicates(["request"])
    got = {x.request: x for x in scoring.scored(spark, root, once, table, surprises).collect()}
    assert set(got) == set(errors) and all((x.expected is None) == (x.error is not None) for x in got.values())
    assert got[1].ticker == "A" and got[1].used_cache and got[1].version == "2021q1_60" and got[1].n_features_present == got[1].n_features_total == 3 and not got[1].low_coverage
    assert got[1].interval_low == got[1].q10 <= got[1].q50 == got[1].expected <= got[1].q90 == got[1].interval_high
    # Request 2 overrides the actual, so its surprise is twice as large: that of a row with these features.
    like = table.where("event_id = 4").withColumns({"sue_std": F.lit(4.0), "surprise_raw": F.lit(2.0)})
    heads, _ = M.load(spark, root)
    assert got[2].drift_z_pred == pytest.approx(M.predicted(heads, like).first().drift_z_pred)
    assert scoring.scored(spark, root, judged.limit(0), table, surprises).count() == 0
