"""The whole study on a small table."""

from pyspark.sql import functions as F

from eventmesa.plans import models as M
from eventmesa.plans import study
from eventmesa.sources.staging import fresh_path

from .test_models import events


def test_study_writes_all_tables_of_every_horizon(spark):
    table = events(spark, 30).withColumn(f"drift_decile_h{M.HORIZON}", F.lit(1).cast("long"))
    for label in study.LABELS:  # a second horizon, with nothing to classify
        table = table.withColumn(f"{label}_h5", F.lit(None).cast("int") if label == "drift_class" else -F.col(f"{label}_h{M.HORIZON}"))
    root = fresh_path(spark, "study")
    got = {r.horizon: r for r in study.run(table, root, (M.HORIZON, 5)).collect()}
    assert set(got) == {M.HORIZON, 5} and all(r.n_folds == 2 and r.n_events == 60 and r.spearman_ic > 0.7 for r in got.values())
    assert got[M.HORIZON].classifier and not got[5].classifier and got[5].roc_auc is None
    signs = {}
    for h in got:
        drivers = {r.feature: r for r in spark.read.parquet(f"{root}/h{h}/drivers").collect()}
        assert max(drivers.values(), key=lambda r: r.importance).feature == "lead" and drivers["lead"].sign_agreement is not None
        signs[h] = drivers["lead"].coef
        assert spark.read.parquet(f"{root}/h{h}/matrix").count() == table.count() and spark.read.option("header", True).csv(f"{root}/h{h}/drivers_csv").count() == len(drivers)
        assert {r.feature for r in spark.read.parquet(f"{root}/h{h}/summary").collect()} == {"lead", "noise", "gap", "kind"} == set(drivers)
        assert spark.read.parquet(f"{root}/h{h}/calibration").count() == 10
    assert signs[M.HORIZON] > 0 > signs[5]


def test_announcements_and_their_consensus_are_made_once(spark, monkeypatch):
    """However many tables and requests read them: orders meet their customers once in a session."""
    from eventmesa.plans import equities, scoring
    from eventmesa.sources import adapters, staging

    staging.forget()
    made, build = [], adapters._announcements
    monkeypatch.setattr(adapters, "_announcements", lambda *a: made.append(a) or build(*a))
    sf = "/root/testdata/sf0.001"
    equities.fitting(spark, sf)
    first, again = equities.consensus(spark, sf), equities.consensus(spark, sf)
    assert scoring.requests_of(spark, sf).count() == adapters.announcements(spark, sf).count() > 0
    assert len(made) == 1 and first.inputFiles() == again.inputFiles() != []


def test_slopes_of_own_features_need_no_other_feature(spark, monkeypatch):
    """The rows are those of the feature table, and slope_order and fama_macbeth make neither it nor what it looks up."""
    from eventmesa.plans import features, reports, validation
    from eventmesa.sources import staging

    sf = "/root/testdata/sf0.001"
    columns = ["event_id", "cal_q", *validation.FACTORS, f"drift_z_h{features.HORIZON}"]
    want = sorted(map(tuple, features.event_features(spark, sf).select(*columns).collect()))
    staging.forget()
    for name in ("event_features", "price_risk", "liquidity", "fundamentals", "industry_moms", "industry_drifts", "drift_labels"):
        monkeypatch.setattr(features, name, None)
    assert sorted(map(tuple, features.own_features(spark, sf).select(*columns).collect())) == want != []
    assert reports.slope_order(spark, sf).count() == validation.fama_macbeth(spark, sf).count() == len(validation.FACTORS)
