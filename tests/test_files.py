"""Vendor files that lack columns, carry marks or hold bad values; folders that lack years; the model store."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from eventmesa.operators import core as O
from eventmesa.plans import attribution, models, validation
from eventmesa.sources import files, links
from eventmesa.sources.staging import fresh_path


def lines(tmp_path, name, *rows):
    path = tmp_path / name
    path.write_text("\n".join(rows) + "\n", encoding="utf-8")
    return f"file://{path}"


def test_consensus_scan_takes_what_a_file_has(spark, tmp_path):
    path = lines(tmp_path, "c.csv", "OFTIC,MEASURE,FISCALP,STATPERS,FPEDATS,ANNDATS_ACT,ACTUAL,NUMEST", "ab,EPS,QTR,2020-01-01,2019-12-31,2020-01-20,1.5,3", "ab,EPS,QTR,never,2019-12-31,2020-01-20,x,3", "cd,SAL,QTR,2020-01-01,2019-12-31,2020-01-20,1,1", "ef,EPS,QTR,2020-01-01,2019-12-31,2021-01-20,2,")
    rows = files.consensus_scan(spark, path)
    assert [r.statpers for r in rows.collect()][1] is None and rows.first().stdev is None
    named = lambda df: sorted(r.oftic for r in df.collect())
    assert named(files.announcements(rows)) == ["ab", "ef"] and named(files.announcements(rows, years=(2020, 2020))) == ["ab"]
    assert named(files.announcements(rows, tickers=spark.createDataFrame([("EF",)], "ticker string"))) == ["ef"]
    assert named(files.announcements(rows, tickers=spark.createDataFrame([], "ticker string"))) == ["ab", "ef"]


def test_constituents_and_prices(spark, tmp_path):
    assert sorted(r.ticker for r in files.constituents(spark, lines(tmp_path, "m.csv", "﻿Name,Symbol", "x, aa ", "y,", "z,bb")).collect()) == ["AA", "BB"]
    assert [r.ticker for r in files.constituents(spark, lines(tmp_path, "f.csv", "﻿what,else", "cc,1")).collect()] == ["CC"]
    path = lines(tmp_path, "p.csv", "Tic,date,Price", "aa,2020-01-02,5", "AA,2020-01-02,6", "aa,2020-01-03,-1", "aa,bad,4", "bb,2020-01-02,7", "spy,2020-01-02,9")
    rows = files.price_scan(spark, path, spark.createDataFrame([("aa",)], "tic string"), "SPY")
    assert sorted((r.tic, r.price) for r in rows.collect()) == [("AA", 5.0), ("SPY", 9.0)]


def test_folders_by_year(spark):
    path = fresh_path(spark, "years")
    rows = spark.createDataFrame([(dt.date(y, 5, 1), y) for y in (1996, 1997, 1999)], "date date, v int")
    files.write_by_year(rows, path, F.year("date"))
    windows = spark.createDataFrame([(dt.date(1996, 12, 28), dt.date(1998, 1, 3))], "low date, high date")
    read = files.read_years(spark, path, windows, ["v"])
    assert sorted(r.v for r in read.collect()) == [1996, 1997] and "PartitionFilters: [year" in read._jdf.queryExecution().toString().replace("isnotnull(year", "year")
    assert [r.year for r in files.missing_years(spark, path, range(1996, 2000)).collect()] == [1998]
    files.assert_complete(spark, path, range(1996, 1998), {"rows": rows})
    with pytest.raises(ValueError, match="1998, empty"):
        files.assert_complete(spark, path, range(1996, 2000), {"rows": rows, "empty": rows.limit(0)})


def test_links_end_in_the_far_future_and_the_last_counts(spark):
    table = spark.createDataFrame([("a", 1, "1990-01-01", "2000-01-01"), ("A", 2, "2000-01-02", None), ("b", 3, "1990-01-01", "never")], "ticker string, permno int, sdate string, edate string")
    wanted = spark.createDataFrame([("A",)], "ticker string")
    assert {r.ticker: r.permno for r in links.last_link(links.security_links(table, wanted), "permno").collect()} == {"A": 2}
    companies = spark.createDataFrame([(2, "1690.0", "LC", "P", None), (2, "77", "LX", "P", None)], "permno int, gvkey string, linktype string, linkprim string, linkenddt string")
    assert [(r.gvkey, str(r.linkenddt)) for r in links.primary_companies(companies).collect()] == [("001690", "2099-12-31")]


def test_quantiles_ranks_and_sums_match_plain_ones(spark):
    rows = [(i, i % 3, float((i * 37) % 50) if i % 11 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, g int, v double")
    got = {r.g: (r.a, r.b) for r in O.quantiles_within(df, ["g"], "v", [0.1, 0.5], ["a", "b"]).collect()}
    want = {r.g: tuple(r.q) for r in df.groupBy("g").agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.5))).alias("q")).collect()}
    assert all(got[g] == pytest.approx(want[g]) for g in want)
    ranks = {r.id: r.r for r in O.average_ranks(df, ["g"], "v", "r").collect()}
    for i, g, v in rows:
        own = sorted(x for _, h, x in rows if h == g and x is not None)
        assert ranks[i] == (None if v is None else (own.index(v) + len(own) - own[::-1].index(v) + 1) / 2)


def test_newey_west_shortens_its_lags(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 1.0), ("b", 2, 3.0), ("c", 1, 1.0), ("c", 2, 1.0)], "s string, q int, b double")
    got = {r.s: (r.mean, r.t) for r in validation.mean_with_t(df, ["s"], "q", "b").collect()}
    # Of b: deviations -1 and 1, one lag at weight one half: 2 + 2 * 0.5 * -1 = 1, so t is 2 * 2 / 1.
    assert got["a"] == (2.0, None) and got["b"] == pytest.approx((2.0, 4.0)) and got["c"] == (1.0, None)


def test_slopes_leave_dead_features_out(spark):
    rows = [("q", float(i % 7), float(i), 1.0, None if i % 5 == 0 else float(i % 3)) for i in range(60)]
    df = spark.createDataFrame([(q, 2 * a + 0.1 * b, a, b, dead, c) for q, a, b, dead, c in rows], "q string, y double, a double, b double, dead double, c double")
    got = {r.feature: r.b for r in validation.slopes(df, ["a", "b", "dead", "c"], "y", "q").collect()}
    sd = lambda c: df.agg(F.stddev_pop(c)).first()[0]
    assert set(got) == {"a", "b", "c"} and got["a"] == pytest.approx(2 * sd("a")) and got["b"] == pytest.approx(0.1 * sd("b")) and abs(got["c"]) < 1e-9


def test_models_are_saved_scored_and_aligned(spark):
    rows = [(i, "AB"[i % 2], dt.date(2018 + i // 120, 1 + i // 10 % 12, 1 + i % 10), i, f"{2018 + i // 120}Q{i // 30 % 4 + 1}", float(i % 13), float(i % 7) if i % 4 else None, "xy"[i % 2]) for i in range(480)]
    table = spark.createDataFrame(rows, "event_id int, oftic string, anndats date, pos0 int, cal_q string, f1 double, f2 double, kind string")
    table = table.withColumn(models.RAW, F.col("f1") / 100).withColumn(models.Z, F.col("f1") - 6).withColumn(models.CLASS, F.when(F.col("f1") > 9, 1).when(F.col("f1") < 3, 0))
    root = fresh_path(spark, "models")
    about = models.train_final(spark, table, root, "2021-06-30", spark.createDataFrame([("a",), ("B",)], "ticker string"))
    assert about.version == "2021q2_60" and 300 < about.n < 480 and about.levels == {"kind": ["x", "y"]}
    assert about.universe == 2 and about.quarters == ("2018Q1", "2021Q2") and about.quantiles == models.QUANTILES and models.load(spark, root)[1] == about
    models.train_final(spark, table, root, "2020-12-31")
    got = {r.event_id: r for r in models.scored(spark, root, spark.createDataFrame([(3,), (470,), (999,)], "event_id int"), table.drop("f2").withColumn("kind", F.lit("new"))).collect()}
    assert got[999].error and got[999].expected is None and got[3].version == "2021q2_60" and got[3].coverage == pytest.approx(1 / 3)
    assert got[3].pred_q10 <= got[3].pred_q50 <= got[3].pred_q90 and got[3].expected == got[3].pred_q50 and abs(got[3].expected - 0.03) < 0.02 and got[3].realised == 0.03
    heads, _ = models.load(spark, root, "2020q4_60")
    ready = models.vectors(models.aligned(table, heads[0]), heads[0])
    losses = {r.feature: r.perm for r in attribution.permutation_importance(heads[2], ready, heads[0].columns, models.Z, repeats=1).collect()}
    assert max(losses, key=losses.get) == "f1" and set(losses) == {"f1", "f2", "kind"}


def test_a_large_year_is_written_by_several_tasks(spark, tmp_path):
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        rows = spark.range(0, 200_000, 1, 8).selectExpr("id", "hash(id) AS v", "DATE'1996-05-05' AS date")
        files.write_by_year(rows, f"{tmp_path}/years", F.year("date"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert len(list((tmp_path / "years" / "year=1996").glob("*.parquet"))) > 1
    assert spark.read.parquet(f"{tmp_path}/years").agg(F.sum("id")).first()[0] == 200_000 * 199_999 // 2
