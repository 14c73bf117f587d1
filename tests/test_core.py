import datetime as dt

import numpy as np
import pytest

from eventmesa.functions import scalars as S
from eventmesa.operators import core as O
from eventmesa.plans import equities as E
from eventmesa.sources import incremental as I
from eventmesa.sources.staging import written

D = dt.date.fromisoformat


def test_asof_takes_the_latest_row_at_or_before(spark):
    left = spark.createDataFrame([("A", D("2020-03-15")), ("A", D("2020-01-10")), ("B", D("2020-06-01")), ("B", D("2019-01-01"))], "k string, t date")
    right = spark.createDataFrame([("A", D("2020-01-01"), 10), ("A", D("2020-03-15"), 20), ("B", D("2020-05-01"), 30)], "k string, rt date, v int")
    rows = lambda strict: {(r.k, str(r.t)): r.v for r in O.asof_backward(left, right, "k", "t", "rt", ["v"], strict=strict).collect()}
    assert rows(False) == {("A", "2020-03-15"): 20, ("A", "2020-01-10"): 10, ("B", "2020-06-01"): 30, ("B", "2019-01-01"): None}
    assert rows(True)["A", "2020-03-15"] == 10


@pytest.mark.parametrize(("n", "bins", "expected"), [(5, 10, [1, 3, 5, 8, 10]), (1, 5, [None]), (10, 5, [1, 1, 2, 2, 3, 3, 4, 4, 5, 5])])
def test_bins(spark, n, bins, expected):
    df = spark.createDataFrame([("q", i, float(i)) for i in range(n)], "q string, id int, v double")
    got = [r.b for r in O.binned_within(df, ["q"], "v", ["id"], bins, "b").orderBy("id").collect()]
    assert got == expected


def test_global_rank_is_dense_and_ordered(spark):
    df = spark.createDataFrame([(i, float(i * 7919 % 1000 // 3)) for i in range(1000)], "id int, v double")
    rows = O.global_rank(df, "v", ["id"], "r").orderBy("r").collect()
    assert [r.r for r in rows] == list(range(1000)) and [(r.v, r.id) for r in rows] == sorted((r.v, r.id) for r in rows) and rows[0].r_n == 1000


def test_range_join_matches_every_window(spark):
    quotes = spark.createDataFrame([(1, D("2020-01-31")), (1, D("2020-03-01")), (2, D("2020-01-31"))], "k int, d date")
    events = spark.createDataFrame([(1, "a", D("2020-01-30"), D("2020-03-01")), (1, "b", D("2020-02-28"), D("2020-04-01"))], "k int, e string, lo date, hi date")
    assert sorted((r.e, str(r.d)) for r in O.range_join(quotes, events, "k", "d", "lo", "hi").collect()) == [("a", "2020-01-31"), ("a", "2020-03-01"), ("b", "2020-03-01")]


def test_scalars(spark):
    df = spark.createDataFrame([("16:00:00", "1690.0"), ("15:59", "001690"), (None, "1234567"), ("x", "1690")], "t string, k string")
    from pyspark.sql import functions as F

    rows = df.select(S.anchor_date(F.lit("2020-01-01").cast("date"), F.col("t")).alias("a"), S.company_key(F.col("k")).alias("k")).collect()
    assert [str(r.a)[-1] for r in rows] == ["2", "1", "2", "2"] and [r.k for r in rows] == ["001690", "001690", "1234567", "001690"]


def test_incremental(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {r.k: r.v for r in I.upserted(old, new, ["k"]).collect()} == {1: "a", 2: "c", 3: "d"}
    want = spark.createDataFrame([(2,), (3,), (None,)], "k int")
    assert [r.k for r in I.missing_keys(want, old, "k").collect()] == [3]
    assert {r.k for r in I.pulled(want, old, new, "k").collect()} == {2, 3}


def test_industry_pieces_are_disjoint_and_first_match_wins(spark):
    pieces = S.intervals(S.FF48)
    assert all(a[1] < b[0] for a, b in zip(pieces, pieces[1:]))
    first = lambda code, classes: next((label for label, ranges in classes if any(a <= code <= b for a, b in ranges)), "Other")
    rows = spark.range(10_000).selectExpr("cast(id as string) sic").union(spark.createDataFrame([(None,), ("x",), ("2840.0",)], "sic string"))
    got = {r.sic: (r.ff48, r.ff12) for r in S.with_industry(S.with_industry(rows, "sic", "ff48"), "sic", "ff12", S.FF12).collect()}
    assert all(got[str(c)] == (first(c, S.FF48), first(c, S.FF12)) for c in range(10_000))
    assert got[None] == got["x"] == (None, None) and got["2840.0"] == got["2840"]


def test_quantiles_of_one_hot_value_come_from_its_count(spark):
    rows = [("a", 5.0)] * 900 + [("a", float(i)) for i in range(100)] + [("b", 1.0), ("b", 2.0), ("b", None), (None, 7.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r.g: (r.q1, r.q5, r.q9) for r in O.quantiles_within(df, ["g"], "x", [0.01, 0.5, 0.97], ["q1", "q5", "q9"]).collect()}
    for g in ("a", "b", None):
        own = np.array([x for k, x in rows if k == g and x is not None])
        assert got[g] == pytest.approx(tuple(np.quantile(own, [0.01, 0.5, 0.97])))


def test_bins_write_values_and_split_rows_only(spark, monkeypatch):
    """What is put in order is a value and its count, not the rows; of rows, those whose value falls into several bins."""
    rows = [(i, "q", float(i // 10) if i < 60 else 6.0, f"payload {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, q string, v double, payload string")
    tables = []
    monkeypatch.setattr(O, "written", lambda df, name: tables.append((df.columns, df.count())) or written(df, name))
    got = {r.id: r.b for r in O.binned_within(df, ["q"], "v", ["id"], 4, "b").collect()}
    assert got == {i: max(-(-(i * 4) // 199), 1) for i in range(200)}
    assert all("payload" not in columns or n <= 140 for columns, n in tables)
    assert sum(n for columns, n in tables if "payload" in columns) == 140  # of 6.0, the one value that falls into several bins


def test_latest_snapshot_is_picked_in_place(spark, tmp_path):
    """Announcements of a key of their own aren't brought together; those that share one leave one."""
    from pyspark.sql import functions as F

    for name in ("nation", "customer"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    orders.unionByName(orders.orderBy("o_orderkey").limit(5)).write.parquet(f"{tmp_path}/orders.parquet")
    once, again = E.consensus(spark, "/root/testdata/sf0.001"), E.consensus(spark, str(tmp_path), least=0)
    assert "Window" not in once._jdf.queryExecution().executedPlan().toString()
    assert again.count() == orders.count() == again.select(F.count_distinct("event_id")).first()[0]
