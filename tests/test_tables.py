"""Keyed tables and streams: pulls, top-ups, upserts, restarts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from eventmesa.sources.staging import fresh_path
from eventmesa.sources.tables import KeyedTable
from eventmesa.streaming import live

SCHEMA = "permno int, date date, ret double"


class Vendor:
    """A source that notes what it is asked for."""

    def __init__(self, spark, rows):
        self.rows, self.asked = spark.createDataFrame(rows, SCHEMA), []

    def __call__(self, keys):
        self.asked.append(sorted(r.permno for r in keys.collect()))
        return self.rows.join(keys.select("permno"), "permno", "left_semi")


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(n)


@pytest.fixture
def vendor(spark):
    return Vendor(spark, [(p, day(n), p + n / 100) for p in (10001, 10002, 10003, 10004) for n in range(0, 90, 3)])


def table_at(spark, **more):
    return KeyedTable(fresh_path(spark, "t"), ("permno", "date"), F.date_format("date", "yyyyMM"), **more)


def keys(spark, *permnos):
    return spark.createDataFrame([(p,) for p in permnos], "permno int")


def ids(df):
    return sorted({r.permno for r in df.collect()})


def test_only_missing_keys_are_pulled(spark, vendor):
    t = table_at(spark)
    assert ids(t.ensure(keys(spark, 10001, 10002, 10001, None), vendor, "permno")) == [10001, 10002]
    assert ids(t.ensure(keys(spark, 10001, 10003), vendor, "permno")) == [10001, 10003]
    assert ids(t.ensure(keys(spark, 10001, 10002, 10003), vendor, "permno")) == [10001, 10002, 10003]
    assert vendor.asked == [[10001, 10002], [10003]] and ids(t.read(spark)) == [10001, 10002, 10003]
    t.ensure(keys(spark, 10001), vendor, "permno", refresh=True)
    assert vendor.asked[-1] == [10001] and t.read(spark).count() == 90


def test_empty_request_touches_nothing(spark, vendor):
    t = table_at(spark)
    out = t.ensure(keys(spark).where("permno > 0"), vendor, "permno")
    assert out.columns == ["permno", "date", "ret"] and out.count() == 0 and not t.exists(spark)
    assert ids(t.ensure(keys(spark, 7), vendor, "permno")) == []  # the source has no such key


def test_top_up_pulls_old_tails_from_the_next_day(spark, vendor):
    t = table_at(spark)
    t.upsert(vendor.rows.where((F.col("permno") == 10001) | (F.col("permno") == 10002) & (F.col("date") <= F.lit(day(30)))).withColumn("ret", F.lit(0.0)))
    pulled = t.top_up(vendor, "permno", "date", F.lit(day(90)).cast("date"), days=5)
    assert [(r.permno, r.pull_from) for r in pulled.collect()] == [(10002, day(31))] and vendor.asked == [[10002]]
    rows = t.read(spark)
    assert rows.count() == 60 and rows.where((F.col("permno") == 10002) & (F.col("date") <= F.lit(day(30)))).agg(F.max("ret")).first()[0] == 0.0
    assert t.top_up(vendor, "permno", "date", F.lit(day(90)).cast("date")).count() == 0 and len(vendor.asked) == 1


def test_upserts_rewrite_touched_partitions_and_can_be_repeated(spark, vendor):
    t = table_at(spark)
    t.upsert(vendor.rows)
    kept_files = lambda: {r.f for r in spark.read.parquet(t.path).select(F.input_file_name().alias("f")).distinct().collect()}
    before = kept_files()
    change = spark.createDataFrame([(10001, day(33), -1.0), (10001, day(33), -2.0), (10009, day(34), 5.0)], SCHEMA)
    for _ in range(2):
        t.upsert(change)
    got = {(r.permno, r.date): r.ret for r in t.read(spark).collect()}
    assert len(got) == t.read(spark).count() == 121 and got[10001, day(33)] == -1.0 and got[10009, day(34)] == 5.0
    changed = {f.rsplit("/", 2)[1] for f in before ^ kept_files()}
    assert changed == {"__part=202002"}
    t.upsert(change.limit(0))
    assert t.read(spark).count() == 121


def test_sequence_and_ragged_columns(spark):
    t = KeyedTable(fresh_path(spark, "t"), ("k",), F.expr("pmod(k, 4)"), "seq", ragged=True)
    t.upsert(spark.createDataFrame([(1, 5, "a"), (2, 1, "b")], "k int, seq int, v string"))
    t.upsert(spark.createDataFrame([(1, 4, "old", 1.0), (2, 2, "new", 2.0), (None, None, None, None)], "k int, seq int, v string, more double"))
    assert {(r.k, r.v, r.more) for r in t.read(spark).collect()} == {(1, "a", None), (2, "new", 2.0), (None, None, None)}


def test_stream_restarts_from_its_checkpoint_with_equal_tables(spark):
    folder, checkpoint = fresh_path(spark, "in"), fresh_path(spark, "check")
    t = KeyedTable(fresh_path(spark, "t"), ("k",), F.expr("pmod(k, 3)"), "at")
    rows = spark.createDataFrame([(k, dt.datetime(2020, 1, 1 + n, 12), f"{k}-{n}") for k in range(20) for n in range(3)], "k int, at timestamp, v string")
    run = lambda table, at: live.merged(live.once(live.arriving(spark, folder, rows.schema, files_at_once=1), ["k", "at"], "at", late="20 days"), table, at)
    rows.where("k < 12").repartition(3).write.mode("append").parquet(folder)
    run(t, checkpoint)
    assert t.read(spark).count() == 12
    rows.repartition(2).write.mode("append").parquet(folder)  # all again, and more
    query = run(t, checkpoint)
    assert sum(p["numInputRows"] for p in query.recentProgress) == 60  # the first files aren't read again
    assert {(r.k, r.v) for r in t.read(spark).collect()} == {(k, f"{k}-2") for k in range(20)}
    other = KeyedTable(fresh_path(spark, "t"), ("k",), F.expr("pmod(k, 3)"), "at")
    run(other, fresh_path(spark, "check"))
    assert sorted(map(tuple, other.read(spark).collect())) == sorted(map(tuple, t.read(spark).collect()))


def test_scores_of_a_batch_that_comes_again_are_replaced(spark):
    folder, out, checkpoint = fresh_path(spark, "in"), fresh_path(spark, "out"), fresh_path(spark, "check")
    rows = spark.createDataFrame([(k,) for k in range(9)], "k int")
    rows.repartition(3).write.parquet(folder)
    for _ in range(2):  # a second run without its checkpoint scores all batches again
        live.scored(live.arriving(spark, folder, rows.schema, files_at_once=1), lambda batch: batch.withColumn("score", F.col("k") * 2), out, f"{checkpoint}-{_}")
    assert sorted((r.k, r.score) for r in spark.read.parquet(out).collect()) == [(k, 2 * k) for k in range(9)]
