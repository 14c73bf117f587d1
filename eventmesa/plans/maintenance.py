"""Studies of tables that grow by loads and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import adapters as A
from ..sources.staging import fresh_path
from ..sources.tables import KeyedTable
from ..streaming import live
from . import equities as E
from . import features as X
from . import models as M

#: The study's cached tail, its target day, and the day of a correction.
CACHED_TO, TARGET = "1997-06-30", "1998-08-02"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vendor: permno, date, prc, vol, one row a day."""
    rows = A.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 500).alias("permno"), F.to_date("o_orderdate").alias("date"), "o_totalprice")
    return rows.groupBy("permno", "date").agg(F.round(F.max("o_totalprice"), 2).alias("prc"), F.count("*").alias("vol"))


def maintained_daily(spark, sf_dir):
    """Daily rows of some securities: a first load up to a day, the securities that it lacks pulled whole, old tails topped up,
    and a correction of one month upserted."""
    vendor = daily(spark, sf_dir)
    table = KeyedTable(fresh_path(spark, "daily"), ("permno", "date"), F.date_format("date", "yyyyMM"))
    table.upsert(vendor.where((F.col("permno") % 3 != 0) & (F.col("date") <= CACHED_TO)))
    of = lambda keys: vendor.join(keys.select("permno"), "permno", "left_semi")
    requested = vendor.select("permno").where("permno % 2 = 0").distinct()
    table.ensure(requested, of, "permno")
    table.top_up(of, "permno", "date", F.lit(TARGET).cast("date"))
    table.upsert(vendor.where("date BETWEEN '1996-03-01' AND '1996-03-31' AND permno % 10 = 2").withColumn("prc", F.round(-F.col("prc"), 2)))
    return table.read(spark).select("permno", "date", "prc", "vol")


def snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.snapshots(spark, sf_dir).select("event_id", "oftic", "anndats", F.col("statpers").cast("timestamp").alias("statpers"), "meanest", "numest")


#: Files that arrive together; the stream takes them at once.
FILES = 24


def stream_consensus(spark, sf_dir):
    """The latest snapshot of every event, out of files that arrive by year of announcement, half of them twice; the stream
    stops after the first files and goes on from its checkpoint."""
    rows, folder, table = snapshot_rows(spark, sf_dir), fresh_path(spark, "arriving"), KeyedTable(fresh_path(spark, "consensus"), ("event_id",), F.expr("pmod(event_id, 16)"), "statpers")
    checkpoint = fresh_path(spark, "stream")
    early = F.col("anndats") < "1997-01-01"

    def arrive(some: DataFrame) -> None:
        some.repartitionByRange(FILES, "statpers").write.mode("append").parquet(folder)
        live.merged(live.once(live.arriving(spark, folder, rows.schema), ["event_id", "statpers"], "statpers", late="4000 days"), table, checkpoint)

    arrive(rows.where(early))
    arrive(rows.where(~early).unionByName(rows.where(early & (F.col("event_id") % 2 == 0))))
    return table.read(spark).select("event_id", "oftic", "anndats", F.to_date("statpers").alias("statpers"), "meanest", "numest")


def stream_scores(spark, sf_dir):
    """Announcements of the last year, scored as they arrive by a model of the events that closed before it."""
    table = X.event_features(spark, sf_dir)
    cutoff = str(table.agg(F.date_sub(F.max("anndats"), 365)).first()[0])
    root, folder, out = fresh_path(spark, "models"), fresh_path(spark, "arriving"), fresh_path(spark, "scores")
    M.train_final(spark, table, root, cutoff)
    requests = table.where(F.col("anndats") > F.lit(cutoff).cast("date")).select("event_id")
    requests.repartition(2).write.parquet(folder)
    live.scored(live.arriving(spark, folder, requests.schema, files_at_once=1), lambda batch: M.scored(spark, root, batch, table), out, fresh_path(spark, "stream"))
    return spark.read.parquet(out).select("event_id", "version", *(F.round(c, 8).alias(c) for c in (*M.NAMES, "drift_z_pred", "prob_up", "coverage")), "error")


_DAILY = "d AS (SELECT o_custkey % 500 AS permno, CAST(o_orderdate AS DATE) AS date, round(max(o_totalprice), 2) AS prc, count(*) AS vol FROM orders GROUP BY ALL)"
ORACLE_SQL = {
    "maintained_daily": f"""WITH {_DAILY},
        cached AS (SELECT * FROM d WHERE permno % 3 <> 0 AND date <= DATE '{CACHED_TO}'),
        ensured AS (SELECT * FROM cached UNION ALL SELECT * FROM d WHERE permno % 2 = 0 AND permno NOT IN (SELECT permno FROM cached)),
        old AS (SELECT permno, max(date) AS newest FROM ensured GROUP BY permno HAVING max(date) < DATE '{TARGET}' - 5),
        topped AS (SELECT * FROM ensured UNION ALL SELECT d.* FROM d JOIN old ON d.permno = old.permno AND d.date > newest),
        fixed AS (SELECT permno, date, round(-prc, 2) AS prc, vol FROM d WHERE date BETWEEN DATE '1996-03-01' AND DATE '1996-03-31' AND permno % 10 = 2)
        SELECT coalesce(f.permno, t.permno) AS permno, coalesce(f.date, t.date) AS date, coalesce(f.prc, t.prc) AS prc, coalesce(f.vol, t.vol) AS vol FROM topped t FULL JOIN fixed f ON f.permno = t.permno AND f.date = t.date""",
    "stream_consensus": E.CTE + "SELECT event_id, oftic, anndats, statpers, meanest, numest FROM snaps QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY statpers DESC) = 1",
}
QUERIES = {name: globals()[name] for name in [*ORACLE_SQL, "stream_scores"]}
