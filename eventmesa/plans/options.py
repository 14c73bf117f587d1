"""The options event study: implied volatility of at-the-money calls before and after announcements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import core as O
from ..sources import adapters as A
from ..sources.staging import kept
from . import equities as E

BEFORE, AFTER, BUCKETS = 5, 60, 10

CTE = """
WITH quotes AS (SELECT l_suppkey secid, CAST(l_shipdate AS DATE) date, year(l_shipdate) AS year, CASE l_returnflag WHEN 'A' THEN 'C' WHEN 'N' THEN 'c' ELSE 'P' END cp_flag, l_discount * 10 delta,
  CASE WHEN l_linenumber <> 7 THEN round(0.2 + l_tax, 6) END impl_volatility, l_quantity volume, l_extendedprice * 1000 strike_price FROM lineitem),
oev AS (SELECT o_orderkey event_id, o_custkey % (SELECT count(*) FROM supplier) secid, CAST(o_orderdate AS DATE) ann_date, round((o_totalprice - 100000) / 1000, 6) surprise FROM orders),
opanel AS (SELECT q.*, event_id, ann_date, surprise, round(strike_price / 1000, 4) strike, date - ann_date rel_day FROM quotes q JOIN oev e ON q.secid = e.secid AND date BETWEEN ann_date - 5 AND ann_date + 60),
feats AS (SELECT event_id, secid, ann_date, surprise, round(avg(impl_volatility) FILTER (atm AND rel_day < 0), 8) iv_pre, round(avg(impl_volatility) FILTER (atm AND rel_day > 0), 8) iv_post,
  count(*) FILTER (atm AND rel_day < 0) n_pre, count(*) FILTER (atm AND rel_day > 0) n_post, sum(volume) total_volume FROM (SELECT *, upper(cp_flag) = 'C' AND round(abs(abs(delta) - 0.5), 9) <= 0.1 atm FROM opanel) GROUP BY ALL),
drifts AS (SELECT *, round(iv_post - iv_pre, 8) iv_drift FROM feats WHERE iv_pre IS NOT NULL AND iv_post IS NOT NULL),
ob AS (SELECT *, CASE WHEN n > 1 THEN greatest((r * 10 + n - 2) // (n - 1), 1) END bucket FROM (SELECT *, row_number() OVER (ORDER BY surprise, event_id) - 1 r, count(*) OVER () n FROM drifts)),
osum AS (SELECT bucket, count(*) AS n, round(avg(surprise), 5) AS mean_surprise, round(avg(iv_drift), 6) AS mean_drift, round(median(iv_drift), 6) AS median_drift, round(avg(total_volume), 5) AS mean_volume FROM ob GROUP BY bucket)
"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.option_events(spark, sf_dir).withColumn("low", F.date_sub("ann_date", BEFORE)).withColumn("high", F.date_add("ann_date", AFTER))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.range_join(A.option_quotes(spark, sf_dir), windows(spark, sf_dir), "secid", "date", "low", "high")
    return rows.withColumn("strike", F.round(F.col("strike_price") / 1000, 4)).withColumn("rel_day", F.date_diff("date", "ann_date")).drop("low", "high")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One aggregate over the panel; day 0 belongs to neither side, volume counts every quote. Whether a quote is at the money
    is told once, before it meets its events."""
    atm = (F.upper("cp_flag") == "C") & (F.round(F.abs(F.abs("delta") - 0.5), 9) <= 0.1)  # decimal distances: 0.6 - 0.5 is no more than 0.1
    quotes = A.option_quotes(spark, sf_dir).select("secid", "date", "volume", atm.alias("atm"), F.when(atm, F.col("impl_volatility")).alias("impl_volatility"))
    rows = O.range_join(quotes, windows(spark, sf_dir), "secid", "date", "low", "high")
    pre, post = F.col("atm") & (F.col("date") < F.col("ann_date")), F.col("atm") & (F.col("date") > F.col("ann_date"))
    iv = lambda side: F.round(F.avg(F.when(side, F.col("impl_volatility"))), 8)
    return rows.groupBy("event_id", "secid", "ann_date", "surprise").agg(iv(pre).alias("iv_pre"), iv(post).alias("iv_post"), F.count_if(pre).alias("n_pre"), F.count_if(post).alias("n_post"), F.sum("volume").alias("total_volume"))


def bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with both sides, in buckets of the surprise; those without a surprise are in none."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        drifts = features(spark, sf_dir).where("iv_pre is not null and iv_post is not null").withColumn("iv_drift", F.round(F.col("iv_post") - F.col("iv_pre"), 8))
        return O.global_rank(drifts, "surprise", ["event_id"], "at").withColumn("bucket", O.bin_of(F.col("at"), F.col("at_n"), BUCKETS)).drop("at", "at_n")

    return kept(spark, sf_dir, "option_buckets", build)


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bucketed(spark, sf_dir)
    medians = O.quantiles_within(rows, ["bucket"], "iv_drift", [0.5], ["median_drift"])
    means = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg("surprise"), 5).alias("mean_surprise"), F.round(F.avg("iv_drift"), 6).alias("mean_drift"), F.round(F.avg("total_volume"), 5).alias("mean_volume"))
    return means.join(F.broadcast(medians), "bucket").withColumn("median_drift", F.round("median_drift", 6))  # one row a bucket


def option_panel(spark, sf_dir):
    return panel(spark, sf_dir).select("event_id", "secid", "date", "cp_flag", "delta", "impl_volatility", "volume", "strike", "rel_day")


def option_event_features(spark, sf_dir):
    return features(spark, sf_dir).select("event_id", "iv_pre", "iv_post", "n_pre", "n_post", "total_volume", F.round(F.col("iv_post") - F.col("iv_pre"), 8).alias("iv_drift"))


def iv_drift_buckets(spark, sf_dir):
    return summary(spark, sf_dir)


def iv_long_short(spark, sf_dir):
    return summary(spark, sf_dir).agg(F.round(F.max_by("mean_drift", "bucket") - F.min_by("mean_drift", "bucket"), 6).alias("spread"))


def missing_partitions(spark, sf_dir):
    """Years that event windows touch and quotes lack."""
    events = A.option_events(spark, sf_dir)
    wanted = events.select(F.explode(F.sequence(F.year(F.date_sub("ann_date", BEFORE)), F.year(F.date_add("ann_date", AFTER)))).alias("year")).distinct()
    return wanted.join(A.option_quotes(spark, sf_dir).select("year").distinct(), "year", "left_anti")


def freshness(spark, sf_dir):
    """Days from each ticker's last price to the last of all, and whether they are more than 4."""
    last = A.prices(spark, sf_dir).groupBy("tic").agg(F.max("date").alias("last"))
    newest = last.agg(F.max("last").alias("newest"))
    return last.join(F.broadcast(newest)).select("tic", F.date_diff("newest", "last").alias("days"), (F.date_diff("newest", "last") > 4).alias("stale"))


def announcements_of(snapshots: DataFrame, *, years: tuple[int, int], least: int = 1) -> DataFrame:
    """The options track's announcements: snapshots of the years with an actual and, where more than one estimate is asked
    for, as many (before the last snapshot is taken); sue_std is null where the deviation is 0; one row a firm and day, its
    last snapshot."""
    rows = snapshots.na.drop(subset=["oftic", "anndats", "actual"]).where(F.year("anndats").between(*years))
    if least > 1:
        rows = rows.where(F.coalesce("numest", F.lit(0)) >= least)
    rows = rows.withColumn("sue_std", F.when(F.col("stdev") != 0, (F.col("actual") - F.col("meanest")) / F.col("stdev")))
    return O.keep_last(rows, ["oftic", "anndats"], "statpers", "event_id")


def option_announcements(spark, sf_dir):
    rows = announcements_of(A.snapshots(spark, sf_dir), years=(1996, 1997), least=2)
    return rows.select("event_id", "oftic", "anndats", "statpers", "numest", F.round("sue_std", 6).alias("sue_std"))


def fresh(prices: DataFrame, as_of, days: int = 4) -> DataFrame:
    """tic, last, days and stale by a given day: whether a firm's last price is more than `days` before it."""
    last = prices.where(F.col("date") <= as_of).groupBy("tic").agg(F.max("date").alias("last"))
    return last.select("tic", "last", F.date_diff(as_of, "last").alias("days"), (F.date_diff(as_of, "last") > days).alias("stale"))


def freshness_as_of(spark, sf_dir):
    """Freshness by a day on which prices still came."""
    return fresh(A.prices(spark, sf_dir), F.lit(AS_OF).cast("date"))


#: The day of `freshness_as_of`.
AS_OF = "1998-11-30"
PRICES = " prices AS (SELECT upper(n_name) tic, CAST(l_shipdate AS DATE) date FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'SPY', CAST(l_shipdate AS DATE) FROM lineitem) "
ORACLE_SQL = {
    "option_panel": CTE + "SELECT event_id, secid, date, cp_flag, delta, impl_volatility, volume, strike, rel_day FROM opanel",
    "option_event_features": CTE + "SELECT event_id, iv_pre, iv_post, n_pre, n_post, total_volume, round(iv_post - iv_pre, 8) AS iv_drift FROM feats",
    "iv_drift_buckets": CTE + "SELECT * FROM osum",
    "iv_long_short": CTE + "SELECT round(max_by(mean_drift, bucket) - min_by(mean_drift, bucket), 6) AS spread FROM osum",
    "missing_partitions": CTE + "SELECT DISTINCT y AS year FROM (SELECT unnest(range(year(ann_date - 5), year(ann_date + 60) + 1)) y FROM oev) WHERE y NOT IN (SELECT year FROM quotes)",
    "freshness_as_of": f"WITH {PRICES} SELECT tic, max(date) AS last, DATE '{AS_OF}' - max(date) AS days, DATE '{AS_OF}' - max(date) > 4 AS stale FROM prices WHERE date <= DATE '{AS_OF}' GROUP BY tic",
    "option_announcements": E.CTE + "SELECT event_id, oftic, anndats, statpers, numest, round(CASE WHEN stdev <> 0 THEN (actual - meanest) / stdev END, 6) AS sue_std FROM snaps WHERE year(anndats) BETWEEN 1996 AND 1997 AND numest >= 2 QUALIFY row_number() OVER (PARTITION BY oftic, anndats ORDER BY statpers DESC, event_id DESC) = 1",
    "freshness": "WITH" + PRICES + "SELECT tic, newest - last AS days, newest - last > 4 AS stale FROM (SELECT tic, max(date) last FROM prices GROUP BY 1), (SELECT max(date) newest FROM prices)",
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
