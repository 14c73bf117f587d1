"""Tables that scoring reads and returns: closed events of an industry, ordered quantiles, pooled out-of-sample metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import core as O
from ..sources import adapters as A
from . import validation as V

CLOSED_AFTER = 84  # calendar days of a 60-session window
QUANTILES = [name for name, _ in V.QUANTILES]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    industry = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("industry"))
    return A.backtest(spark, sf_dir).join(industry, "o_custkey").select("event_id", "industry", F.to_date("o_orderdate").alias("anndats"), "drift_raw")


def industry_history(spark, sf_dir):
    """Each event's drift with the day from which it is known."""
    return events(spark, sf_dir).select("event_id", "industry", F.date_add("anndats", CLOSED_AFTER).alias("close_date"), "drift_raw")


def industry_drift_from_history(spark, sf_dir):
    """Mean drift of an industry's events that closed by the announcement: running sums over days, then one as-of join."""
    days = industry_history(spark, sf_dir).groupBy("industry", "close_date").agg(F.sum("drift_raw").alias("s"), F.count("*").alias("c"))
    w = Window.partitionBy("industry").orderBy("close_date")
    known = days.select("industry", "close_date", (F.sum("s").over(w) / F.sum("c").over(w)).alias("mean"), F.sum("c").over(w).alias("n"))
    found = O.asof_backward(events(spark, sf_dir).select("event_id", "industry", "anndats"), known, "industry", "anndats", "close_date", ["mean", "n"])
    return found.select("event_id", F.round("mean", 8).alias("industry_drift"), F.coalesce("n", F.lit(0)).alias("n"))


def sorted_quantiles(spark, sf_dir):
    """Quantile heads fitted apart may cross; a row's predictions are put in order."""
    raw = [F.col("pred_q10") + (F.col("event_id") % 3) * 0.04, *map(F.col, QUANTILES[1:])]
    heads = A.backtest(spark, sf_dir).select("event_id", *(c.alias(name) for c, name in zip(raw, QUANTILES, strict=True)))
    return heads.select("event_id", *S.non_crossing(*QUANTILES)).select("event_id", *(F.round(name, 8).alias(name) for name in QUANTILES))


def pooled_oos(spark, sf_dir):
    """Test rows of all folds together: folds, rows, mean error and share inside the 80% interval."""
    tested = V.folds(spark, sf_dir).select("fold", F.col("test_q").alias("cal_q")).distinct()
    rows = A.backtest(spark, sf_dir).join(F.broadcast(tested), "cal_q")  # one row a fold
    inside = F.col("drift_raw").between(F.col("pred_q10"), F.col("pred_q90")).cast("int")
    return rows.agg(F.count_distinct("fold").alias("n_folds"), F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("drift_raw") - F.col("pred_q50"))), 8).alias("mae"), F.round(F.avg(inside), 6).alias("coverage"))


HISTORY = f"(SELECT event_id, c_nationkey AS industry, CAST(o_orderdate AS DATE) AS anndats, CAST(o_orderdate AS DATE) + {CLOSED_AFTER} AS close_date, drift_raw FROM bt JOIN customer ON c_custkey = o_custkey)"
SQL = {
    "industry_history": f"SELECT event_id, industry, close_date, drift_raw FROM {HISTORY}",
    "industry_drift_from_history": f"SELECT x.event_id, round(avg(y.drift_raw), 8) AS industry_drift, count(y.event_id) AS n FROM {HISTORY} x LEFT JOIN {HISTORY} y ON x.industry = y.industry AND y.close_date <= x.anndats GROUP BY x.event_id",
    "sorted_quantiles": "SELECT event_id, " + ", ".join(f"round(q[{i + 1}], 8) AS {name}" for i, name in enumerate(QUANTILES)) + " FROM (SELECT event_id, list_sort([pred_q10 + (event_id % 3) * 0.04, pred_q25, pred_q50, pred_q75, pred_q90]) AS q FROM bt)",
    "pooled_oos": f"SELECT count(DISTINCT fold) AS n_folds, count(*) AS n, round(avg(abs(drift_raw - pred_q50)), 8) AS mae, round(avg((drift_raw BETWEEN pred_q10 AND pred_q90)::INT), 6) AS coverage FROM bt JOIN (SELECT DISTINCT fold, test_q FROM {V.FOLDS}) ON test_q = cal_q",
}
QUERIES = {name: globals()[name] for name in SQL}
ORACLE_SQL = {name: V.CTE + sql for name, sql in SQL.items()}
