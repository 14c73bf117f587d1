"""Splits, metrics and attribution tables of the drift study."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import core as O
from ..sources import adapters as A
from ..sources.staging import kept

CTE = """
WITH bt0 AS (SELECT o_orderkey event_id, o_custkey, o_orderdate, round((o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey)) / 1e6, 9) drift_raw FROM orders),
bt1 AS (SELECT *, round(drift_raw * 0.5 + (event_id % 97 - 48) / 1e4, 9) pred_q50 FROM bt0),
bt AS (SELECT *, round(pred_q50 - 0.05, 9) pred_q10, round(pred_q50 - 0.02, 9) pred_q25, round(pred_q50 + 0.02, 9) pred_q75, round(pred_q50 + 0.05, 9) pred_q90, round(1 / (1 + exp(-50 * pred_q50)), 9) prob_up, year(o_orderdate) || 'Q' || quarter(o_orderdate) cal_q FROM bt1),
ranks AS (SELECT *, rank() OVER (PARTITION BY cal_q ORDER BY drift_raw) + (count(*) OVER (PARTITION BY cal_q, drift_raw) - 1) / 2 ry, rank() OVER (PARTITION BY cal_q ORDER BY pred_q50) + (count(*) OVER (PARTITION BY cal_q, pred_q50) - 1) / 2 rp FROM bt),
qs AS (SELECT cal_q, row_number() OVER (ORDER BY cal_q) - 1 k FROM (SELECT DISTINCT cal_q FROM bt)),
imp AS (SELECT cal_q fold, o_orderpriority feature, avg(abs(drift_raw)) imp, avg(drift_raw) signed FROM bt JOIN orders ON event_id = o_orderkey GROUP BY ALL)
"""
HORIZON, EMBARGO_MONTHS, LEAST_QUARTERS = 60, 3, 8
GAP = max(1, -(-HORIZON // 63)) + -(-EMBARGO_MONTHS // 3)


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cal_q, k from 0: one row a quarter."""
    return A.backtest(spark, sf_dir).select("cal_q").distinct().withColumn("k", F.row_number().over(Window.orderBy("cal_q")) - 1)


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purged and embargoed walk-forward: fold k tests its quarter and trains on those GAP or more before it."""
    q = quarters(spark, sf_dir)
    train = q.select(F.col("cal_q").alias("train_q"), F.col("k").alias("j"))
    return q.where(F.col("k") - GAP >= LEAST_QUARTERS).join(F.broadcast(train), F.col("j") <= F.col("k") - 1 - GAP).select(F.col("k").alias("fold"), F.col("cal_q").alias("test_q"), "train_q")


def importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.backtest(spark, sf_dir).join(A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("feature")), "event_id")
    return rows.groupBy(F.col("cal_q").alias("fold"), "feature").agg(F.avg(F.abs("drift_raw")).alias("imp"), F.avg("drift_raw").alias("signed"))


def walk_forward_folds(spark, sf_dir):
    return folds(spark, sf_dir)


def tuning_test_split(spark, sf_dir):
    q = quarters(spark, sf_dir)
    n = q.agg(F.count("*").alias("n")).withColumn("test", F.least(F.greatest(F.bround(F.col("n") * 0.25).cast("int"), F.lit(1)), F.col("n") - 1))
    return q.join(F.broadcast(n)).select("cal_q", F.when(F.col("k") >= F.col("n") - F.col("test"), "test").otherwise("tune").alias("part"))


def holdout(spark, sf_dir):
    """The latest quarter of each fold's training window, where it has more than one."""
    last = folds(spark, sf_dir).groupBy("fold").agg(F.max("train_q").alias("holdout_q"), F.count("*").alias("n"))
    return last.where("n > 1").select("fold", "holdout_q")


def holdouts(folds: DataFrame, n: int) -> DataFrame:
    """The latest n quarters of each fold's training window, for early stopping; none of a window without more than n."""
    w = Window.partitionBy("fold")
    rows = folds.withColumn("r", F.row_number().over(w.orderBy(F.col("train_q").desc()))).withColumn("every", F.count("*").over(w))  # quarters of a fold
    return rows.where((F.col("r") <= n) & (F.col("every") > n)).select("fold", F.col("train_q").alias("holdout_q"))


def holdout_of_ten(spark, sf_dir):
    """The latest ten quarters of each fold's training window; early folds have too few."""
    return holdouts(folds(spark, sf_dir), 10)


def train_standardize(spark, sf_dir):
    """Each fold's test rows in units of its training rows. Quarters' counts, means and squared deviations are merged, so
    large means don't cancel."""
    rows = A.backtest(spark, sf_dir).select("event_id", "cal_q", F.col("pred_q50").alias("x"))
    stats = rows.groupBy("cal_q").agg(F.count("x").alias("n"), F.avg("x").alias("m"), (F.var_pop("x") * F.count("x")).alias("m2"))
    w = Window.partitionBy("fold")
    train = folds(spark, sf_dir).join(stats, F.col("train_q") == F.col("cal_q")).withColumn("mean", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    merged = train.groupBy("fold", "test_q", "mean").agg(F.sqrt(F.sum(F.col("m2") + F.col("n") * (F.col("m") - F.col("mean")) ** 2) / F.sum("n")).alias("sd"))
    merged = merged.withColumn("sd", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0))
    return rows.join(F.broadcast(merged), F.col("cal_q") == F.col("test_q")).select("fold", "event_id", F.round((F.col("x") - F.col("mean")) / F.col("sd"), 6).alias("z"))  # one row a fold


def finite(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows in which all of the columns are numbers."""
    for c in columns:
        rows = rows.where(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows


def ic_by_quarter(spark, sf_dir):
    rows = O.average_ranks(O.average_ranks(finite(A.backtest(spark, sf_dir).select("cal_q", "drift_raw", "pred_q50"), "drift_raw", "pred_q50"), ["cal_q"], "drift_raw", "ry"), ["cal_q"], "pred_q50", "rp")
    return rows.groupBy("cal_q").agg(F.count("*").alias("n"), F.round(F.corr("ry", "rp"), 6).alias("ic"))


def spearman_ic(spark, sf_dir):
    """Null for fewer than three rows."""
    rows = O.average_ranks(O.average_ranks(finite(A.backtest(spark, sf_dir).select("drift_raw", "pred_q50"), "drift_raw", "pred_q50"), [], "drift_raw", "ry"), [], "pred_q50", "rp")
    return rows.agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, F.round(F.corr("ry", "rp"), 6)).alias("ic"))


def decile_rows(spark, sf_dir, value: str) -> DataFrame:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return O.global_rank(A.backtest(spark, sf_dir), value, ["event_id"], "at").withColumn("bin", O.bin_of(F.col("at"), F.col("at_n"), 10)).drop("at")

    return kept(spark, sf_dir, f"deciles_{value}", build)


def r2_spread(spark, sf_dir):
    rows = finite(decile_rows(spark, sf_dir, "pred_q50"), "drift_raw", "pred_q50")
    y, p, enough = F.col("drift_raw"), F.col("pred_q50"), F.count("*") >= 3
    total = F.var_pop(y) * F.count("*")
    r2 = F.when(enough & (total > 0), 1 - F.sum((y - p) ** 2) / total)
    spread = F.when(F.count("*") >= 10, F.avg(F.when(F.col("bin") == 10, y)) - F.avg(F.when(F.col("bin") == 1, y)))
    cover = F.avg(F.when(y.between(F.col("pred_q10"), F.col("pred_q90")), 1.0).otherwise(0.0))
    return rows.agg(F.round(r2, 6).alias("r2"), F.round(spread, 8).alias("spread"), F.round(cover, 6).alias("coverage"))


def auc_of(rows: DataFrame, outcome: str, score: str) -> DataFrame:
    """n, roc_auc (rank sums, ties averaged) and pr_auc (average precision) of a 0/1 outcome, from counts by distinct score;
    null unless there are three rows and both outcomes."""
    counts = finite(rows, outcome, score).groupBy(score).agg(F.sum(outcome).alias("pos"), F.count("*").alias("n"))
    placed = O.prefix_sums(counts, [score], {"p": F.col("pos"), "c": F.col("n")})
    negatives = F.col("c_before") - F.col("p_before") + (F.col("n") - F.col("pos")) / 2
    precision = (F.col("p_all") - F.col("p_before")) / (F.col("c_all") - F.col("c_before"))
    positive, every = F.sum("pos"), F.sum("n")
    both = (every >= 3) & (positive > 0) & (positive < every)
    return placed.agg(every.alias("n"), F.when(both, F.round(F.sum(F.col("pos") * negatives) / positive / (every - positive), 6)).alias("roc_auc"), F.when(both, F.round(F.sum(F.col("pos") * precision) / positive, 6)).alias("pr_auc"))


def roc_pr_auc(spark, sf_dir):
    rows = A.backtest(spark, sf_dir).select((F.col("drift_raw") > 0).cast("int").alias("up"), "prob_up")
    return auc_of(rows, "up", "prob_up").drop("n")


QUANTILES = (("pred_q10", 0.1), ("pred_q25", 0.25), ("pred_q50", 0.5), ("pred_q75", 0.75), ("pred_q90", 0.9))


def unpivoted(spark, sf_dir) -> DataFrame:
    cells = F.explode(F.array(*(F.struct(F.lit(a).alias("alpha"), F.col(c).alias("p")) for c, a in QUANTILES)))
    return A.backtest(spark, sf_dir).select("drift_raw", cells.alias("cell")).select("drift_raw", "cell.*")


def pinball(spark, sf_dir):
    return finite(unpivoted(spark, sf_dir), "drift_raw", "p").groupBy("alpha").agg(F.round(F.avg(S.pinball(F.col("drift_raw"), F.col("p"), F.col("alpha"))), 8).alias("loss"))


def quantile_calibration(spark, sf_dir):
    return unpivoted(spark, sf_dir).groupBy("alpha").agg(F.round(F.avg((F.col("drift_raw") <= F.col("p")).cast("int")), 6).alias("share"))


def calibration(spark, sf_dir):
    return decile_rows(spark, sf_dir, "pred_q50").groupBy("bin").agg(F.round(F.avg("pred_q50"), 8).alias("predicted"), F.round(F.avg("drift_raw"), 8).alias("realised"), F.count("*").alias("n"))


def reliability(spark, sf_dir):
    return decile_rows(spark, sf_dir, "prob_up").groupBy("bin").agg(F.round(F.avg("prob_up"), 8).alias("predicted"), F.round(F.avg((F.col("drift_raw") > 0).cast("int")), 6).alias("realised"), F.count("*").alias("n"))


FACTORS, LAGS = ["sue_std", "analyst_disp", "surprise_raw"], 4


def slopes(rows: DataFrame, features: list[str], target: str, quarter: str) -> DataFrame:
    """quarter, feature, b: least squares of the target on all features, in each quarter with max(10, k + 2) rows or more.

    Features are standardised within the quarter; those that don't vary are left out of it, missing values and NaN become 0.
    Each task adds up the products of its rows by quarter, Spark adds up tasks by (quarter, place in the upper triangle), and
    only a quarter's k by k table is solved in Python, so any number of features will do."""
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    rows = rows.where(F.col(target).isNotNull()).select(F.col(quarter).alias("quarter"), F.col(target).cast("double").alias("y"), *(number(c).alias(f"x{i}") for i, c in enumerate(features)))
    k = len(features)
    stats = rows.groupBy("quarter").agg(F.count("*").alias("n"), *(f(f"x{i}").alias(f"{n}{i}") for i in range(k) for n, f in (("m", F.avg), ("s", F.stddev_pop)))).where(F.col("n") >= max(10, k + 2))
    z = F.array(*(F.coalesce((F.col(f"x{i}") - F.col(f"m{i}")) / F.when(F.col(f"s{i}") > 0, F.col(f"s{i}")), F.lit(0.0)) for i in range(k)), F.col("y"))
    scaled = rows.join(F.broadcast(stats), "quarter").select("quarter", z.alias("z"))  # one row a quarter
    upper = np.triu_indices(k + 1)

    def products(batches):
        sums = {}
        for batch in batches:
            for q, some in batch.groupby("quarter"):
                x = np.stack(some["z"].to_numpy())
                sums[q] = sums.get(q, 0) + (x.T @ x)[upper]
        yield pd.concat([pd.DataFrame({"quarter": q, "place": np.arange(len(v)), "v": v}) for q, v in sums.items()] or [pd.DataFrame({"quarter": [], "place": [], "v": []})])

    tables = scaled.mapInPandas(products, "quarter string, place int, v double").groupBy("quarter", "place").agg(F.sum("v").alias("v"))
    tables = tables.groupBy("quarter").agg(F.array_sort(F.collect_list(F.struct("place", "v"))).alias("cells")).select("quarter", F.col("cells.v").alias("v"))

    def solve(batches):
        for batch in batches:
            out = []
            for q, v in zip(batch["quarter"], batch["v"], strict=True):
                table = np.zeros((k + 1, k + 1))
                table[upper] = v
                table = table + np.triu(table, 1).T
                alive = np.flatnonzero(table.diagonal()[:k] > 0)
                b = np.linalg.lstsq(table[np.ix_(alive, alive)], table[alive, k], rcond=None)[0]
                out += [(q, features[i], float(x)) for i, x in zip(alive, b, strict=True)]
            yield pd.DataFrame(out, columns=["quarter", "feature", "b"])

    return tables.mapInPandas(solve, "quarter string, feature string, b double")


def mean_with_t(series: DataFrame, by: list[str], order: str, value: str, lags: int = LAGS) -> DataFrame:
    """Per series: mean, n, share of positive values and the t of the mean by Newey and West, with Bartlett weights over
    min(lags, n - 1) lags. Null for fewer than two values; where the variance isn't positive the t is null."""
    every, ordered = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(order)
    rows = series.withColumn("mean", F.avg(value).over(every)).withColumn("n", F.count(value).over(every)).withColumn("e", F.col(value) - F.col("mean"))
    rows = rows.select(*by, value, "mean", "n", "e", *(F.lag("e", k).over(ordered).alias(f"e{k}") for k in range(1, lags + 1)))
    most, var = F.least(F.max("n") - 1, F.lit(lags)), F.sum(F.col("e") ** 2)
    for k in range(1, lags + 1):
        var = var + F.when(most >= k, 2 * (1 - k / (most + 1)) * F.sum(F.col("e") * F.col(f"e{k}"))).otherwise(0.0)
    t = F.when((F.max("n") >= 2) & (var > 0), F.max("mean") * F.max("n") / F.sqrt(var))
    return rows.groupBy(*by).agg(F.max("mean").alias("mean"), t.alias("t"), F.max("n").alias("n"), F.avg((F.col(value) > 0).cast("int")).alias("frac_positive"))


def fama_macbeth(spark, sf_dir):
    """Each feature's slope, averaged over quarters, with its t and how often it is positive."""
    from . import features as X

    per = slopes(X.own_features(spark, sf_dir), FACTORS, f"drift_z_h{HORIZON}", "cal_q")
    return mean_with_t(per, ["feature"], "quarter", "b").select("feature", F.round("mean", 6).alias("coef"), F.round("t", 3).alias("t"), F.col("n").alias("n_quarters"), F.round("frac_positive", 6).alias("frac_positive"))


def all_slopes(table: DataFrame, target: str) -> DataFrame:
    """Fama-MacBeth over all numeric features: feature, coef, t, n_quarters, frac_positive. A feature that varies in no
    quarter has a row of nulls."""
    from . import models as M

    numbers = [c for c in M.feature_columns(table) if table.schema[c].dataType.typeName() != "string"]
    found = mean_with_t(slopes(table, numbers, target, "cal_q"), ["feature"], "quarter", "b")
    names = F.broadcast(table.sparkSession.createDataFrame([(c,) for c in numbers], "feature string"))  # one row a feature
    return names.join(found, "feature", "left").select("feature", F.col("mean").alias("coef"), "t", F.coalesce("n", F.lit(0)).alias("n_quarters"), "frac_positive")


def slopes_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import features as X

    return kept(spark, sf_dir, "slopes_of_all", lambda spark, sf_dir: all_slopes(X.event_features(spark, sf_dir), f"drift_z_h{HORIZON}"))


def fama_macbeth_all(spark, sf_dir):
    """The slopes of all numeric features together."""
    return slopes_of_all(spark, sf_dir).select("feature", F.round("coef", 6).alias("coef"), F.round("t", 3).alias("t"), "n_quarters", F.round("frac_positive", 6).alias("frac_positive"))


def newey_west(spark, sf_dir):
    """t of the mean of a quarterly series; the series has one row a quarter."""
    series = A.backtest(spark, sf_dir).groupBy("cal_q").agg(F.avg("pred_q50").alias("b")).withColumn("one", F.lit(1))
    return mean_with_t(series, ["one"], "cal_q", "b").select(F.round("mean", 9).alias("mean"), F.round("t", 4).alias("t"))


def importance_pool(spark, sf_dir):
    return importances(spark, sf_dir).groupBy("feature").agg(F.round(F.avg("imp"), 8).alias("imp"), F.round(F.stddev_samp("imp"), 8).alias("imp_std"), F.round(F.avg("signed"), 8).alias("signed"), F.count("*").alias("n_folds"))


def rank_stability(spark, sf_dir, top: int = 2):
    ranked = importances(spark, sf_dir).withColumn("r", F.rank().over(Window.partitionBy("fold").orderBy(F.round("imp", 10).desc())))
    all_folds = importances(spark, sf_dir).agg(F.countDistinct("fold").alias("folds"))
    return ranked.join(F.broadcast(all_folds)).groupBy("feature").agg(F.round(F.avg("r"), 6).alias("mean_rank"), F.round(F.stddev_pop("r"), 6).alias("rank_std"), F.round(F.sum((F.col("r") <= top).cast("int")) / F.first("folds"), 6).alias("hit_rate"))


def consistency_table(spark, sf_dir):
    """Pooled importances with their stability, and a score from hits, rank spread and the t of the signed mean."""
    pool, stable = importance_pool(spark, sf_dir), rank_stability(spark, sf_dir)
    t = importances(spark, sf_dir).groupBy("feature").agg((F.avg("signed") / F.nullif(F.stddev_samp("signed") / F.sqrt(F.count("*")), F.lit(0.0))).alias("t"))
    most = stable.agg(F.max("rank_std").alias("most"))
    rows = pool.join(stable, "feature", "left").join(t, "feature", "left").join(F.broadcast(most))
    score = 0.5 * F.col("hit_rate") + 0.3 * (1 - F.col("rank_std") / F.col("most")) + 0.2 * F.least(F.abs("t") / 2, F.lit(1.0))
    return rows.select("feature", "imp", "mean_rank", "hit_rate", F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 5).alias("score"))


def top_drivers(spark, sf_dir):
    w = Window.partitionBy("fold").orderBy(F.round("imp", 10).desc(), "feature")
    return importances(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r <= 3").select("fold", "feature", "r")


def size_terciles(spark, sf_dir):
    customer = A.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    cuts = O.quantiles_within(customer.withColumn("all", F.lit(0)), ["all"], "c_acctbal", [1 / 3, 2 / 3], ["low", "high"])
    size = F.when(F.col("c_acctbal") <= F.col("low"), "small").when(F.col("c_acctbal") <= F.col("high"), "mid").otherwise("large")
    return customer.join(F.broadcast(cuts)).select("c_custkey", size.alias("size"))  # one row


def descriptive_contrast(spark, sf_dir):
    rows = decile_rows(spark, sf_dir, "drift_raw").where("bin in (1, 10)")
    cells = rows.select("bin", F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in ("pred_q50", "prob_up")))).alias("cell")).select("bin", "cell.*")
    top, low = F.when(F.col("bin") == 10, F.col("x")), F.when(F.col("bin") == 1, F.col("x"))
    pooled = F.sqrt((F.var_samp(top) + F.var_samp(low)) / 2)
    return cells.groupBy("feature").agg(F.round(F.avg(top), 7).alias("top"), F.round(F.avg(low), 7).alias("bottom"), F.round((F.avg(top) - F.avg(low)) / F.nullif(pooled, F.lit(0.0)), 5).alias("d"))


def feature_summary(spark, sf_dir):
    cells = A.backtest(spark, sf_dir).select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in ("drift_raw", "pred_q50", "prob_up")))).alias("cell")).select("cell.*")
    middle = O.quantiles_within(cells, ["feature"], "x", [0.5], ["middle"]).withColumnRenamed("feature", "of")
    rows = cells.groupBy("feature").agg(F.count("x").alias("n_present"), F.round(100 * F.count("x") / F.count("*"), 1).alias("pct"), F.round(F.avg("x"), 7).alias("mean"), F.round(F.stddev_samp("x"), 7).alias("std"), F.round(F.min("x"), 7).alias("min"), F.round(F.max("x"), 7).alias("max"))
    return rows.join(F.broadcast(middle), F.col("feature") == F.col("of"), "left").withColumn("median", F.round("middle", 7)).drop("of", "middle")  # one row a feature


def closed_window_cutoff(spark, sf_dir):
    last = A.backtest(spark, sf_dir).agg(F.date_sub(F.max(F.to_date("o_orderdate")), 365).alias("cutoff"))
    rows = A.backtest(spark, sf_dir).withColumn("anndats", F.to_date("o_orderdate")).join(F.broadcast(last))
    return rows.where((F.col("anndats") <= F.col("cutoff")) & (S.approx_close(F.col("anndats"), 60) <= F.col("cutoff"))).select("event_id", "anndats")


BIN = "CASE WHEN n > 1 THEN greatest((r * 10 + n - 2) // (n - 1), 1) END"
binned = lambda value: f"(SELECT *, {BIN} AS bin FROM (SELECT *, row_number() OVER (ORDER BY {value}, event_id) - 1 r, count(*) OVER () n FROM bt))"
CELLS = "(SELECT drift_raw, unnest([0.1, 0.25, 0.5, 0.75, 0.9]::DOUBLE[]) alpha, unnest([pred_q10, pred_q25, pred_q50, pred_q75, pred_q90]) p FROM bt)"
FOLDS = f"(SELECT a.k AS fold, a.cal_q AS test_q, b.cal_q AS train_q FROM qs a JOIN qs b ON b.k <= a.k - 1 - {GAP} WHERE a.k - {GAP} >= {LEAST_QUARTERS})"
POOL = "(SELECT feature, round(avg(imp), 8) AS imp, round(stddev_samp(imp), 8) AS imp_std, round(avg(signed), 8) AS signed, count(*) AS n_folds, avg(signed) / nullif(stddev_samp(signed) / sqrt(count(*)), 0) t FROM imp GROUP BY feature)"
STABLE = "(SELECT feature, round(avg(r), 6) AS mean_rank, round(stddev_pop(r), 6) AS rank_std, round(sum((r <= 2)::INT) / (SELECT count(DISTINCT fold) FROM imp), 6) AS hit_rate FROM (SELECT *, rank() OVER (PARTITION BY fold ORDER BY round(imp, 10) DESC) r FROM imp) GROUP BY feature)"
def newey_sql(series: str) -> str:
    """feature, mean, t, n, frac_positive of a series (cal_q, feature, b)."""
    lags = ", ".join(f"lag(e, {k}) OVER w e{k}" for k in range(1, LAGS + 1))
    var = "sum(e * e) + " + " + ".join(f"CASE WHEN least({LAGS}, max(n) - 1) >= {k} THEN 2 * (1 - {k} / (least({LAGS}, max(n) - 1) + 1)) * sum(e * e{k}) ELSE 0 END" for k in range(1, LAGS + 1))
    return f"""SELECT feature, max(m) AS mean, max(m) * max(n) / sqrt({var}) AS t, max(n) AS n, avg((b > 0)::INT) AS frac_positive FROM (SELECT feature, b, m, n, e, {lags} FROM
        (SELECT *, b - avg(b) OVER f e, avg(b) OVER f m, count(*) OVER f n FROM {series} WINDOW f AS (PARTITION BY feature)) WINDOW w AS (PARTITION BY feature ORDER BY cal_q)) GROUP BY feature"""


def fama_sql() -> str:
    """Over event_features (ef): three features, solved by determinants."""
    z = ", ".join(f"coalesce(({c} - avg({c}) OVER q) / nullif(stddev_pop({c}) OVER q, 0), 0) z{i}" for i, c in enumerate(FACTORS))
    sums = ", ".join([f"sum(z{i} * z{j}) a{i}{j}" for i in range(3) for j in range(3)] + [f"sum(z{i} * y) r{i}" for i in range(3)])
    det = lambda m: f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]}) + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"
    table = [[f"a{i}{j}" for j in range(3)] for i in range(3)]
    put = lambda c: [[f"r{i}" if j == c else table[i][j] for j in range(3)] for i in range(3)]
    solved = " UNION ALL ".join(f"SELECT cal_q, '{name}' AS feature, {det(put(c))} / {det(table)} AS b FROM gram" for c, name in enumerate(FACTORS))
    return f"""gram AS (SELECT cal_q, {sums} FROM (SELECT cal_q, drift_z_h{HORIZON} y, {z} FROM ef WHERE drift_z_h{HORIZON} IS NOT NULL WINDOW q AS (PARTITION BY cal_q)) GROUP BY cal_q HAVING count(*) >= 10), slopes AS ({solved})
        SELECT feature, round(mean, 6) AS coef, round(t, 3) AS t, n AS n_quarters, round(frac_positive, 6) AS frac_positive FROM ({newey_sql('slopes')})"""


SQL = {
    "walk_forward_folds": f"SELECT * FROM {FOLDS}",
    "tuning_test_split": "SELECT cal_q, CASE WHEN k >= n - least(greatest(CAST(round_even(n * 0.25, 0) AS INT), 1), n - 1) THEN 'test' ELSE 'tune' END AS part FROM qs, (SELECT count(*) n FROM qs)",
    "holdout": f"SELECT fold, max(train_q) AS holdout_q FROM {FOLDS} GROUP BY fold HAVING count(*) > 1",
    "holdout_of_ten": f"SELECT fold, train_q AS holdout_q FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY train_q DESC) r, count(*) OVER (PARTITION BY fold) n FROM {FOLDS}) WHERE r <= 10 AND n > 10",
    "train_standardize": f"SELECT fold, event_id, round((pred_q50 - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) AS z FROM (SELECT fold, test_q, avg(pred_q50) m, stddev_pop(pred_q50) s FROM {FOLDS} JOIN bt ON train_q = cal_q GROUP BY ALL) JOIN bt ON test_q = cal_q",
    "ic_by_quarter": "SELECT cal_q, count(*) AS n, round(corr(ry, rp), 6) AS ic FROM ranks GROUP BY cal_q",
    "spearman_ic": "SELECT count(*) AS n, round(corr(ry, rp), 6) AS ic FROM (SELECT rank() OVER (ORDER BY drift_raw) + (count(*) OVER (PARTITION BY drift_raw) - 1) / 2 ry, rank() OVER (ORDER BY pred_q50) + (count(*) OVER (PARTITION BY pred_q50) - 1) / 2 rp FROM bt)",
    "r2_spread": f"SELECT round(1 - sum((drift_raw - pred_q50) ** 2) / (sum(drift_raw * drift_raw) - sum(drift_raw) ** 2 / count(*)), 6) AS r2, round(avg(drift_raw) FILTER (bin = 10) - avg(drift_raw) FILTER (bin = 1), 8) AS spread, round(avg(CASE WHEN drift_raw BETWEEN pred_q10 AND pred_q90 THEN 1 ELSE 0 END), 6) AS coverage FROM {binned('pred_q50')}",
    "roc_pr_auc": """SELECT round(sum(pos * (nb - pb + (n - pos) / 2)) / (max(ap) * (max(an) - max(ap))), 6) AS roc_auc, round(sum(pos * (ap - pb) / (an - nb)) / max(ap), 6) AS pr_auc FROM
        (SELECT *, sum(pos) OVER w - pos pb, sum(n) OVER w - n nb, sum(pos) OVER () ap, sum(n) OVER () an FROM (SELECT prob_up, sum((drift_raw > 0)::INT) pos, count(*) n FROM bt GROUP BY 1) WINDOW w AS (ORDER BY prob_up))""",
    "pinball": f"SELECT alpha, round(avg(greatest(alpha * (drift_raw - p), (alpha - 1) * (drift_raw - p))), 8) AS loss FROM {CELLS} GROUP BY alpha",
    "quantile_calibration": f"SELECT alpha, round(avg((drift_raw <= p)::INT), 6) AS share FROM {CELLS} GROUP BY alpha",
    "calibration": f"SELECT bin, round(avg(pred_q50), 8) AS predicted, round(avg(drift_raw), 8) AS realised, count(*) AS n FROM {binned('pred_q50')} GROUP BY bin",
    "reliability": f"SELECT bin, round(avg(prob_up), 8) AS predicted, round(avg((drift_raw > 0)::INT), 6) AS realised, count(*) AS n FROM {binned('prob_up')} GROUP BY bin",
    "newey_west": f"SELECT round(mean, 9) AS mean, round(t, 4) AS t FROM ({newey_sql('(SELECT cal_q, 1 AS feature, avg(pred_q50) b FROM bt GROUP BY 1)')})",
    "importance_pool": f"SELECT * EXCLUDE (t) FROM {POOL}",
    "rank_stability": f"SELECT * FROM {STABLE}",
    "consistency_table": f"SELECT feature, imp, mean_rank, hit_rate, round(least(greatest(0.5 * hit_rate + 0.3 * (1 - rank_std / (SELECT max(rank_std) FROM {STABLE})) + 0.2 * least(abs(t) / 2, 1), 0), 1), 5) AS score FROM {POOL} LEFT JOIN {STABLE} USING (feature)",
    "top_drivers": "SELECT fold, feature, r FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(imp, 10) DESC, feature) r FROM imp) WHERE r <= 3",
    "size_terciles": "SELECT c_custkey, CASE WHEN c_acctbal <= a THEN 'small' WHEN c_acctbal <= b THEN 'mid' ELSE 'large' END AS size FROM customer, (SELECT quantile_cont(c_acctbal, 1 / 3) a, quantile_cont(c_acctbal, 2 / 3) b FROM customer)",
    "descriptive_contrast": f"SELECT feature, round(avg(x) FILTER (bin = 10), 7) AS top, round(avg(x) FILTER (bin = 1), 7) AS bottom, round((avg(x) FILTER (bin = 10) - avg(x) FILTER (bin = 1)) / nullif(sqrt((var_samp(x) FILTER (bin = 10) + var_samp(x) FILTER (bin = 1)) / 2), 0), 5) AS d FROM (SELECT bin, unnest(['pred_q50', 'prob_up']) feature, unnest([pred_q50, prob_up]) x FROM {binned('drift_raw')}) GROUP BY feature",
    "feature_summary": "SELECT feature, count(x) AS n_present, round(100 * count(x) / count(*), 1) AS pct, round(avg(x), 7) AS mean, round(stddev_samp(x), 7) AS std, round(min(x), 7) AS min, round(median(x), 7) AS median, round(max(x), 7) AS max FROM (SELECT unnest(['drift_raw', 'pred_q50', 'prob_up']) feature, unnest([drift_raw, pred_q50, prob_up]) x FROM bt) GROUP BY feature",
    "closed_window_cutoff": "SELECT event_id, CAST(o_orderdate AS DATE) AS anndats FROM bt, (SELECT max(CAST(o_orderdate AS DATE)) - 365 c FROM bt) WHERE CAST(o_orderdate AS DATE) <= c AND CAST(o_orderdate AS DATE) + 84 <= c",
}
QUERIES = {name: globals()[name] for name in [*SQL, "fama_macbeth", "fama_macbeth_all"]}
ORACLE_SQL = {name: CTE + sql for name, sql in SQL.items()}
