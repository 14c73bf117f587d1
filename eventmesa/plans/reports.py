"""Tables of a backtest: headline metrics, calibration, reliability, contrast of extreme deciles, each with a rule for few rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import core as O
from ..sources import adapters as A
from . import features as X
from . import models as M
from . import validation as V

#: Fewest rows of a metric, of a group of a contrast.
LEAST, LEAST_EACH = 3, 3


def headline(results: DataFrame, y: str = "drift_raw", p: str = "pred_q50", low: str = "pred_q10", high: str = "pred_q90", up: str = "prob_up", bins: int = 10) -> DataFrame:
    """One row: n_events (all rows), and over the rows whose values are finite spearman_ic, r2 (null under LEAST rows), the
    spread between the outer bins of the prediction (null under `bins` rows), the share inside the interval, and the AUC of
    `up` for a positive outcome (null unless both signs are there)."""
    rows = V.finite(results, y, p)
    ranked = O.average_ranks(O.average_ranks(rows.select(y, p), [], y, "ry"), [], p, "rp")
    enough, total = F.count("*") >= LEAST, F.var_pop(y) * F.count("*")
    fit = ranked.agg(F.when(enough, F.corr("ry", "rp")).alias("spearman_ic"), F.when(enough & (total > 0), 1 - F.sum((F.col(y) - F.col(p)) ** 2) / total).alias("r2"))
    placed = O.global_rank(rows.select(y, p), p, [y], "at").withColumn("bin", O.bin_of(F.col("at"), F.col("at_n"), bins))
    spread = placed.agg(F.when(F.count("*") >= bins, F.avg(F.when(F.col("bin") == bins, F.col(y))) - F.avg(F.when(F.col("bin") == 1, F.col(y)))).alias("decile_spread"))
    inside = V.finite(results, y, low, high).agg(F.avg(F.col(y).between(F.col(low), F.col(high)).cast("int")).alias("coverage"))
    auc = V.auc_of(V.finite(results, y, up).select((F.col(y) > 0).cast("int").alias("up"), F.col(up).alias("score")), "up", "score").select("roc_auc")
    out = results.agg(F.count("*").alias("n_events"))
    for one in (fit, spread, inside, auc):
        out = out.join(F.broadcast(one))  # one row each
    return out


def calibration(results: DataFrame, y: str = "drift_raw", p: str = "pred_q50", ties: str = "event_id", bins: int = 10) -> DataFrame:
    """bin, predicted, realised, n over the rows with both; none with fewer rows than bins."""
    rows = O.global_rank(V.finite(results, y, p), p, [ties], "at").where(F.col("at_n") >= bins)
    return rows.withColumn("bin", O.bin_of(F.col("at"), F.col("at_n"), bins)).groupBy("bin").agg(F.avg(p).alias("predicted"), F.avg(y).alias("realised"), F.count("*").alias("n"))


def reliability(results: DataFrame, y: str = "drift_raw", p: str = "prob_up", ties: str = "event_id", bins: int = 10) -> DataFrame:
    """bin, predicted, realised (the share of positive outcomes), n over the rows with both: as many bins as rows, at most
    `bins`; one row is one bin. A missing outcome is no negative one."""
    rows = O.global_rank(V.finite(results, y, p), p, [ties], "at")
    few = F.least(F.col("at_n"), F.lit(bins))
    bin_of = F.coalesce(F.greatest(((F.col("at") * few + F.col("at_n") - 2) / F.when(F.col("at_n") > 1, F.col("at_n") - 1)).cast("long"), F.lit(1)), F.lit(1))
    return rows.withColumn("bin", bin_of).groupBy("bin").agg(F.avg(p).alias("predicted"), F.avg((F.col(y) > 0).cast("int")).alias("realised"), F.count("*").alias("n"))


def contrast(rows: DataFrame, features: list[str], bin_col: str, bins: int = 10) -> DataFrame:
    """feature, top, bottom, diff, d (by the mean of both variances; null where that is 0): numeric features with LEAST_EACH
    values or more in either outer bin, all in one pass."""
    numbers = [c for c in features if rows.schema[c].dataType.typeName() not in ("string", "date", "timestamp", "boolean")]
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in numbers)))
    outer = V.finite(rows.where(F.col(bin_col).isin(1, bins)).select(F.col(bin_col).alias("bin"), cells.alias("cell")).select("bin", "cell.*"), "x")
    top, low = F.when(F.col("bin") == bins, F.col("x")), F.when(F.col("bin") == 1, F.col("x"))
    means = outer.groupBy("feature").agg(F.avg(top).alias("top"), F.avg(low).alias("bottom"), F.sqrt((F.var_samp(top) + F.var_samp(low)) / 2).alias("s"), F.count(top).alias("n_top"), F.count(low).alias("n_low"))
    kept = means.where((F.col("n_top") >= LEAST_EACH) & (F.col("n_low") >= LEAST_EACH))
    return kept.select("feature", "top", "bottom", (F.col("top") - F.col("bottom")).alias("diff"), F.when(F.col("s") > 0, (F.col("top") - F.col("bottom")) / F.col("s")).alias("d"))


def by_size(rows: DataFrame, value: str, name: str) -> DataFrame:
    """The rows of a short table (one a feature) with their place by the absolute value, the greatest first, nulls last."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.abs(value).desc_nulls_last(), name)))


def summary(rows: DataFrame, features: list[str]) -> DataFrame:
    """One row a feature: family, n_present and its share in per cent; of numbers mean, std, min, median, max; of texts the number
    of levels. All features are unpivoted once, numbers and texts."""
    every, texts = rows.agg(F.count("*").alias("every")), [c for c in features if rows.schema[c].dataType.typeName() == "string"]
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x") if c not in texts else F.lit(None).cast("double").alias("x"), F.col(c).alias("t") if c in texts else F.lit(None).cast("string").alias("t")) for c in features)))
    long = rows.select(cells.alias("cell")).select("cell.*").withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    sums = long.groupBy("feature").agg((F.count("x") + F.count("t")).alias("n_present"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), F.count_distinct("t").alias("levels"))
    middle = O.quantiles_within(long.select("feature", "x"), ["feature"], "x", [0.5], ["median"]).withColumnRenamed("feature", "__of")
    out = sums.join(F.broadcast(middle), F.col("feature") == F.col("__of"), "left").drop("__of").join(F.broadcast(every))  # one row a feature, one row
    family = F.lit("other")
    for name, members in FAMILIES.items():
        family = F.when(F.col("feature").isin(*members), name).otherwise(family)
    levels = F.when(F.col("feature").isin(*texts), F.col("levels")) if texts else F.lit(None).cast("long")
    return out.select("feature", family.alias("family"), "n_present", F.round(100 * F.col("n_present") / F.col("every"), 1).alias("pct"), "mean", "std", "min", "median", "max", levels.alias("levels"))


def rounded(rows: DataFrame, places: int, *names: str) -> DataFrame:
    return rows.withColumns({c: F.round(c, places) for c in names})


# Registered queries.


def model_headline(spark, sf_dir):
    """Headline metrics of the fitted backtest."""
    return rounded(headline(M.backtest(spark, sf_dir)), 6, "spearman_ic", "r2", "decile_spread", "coverage", "roc_auc")


def model_calibration(spark, sf_dir):
    return rounded(calibration(M.backtest(spark, sf_dir)), 8, "predicted", "realised")


def model_reliability(spark, sf_dir):
    return rounded(reliability(M.backtest(spark, sf_dir)), 8, "predicted", "realised")


def feature_contrast(spark, sf_dir):
    """Every numeric feature in the firms of the outer deciles of the drift."""
    table = X.event_features(spark, sf_dir)
    found = contrast(table, M.feature_columns(table), DECILE)
    return by_size(found.withColumns({c: F.round(F.col(c) + OFF_HALVES, 6) for c in ("top", "bottom", "diff", "d")}), "d", "feature")


def slope_order(spark, sf_dir):
    """The features by the size of their slope."""
    return by_size(V.fama_macbeth(spark, sf_dir), "coef", "feature").select("place", "feature", "coef")


def summary_of_features(spark, sf_dir):
    """What the feature table holds of every feature."""
    table = X.event_features(spark, sf_dir)
    found = summary(table, M.feature_columns(table))
    return found.withColumns({c: F.round(F.col(c) + OFF_HALVES, 6) for c in ("mean", "std", "median")})


def headline_by_order(spark, sf_dir):
    """The headline of predictions that SQL can make."""
    return rounded(headline(A.backtest(spark, sf_dir)), 6, "spearman_ic", "r2", "decile_spread", "coverage", "roc_auc")


#: The groups of features.
FAMILIES = {
    "surprise": ("sue_std", "sue_price", "surprise_raw", "beat_flag", "ear"), "price and risk": ("mom_1m", "reversal_1w", "mom_12_1", "rvol_60", "beta_252", "ivol", "high52_prox", "pre_run", "price_level"),
    "liquidity": ("mktcap", "dollar_vol", "turnover", "amihud"), "industry": ("gics_sector", "ff12", "ff48", "idx_member", "industry_mom", "industry_drift_base"),
    "fundamentals": (*X.RATIOS, "book_to_market"), "analysts": ("analyst_disp", "n_analysts", "revision_net", "staleness"), "calendar": ("fiscal_q", "report_time", "mkt_ret_pre", "vix_level"),
}
#: Added before rounding, so that means of short decimals don't stand on a half.
OFF_HALVES = 1.3e-9
#: The label's decile column.
DECILE = f"drift_decile_h{M.HORIZON}"
NUMERIC = [c for c in M.COVERED if c not in ("gics_sector", "ff12", "ff48", "report_time")]
_TIES = "row_number() OVER (ORDER BY pred_q50, drift_raw) - 1"
_TEXTS = ("gics_sector", "ff12", "ff48", "report_time")
_FAMILY = "CASE " + " ".join(f"WHEN feature IN ({', '.join(repr(m) for m in members)}) THEN '{name}'" for name, members in FAMILIES.items()) + " ELSE 'other' END"
ORACLE_SQL = {
    "slope_order": f"{X.FEATURES}, {V.fama_sql().replace('SELECT feature, round(mean', ', fm AS (SELECT feature, round(mean', 1)}) SELECT row_number() OVER (ORDER BY abs(coef) DESC, feature) AS place, feature, coef FROM fm",
    "summary_of_features": f"""{X.FEATURES}, long AS ({' UNION ALL '.join([f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, NULL::VARCHAR AS t FROM ef" for c in NUMERIC] + [f"SELECT '{c}', NULL, {c} FROM ef" for c in _TEXTS])})
        SELECT feature, {_FAMILY} AS family, count(x) + count(t) AS n_present, round(100 * (count(x) + count(t)) / count(*), 1) AS pct, round(avg(x) + {OFF_HALVES}, 6) AS mean, round(stddev_samp(x) + {OFF_HALVES}, 6) AS std, min(x) AS min, round(median(x) + {OFF_HALVES}, 6) AS median, max(x) AS max,
        CASE WHEN feature IN {_TEXTS} THEN count(DISTINCT t) END AS levels FROM long GROUP BY feature""",
    "feature_contrast": f"""{X.FEATURES}, cells AS ({' UNION ALL '.join(f"SELECT {DECILE} AS bin, '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM ef WHERE {DECILE} IN (1, 10) AND {c} IS NOT NULL" for c in NUMERIC)}),
        m AS (SELECT feature, avg(x) FILTER (bin = 10) top, avg(x) FILTER (bin = 1) bottom, sqrt((var_samp(x) FILTER (bin = 10) + var_samp(x) FILTER (bin = 1)) / 2) s FROM cells GROUP BY feature HAVING count(*) FILTER (bin = 10) >= {LEAST_EACH} AND count(*) FILTER (bin = 1) >= {LEAST_EACH})
        SELECT feature, round(top + {OFF_HALVES}, 6) AS top, round(bottom + {OFF_HALVES}, 6) AS bottom, round(top - bottom + {OFF_HALVES}, 6) AS diff, round(CASE WHEN s > 0 THEN (top - bottom) / s END + {OFF_HALVES}, 6) AS d, row_number() OVER (ORDER BY abs(d) DESC NULLS LAST, feature) AS place FROM m""",
    "headline_by_order": f"""{V.CTE} SELECT count(*) AS n_events, (SELECT round(corr(ry, rp), 6) FROM (SELECT rank() OVER (ORDER BY drift_raw) + (count(*) OVER (PARTITION BY drift_raw) - 1) / 2 ry, rank() OVER (ORDER BY pred_q50) + (count(*) OVER (PARTITION BY pred_q50) - 1) / 2 rp FROM bt)) AS spearman_ic,
        round(1 - sum((drift_raw - pred_q50) ** 2) / (var_pop(drift_raw) * count(*)), 6) AS r2, round(avg(drift_raw) FILTER (bin = 10) - avg(drift_raw) FILTER (bin = 1), 6) AS decile_spread, round(avg((drift_raw BETWEEN pred_q10 AND pred_q90)::INT), 6) AS coverage,
        (SELECT round(sum(pos * (nb + (n - pos) / 2)) / (sum(pos) * sum(n - pos)), 6) FROM (SELECT pos, n, sum(n - pos) OVER w - (n - pos) nb FROM (SELECT prob_up, sum((drift_raw > 0)::INT) pos, count(*) n FROM bt GROUP BY 1) WINDOW w AS (ORDER BY prob_up))) AS roc_auc
        FROM (SELECT *, CASE WHEN n > 1 THEN greatest((r * 10 + n - 2) // (n - 1), 1) END bin FROM (SELECT *, {_TIES} r, count(*) OVER () n FROM bt))""",
}
QUERIES = {f.__name__: f for f in (model_headline, model_calibration, model_reliability, feature_contrast, headline_by_order, slope_order, summary_of_features)}
