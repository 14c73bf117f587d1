"""What drives the drift: exact Shapley values and permutation importance of every fold's model, refits of subgroups, and
the map that joins them with rank stability and Fama-MacBeth slopes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import core as O
from ..sources.staging import kept, written
from . import features as X
from . import grouped as G
from . import models as M
from . import validation as V
from .trees import ensemble_of

#: Features that count as leading in a fold or subgroup; fewest rows and quarters of a subgroup; repeats of a permutation.
TOP, LISTED, LEAST_GROUP, REPEATS = 10, 15, 200, 5


def _places(spark: SparkSession, columns: list[str]) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(enumerate(columns)), "place int, feature string"))  # one row a feature


def shapley_importance(model, rows: DataFrame, columns: list[str]) -> DataFrame:
    """feature, importance (mean of absolute values), direction (mean signed value), n: over all rows, whose `features` is the
    vector of `columns`. No rows give no features."""
    return shapley_by({0: model}, rows.withColumn("fold", F.lit(0)), columns).drop("fold")


def shapley_by(models: dict, rows: DataFrame, columns: list[str]) -> DataFrame:
    """The same by fold, each with its own model: rows are gone through once for all folds."""
    spark, k = rows.sparkSession, len(columns)
    sent = spark.sparkContext.broadcast({fold: ensemble_of(spark, model) for fold, model in models.items()})

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, list] = {}
        for batch in batches:
            for fold, own in batch.groupby("fold"):
                for i in range(0, len(own), 4096):
                    values = sent.value[fold].shapley(np.stack(own["x"].iloc[i : i + 4096].to_numpy()))
                    size, signed, n = found.get(fold, (np.zeros(k), np.zeros(k), 0))
                    found[fold] = size + np.abs(values).sum(axis=0), signed + values.sum(axis=0), n + len(values)
        for fold, (size, signed, n) in found.items():
            yield pd.DataFrame({"fold": fold, "place": np.arange(k), "size": size, "signed": signed, "n": n})

    sums = rows.select("fold", vector_to_array("features").alias("x")).mapInPandas(each, "fold int, place int, size double, signed double, n long").groupBy("fold", "place").agg(F.sum("size").alias("size"), F.sum("signed").alias("signed"), F.sum("n").alias("n"))
    return sums.join(_places(spark, columns), "place").select("fold", "feature", (F.col("size") / F.col("n")).alias("importance"), (F.col("signed") / F.col("n")).alias("direction"), "n")


def permuted_pairs(rows: DataFrame, repeats: int = REPEATS, by: tuple[str, ...] = ()) -> DataFrame:
    """`by`, turn, event_id, donor: in each turn, every row gets the values of one row of its group, each row's once. Places in two
    hashed orders are joined, so no row meets all others."""
    ids = rows.select(*by, "event_id")
    ranked = lambda df, groups: O.rank_within(df, groups, "h", ["event_id"], "place") if groups else O.global_rank(df, "h", ["event_id"], "place")
    own = ranked(ids.withColumn("h", F.xxhash64("event_id")), list(by)).select(*by, "event_id", "place")
    turns = ids.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("h", F.xxhash64("event_id", "turn"))
    dealt = ranked(turns, [*by, "turn"]).select(*by, "turn", "place", F.col("event_id").alias("donor"))
    return own.join(dealt, [*by, "place"]).select(*by, "turn", "event_id", "donor")


def permutation_importance(model, rows: DataFrame, columns: list[str], label: str, repeats: int = REPEATS) -> DataFrame:
    """feature, perm: by how much the mean squared error grows when a feature's values are dealt anew among the rows, over
    `repeats` deals. All features and repeats are scored in one pass; rows without a label don't count."""
    return permutation_by({0: model}, rows.withColumn("fold", F.lit(0)), columns, label, repeats).drop("fold")


def permutation_by(models: dict, rows: DataFrame, columns: list[str], label: str, repeats: int = REPEATS) -> DataFrame:
    """The same by fold, each with its own model, values being dealt inside a fold: one pass for all folds."""
    spark, k = rows.sparkSession, len(columns)
    sent = spark.sparkContext.broadcast({fold: ensemble_of(spark, model) for fold, model in models.items()})
    known = rows.where(F.col(label).isNotNull()).select("fold", "event_id", F.col(label).cast("double").alias("y"), vector_to_array("features").alias("x"))
    pairs = permuted_pairs(known, repeats, ("fold",))
    both = pairs.join(known, ["fold", "event_id"]).join(known.select("fold", F.col("event_id").alias("donor"), F.col("x").alias("other")), ["fold", "donor"])

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, list] = {}
        for batch in batches:
            for fold, own in batch.groupby("fold"):
                loss, n = found.get(fold, (np.zeros(k), 0))
                for i in range(0, len(own), 4096):
                    some = own.iloc[i : i + 4096]
                    x, other, y = np.stack(some["x"].to_numpy()), np.stack(some["other"].to_numpy()), some["y"].to_numpy()
                    base = (sent.value[fold].predict(x) - y) ** 2
                    for j, changed in sent.value[fold].changed(x, other):
                        loss[j] += ((changed - y) ** 2 - base).sum()
                    n += len(x)
                found[fold] = loss, n
        for fold, (loss, n) in found.items():
            yield pd.DataFrame({"fold": fold, "place": np.arange(k), "loss": loss, "n": n})

    sums = both.select("fold", "x", "other", "y").mapInPandas(each, "fold int, place int, loss double, n long").groupBy("fold", "place").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n"))
    return sums.join(_places(spark, columns), "place").select("fold", "feature", (F.col("loss") / F.col("n")).alias("perm"))


def of_folds(folds: list[M.Fold]) -> DataFrame:
    """fold, feature, importance, direction, perm of each fold's model of the standardised drift, over all events that it tests
    and whose drift is known; a written table. Folds with one schema are gone through together."""
    spark, parts = folds[0].table.sparkSession, []
    for some in M.alike(folds):
        schema, models = some[0].heads[0], {fold.k: fold.heads[2] for fold in some}
        named = spark.createDataFrame([(q, fold.k) for fold in some for q in fold.quarters], f"cal_q string, {M.LABELS}fold int")  # one row a fold
        tested = some[0].table.where(F.col(M.Z).isNotNull()).join(F.broadcast(named), "cal_q")
        rows = written(M.vectors(M.aligned(tested, schema), schema).select(F.col(f"{M.LABELS}fold").alias("fold"), "event_id", M.Z, "features"), "tested")
        parts.append(shapley_by(models, rows, schema.columns).join(permutation_by(models, rows, schema.columns, M.Z), ["fold", "feature"]).select("fold", "feature", "importance", "direction", "perm"))
    return written(reduce(DataFrame.unionByName, parts), "fold-attribution")


def fold_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "fold_attribution", lambda spark, sf_dir: of_folds(M.fold_fits(spark, sf_dir)))


def pooled(folds: DataFrame) -> DataFrame:
    """Per feature over folds: importance and its deviation, direction, n_folds, mean rank, its deviation, the share of all
    folds in which it is among the TOP, and the permutation importance with its deviation (null where no fold has one)."""
    ranked = folds.withColumn("r", F.when(F.col("importance").isNotNull(), F.rank().over(Window.partitionBy("fold").orderBy(F.col("importance").desc_nulls_last()))))
    every = folds.agg(F.count_distinct("fold").alias("folds"))  # one row
    return ranked.join(F.broadcast(every)).groupBy("feature").agg(
        F.avg("importance").alias("importance"), F.stddev_samp("importance").alias("importance_std"), F.avg("direction").alias("direction"), F.count("importance").alias("n_folds"),
        F.avg("r").alias("mean_rank"), F.stddev_pop("r").alias("rank_std"), (F.coalesce(F.sum((F.col("r") <= TOP).cast("int")), F.lit(0)) / F.first("folds")).alias("hit_rate"),
        F.avg("perm").alias("perm_importance"), F.stddev_samp("perm").alias("perm_std"),
    )


def driver_table(folds: DataFrame, slopes: DataFrame) -> DataFrame:
    """The map of drivers. folds: fold, feature, importance, direction, perm; slopes: feature, coef, t, frac_positive. A sign
    agrees or not only where both a direction and a slope are there. The score weighs how often a feature leads, how little
    its rank moves, and how sure its slope is; what is missing adds nothing."""
    rows = pooled(folds).join(slopes.select("feature", "coef", "t", "frac_positive"), "feature", "left")
    most = F.max("rank_std").over(Window.partitionBy())  # one row a feature
    steady = F.when(most > 0, 1 - F.col("rank_std") / most).otherwise(F.when(F.col("rank_std").isNotNull(), 1.0))
    score = 0.5 * F.coalesce("hit_rate", F.lit(0.0)) + 0.3 * F.coalesce(steady, F.lit(0.0)) + 0.2 * F.coalesce(F.when(F.col("t").isNotNull(), F.least(F.abs("t") / 2, F.lit(1.0))), F.lit(0.0))
    agrees = F.when(F.col("direction").isNotNull() & F.col("coef").isNotNull(), F.signum("direction") == F.signum("coef"))
    return rows.withColumn("sign_agreement", agrees).withColumn("score", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def subgroups(rows: DataFrame) -> DataFrame:
    """The rows once for each grouping that they belong to: grouping, subgroup (sector, size tercile, sign of the surprise)."""
    cuts = O.quantiles_within(rows.where(F.col("mktcap").isNotNull()).select("mktcap", F.lit(0).alias("all")), ["all"], "mktcap", [1 / 3, 2 / 3], ["low", "high"]).drop("all")
    size = F.when(F.col("mktcap") <= F.col("low"), "small").when(F.col("mktcap") <= F.col("high"), "mid").when(F.col("mktcap").isNotNull(), "large")
    sign = F.when(F.col("surprise_raw") > 0, "positive").when(F.col("surprise_raw") < 0, "negative").when(F.col("surprise_raw") == 0, "zero").otherwise("unknown")
    of = F.array(*(F.struct(F.lit(g).alias("grouping"), s.alias("subgroup")) for g, s in (("gics_sector", F.col("gics_sector").cast("string")), ("size_tercile", size), ("surprise_sign", sign))))
    return rows.join(F.broadcast(cuts), how="left").withColumn("__of", F.explode(of)).select("*", "__of.*").drop("__of", "low", "high").where("subgroup is not null")  # cuts: one row


def subgroup_drivers(table: DataFrame, label: str = M.Z) -> DataFrame:
    """grouping, subgroup, feature, importance, rank: the LISTED leading features of the walk-forward models of each subgroup
    with LEAST_GROUP labelled rows and V.LEAST_QUARTERS quarters or more. All models are fitted together, over the categories'
    levels of all rows; a level that a model's training rows lack goes right at its splits."""
    spark = table.sparkSession
    rows = written(subgroups(table.where(F.col(label).isNotNull())), "subgroups")
    counts = rows.groupBy("grouping", "subgroup", "cal_q").count().orderBy("grouping", "subgroup", "cal_q").collect()  # sectors, sizes, signs by quarters
    by: dict[tuple[str, str], dict[str, int]] = {}
    for r in counts:
        by.setdefault((r.grouping, r.subgroup), {})[r.cal_q] = r["count"]
    models, trains, tests = [], {}, {}
    for name, quarters in by.items():
        if sum(quarters.values()) >= LEAST_GROUP and len(quarters) >= V.LEAST_QUARTERS:
            for _, train_q, test_q in M.folds(list(quarters)):
                if sum(quarters[q] for q in train_q) >= M.LEAST_ROWS:
                    for q in train_q:
                        trains.setdefault((*name, q), []).append(len(models))
                    tests[*name, test_q[0]] = len(models)
                    models.append(name)
    if not models:
        return spark.createDataFrame([], "grouping string, subgroup string, feature string, importance double, rank int")
    roles = spark.createDataFrame([(*k, trains.get(k, []), tests.get(k)) for k in sorted(trains.keys() | tests.keys())], "grouping string, subgroup string, cal_q string, trains array<int>, tests int")
    schema = M.schema_of(rows.drop("grouping", "subgroup"))
    data = M.vectors(M.aligned(rows.join(F.broadcast(roles), ["grouping", "subgroup", "cal_q"]).withColumns({f"{M.LABELS}trains": F.col("trains"), f"{M.LABELS}tests": F.col("tests")}), schema), schema)  # roles: one row a subgroup and quarter
    levels = {len(schema.numbers) + i: 1 + len(known) for i, known in enumerate(schema.levels.values())}
    ready = G.binned(data.select(F.xxhash64("event_id").alias("key"), F.col(label).alias("y"), "features", F.col(f"{M.LABELS}trains").alias("trains"), F.col(f"{M.LABELS}tests").alias("tests")), levels)
    named = F.broadcast(spark.createDataFrame([(i, *name) for i, name in enumerate(models)], "model int, grouping string, subgroup string"))  # one row a model
    found = G.importance(ready, G.fit(ready, len(models), M.ROUNDS)).join(named, "model").join(_places(spark, schema.columns), "place")
    means = found.groupBy("grouping", "subgroup", "feature").agg(F.avg("importance").alias("importance"))
    w = Window.partitionBy("grouping", "subgroup").orderBy(F.col("importance").desc(), "feature")
    return written(means.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= LISTED), "subgroup-drivers")


# Registered queries.


def shapley_drivers(spark, sf_dir):
    """Importance and signed direction of every feature in every fold, with its permutation importance."""
    return fold_attribution(spark, sf_dir).select("fold", "feature", *(F.round(c, 8).alias(c) for c in ("importance", "direction", "perm")))


def driver_map(spark, sf_dir):
    """Every feature with its strength, direction, stability, slope and consistency score."""
    rows = driver_table(fold_attribution(spark, sf_dir), V.slopes_of_all(spark, sf_dir))
    return rows.select("feature", "n_folds", "sign_agreement", *(F.round(c, 6).alias(c) for c in ("importance", "importance_std", "direction", "mean_rank", "rank_std", "hit_rate", "perm_importance", "perm_std", "coef", "t", "frac_positive", "score")))


def model_drivers(spark, sf_dir):
    """The leading features of the subgroups' models."""
    return subgroup_drivers(X.event_features(spark, sf_dir)).select("grouping", "subgroup", "rank", "feature", F.round("importance", 8).alias("importance"))


QUERIES = {f.__name__: f for f in (shapley_drivers, driver_map, model_drivers)}
ORACLE_SQL: dict[str, str] = {}
