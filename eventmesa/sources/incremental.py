"""Keyed incremental loads: what to pull, and merging it into what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def missing_keys(requested: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Requested keys that the cache lacks, each once; an empty request needs nothing."""
    return requested.select(key).where(F.col(key).isNotNull()).distinct().join(cached.select(key), key, "left_anti")


def pulled(requested: DataFrame, cached: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """The cache with the missing keys' rows from the source, of requested keys only; ragged columns become null."""
    fresh = source.join(missing_keys(requested, cached, key), key, "left_semi")
    return cached.unionByName(fresh, allowMissingColumns=True).join(requested.select(key).distinct(), key, "left_semi")


def stale(cached: DataFrame, key: str, time: str, target, days: int = 5) -> DataFrame:
    """Keys whose newest row is more than `days` before the target, and the day from which to pull."""
    newest = cached.groupBy(key).agg(F.max(time).alias("newest"))
    return newest.where(F.col("newest") < F.date_sub(target, days)).select(key, F.date_add("newest", 1).alias("pull_from"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str], sequence: str | None = None) -> DataFrame:
    """Both, of each key the row loaded last; within a load that with the highest `sequence`, then the greatest row, so
    reruns agree."""
    row = lambda df, load: df.select("*", F.lit(load).alias("__load"))
    both = row(old, 0).unionByName(row(new, 1), allowMissingColumns=True)
    values = [c for c in both.columns if c != "__load"]
    w = Window.partitionBy(*keys).orderBy(F.col("__load").desc(), *([F.col(sequence).desc()] if sequence else []), *(F.col(c).desc() for c in values))
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__load")
