"""Keyed tables that grow: pulls of what is missing, top-ups of what is old, and upserts that rewrite touched partitions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import incremental as I
from .staging import written

#: The column by which a keyed table's folder is partitioned.
PART = "__part"


@dataclass(frozen=True)
class KeyedTable:
    """A Parquet folder with one row for each value of `keys`, partitioned by an expression over its keys (a month, a hash
    bucket), so a row never changes its partition.

    A write replaces whole partitions, each from all its old and new rows. Written again with the same rows it gives the
    same table, so a load that stopped half way is mended by running it again, and a batch that comes twice does no harm.
    One writer at a time."""

    path: str
    keys: tuple[str, ...]
    part: Column
    sequence: str | None = None
    ragged: bool = False  # whether loads may bring columns that earlier ones lack

    def exists(self, spark: SparkSession) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return files.exists(path) and any(x.isDirectory() for x in files.listStatus(path))

    def _all(self, spark: SparkSession) -> DataFrame:
        return spark.read.option("mergeSchema", self.ragged).parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._all(spark).drop(PART)

    def upsert(self, fresh: DataFrame) -> None:
        """Adds rows, replacing those of the same keys. Of several fresh rows of a key the one with the highest `sequence`
        counts, then the greatest; so old rows of a higher `sequence` stay."""
        spark = fresh.sparkSession
        fresh = written(fresh.withColumn(PART, self.part.cast("string")), "fresh")
        if fresh.isEmpty():
            return
        old = fresh.limit(0)
        if self.exists(spark):
            touched = [r[0] for r in fresh.select(PART).distinct().collect()]  # as many as the folder has partitions
            old = self._all(spark).withColumn(PART, F.col(PART).cast("string")).where(F.col(PART).isin(touched))
        if self.sequence:
            rows = I.upserted(old.limit(0), old.unionByName(fresh, allowMissingColumns=True), [PART, *self.keys], self.sequence)
        else:
            rows = I.upserted(old, fresh, [PART, *self.keys])
        merged = written(rows, "merged")  # what is read is replaced below
        merged.hint("rebalance", PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(self.path)

    def ensure(self, requested: DataFrame, source: Callable[[DataFrame], DataFrame], key: str, *, refresh: bool = False) -> DataFrame:
        """The rows of the requested keys. Those of keys that the table lacks (all, with `refresh`) are pulled first: `source`
        takes the keys to pull (column `key`) and gives their rows. Where nothing is missing, the source isn't asked; an empty
        request touches nothing."""
        spark = requested.sparkSession
        asked = requested.select(key).where(F.col(key).isNotNull()).distinct()
        there = self.exists(spark)
        wanted = asked if refresh or not there else written(I.missing_keys(asked, self.read(spark), key), "missing")
        if not wanted.isEmpty():
            self.upsert(source(wanted))
            there = self.exists(spark)
        if not there:
            return source(asked.limit(0))
        return self.read(spark).join(asked, key, "left_semi")

    def top_up(self, source: Callable[[DataFrame], DataFrame], key: str, time: str, target, days: int = 5) -> DataFrame:
        """Keys whose newest row is more than `days` before the target are pulled on from the day after it. `source` takes
        (key, pull_from) and gives rows, of which only those from that day on count. The keys that were pulled are returned."""
        spark = SparkSession.getActiveSession()
        old = written(I.stale(self.read(spark), key, time, target, days), "stale")
        if not old.isEmpty():
            rows = source(old)
            on = old.withColumnRenamed(key, "__key")
            self.upsert(rows.join(on, F.col(key) == F.col("__key")).where(F.col(time) >= F.col("pull_from")).drop("__key", "pull_from"))
        return old
