"""Streams of announcements: snapshots from arriving files, kept once each, merged into a keyed table, and scored by a
stored version of the models. Each batch may come again after a stop; tables and scores are then as if it had come once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.tables import KeyedTable


def arriving(spark: SparkSession, path: str, schema: StructType | str, *, files_at_once: int = 100) -> DataFrame:
    """The rows of the Parquet files that arrive in a folder, oldest files first, a bounded number of them at once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def once(stream: DataFrame, keys: list[str], time: str, *, late: str = "2 days") -> DataFrame:
    """Of rows with the same keys the first, as long as copies come no later than `late` after it; the state that tells them
    is dropped behind the watermark. Rows that are later than that themselves are left out."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def merged(stream: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Runs until all files that are there are in the table."""

    def put(batch: DataFrame, number: int) -> None:
        table.upsert(batch)

    return _started(stream.writeStream.foreachBatch(put), checkpoint)


def scored(stream: DataFrame, score, path: str, checkpoint: str) -> StreamingQuery:
    """`score` takes a batch's rows and gives a result; each batch's stands in a partition of its own, which a batch that
    comes again replaces. A batch is written first and read by the session that started the stream, which plans the scoring
    like any other query."""
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        rows = spark.read.schema(batch.schema).parquet(_written(batch, f"{path}-batches/{number}"))
        out = score(rows).withColumn("batch", F.lit(number))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return _started(stream.writeStream.foreachBatch(put), checkpoint)


def _written(batch: DataFrame, path: str) -> str:
    batch.write.mode("overwrite").parquet(path)
    return path


def _started(writer, checkpoint: str) -> StreamingQuery:
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
