"""Writing streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery


def append_to_files(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Final rows (append mode) as Parquet, exactly once."""
    return (stream.writeStream.outputMode("append").format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def updates_to_files(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None,
                     summary: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Changed rows (update mode), or a summary of each batch, one folder per micro-batch.

    A batch that is run again after a failure overwrites its own folder.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        (summary(batch) if summary else batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return for_each_batch(stream, store, checkpoint, "update", trigger)


def deltas_to_files(stream: DataFrame, summary: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
                    trigger: dict | None = None) -> StreamingQuery:
    """``summary`` of each micro-batch alone, one folder per micro-batch: what the batch adds to the summary of all.

    For summaries whose counts and sums add up.  The stream has no state, and a batch that is run again after a
    failure overwrites its own folder.
    """
    return updates_to_files(stream, path, checkpoint, trigger, summary)


def for_each_batch(stream: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str,
                   mode: str = "append", trigger: dict | None = None) -> StreamingQuery:
    return (stream.writeStream.outputMode(mode).foreachBatch(action)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def latest_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last stored version of each key."""
    updates = spark.read.parquet(path)
    w = Window.partitionBy(*keys).orderBy(F.col("batch_id").desc())
    return updates.withColumn("_age", F.row_number().over(w)).where(F.col("_age") == 1).drop("_age", "batch_id")


def compact_updates(spark: SparkSession, path: str, keys: list[str], target: str) -> None:
    """The last version of each key to a new folder, as a batch before all others; later batches can be written beside it.

    Do this between two runs of the stream, and hand the new folder to the next one.
    """
    latest_updates(spark, path, keys).write.parquet(f"{target}/batch_id=-1")


def compact_deltas(spark: SparkSession, path: str, keys: list[str], target: str) -> None:
    """All stored deltas added up, in a new folder as a batch before all others; use as ``compact_updates``."""
    deltas = spark.read.parquet(path).drop("batch_id")
    sums = [F.sum(c).alias(c) for c in deltas.columns if c not in keys]
    deltas.groupBy(*keys).agg(*sums).write.parquet(f"{target}/batch_id=-1")
