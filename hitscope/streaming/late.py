"""Late records kept aside.

A timeline whose buckets become final as event time goes on, without losing
what comes after that.  The watermark before a micro-batch is the greatest time
of all batches before it, less a delay.  A record whose bucket that watermark
has passed is late: it is stored in a side table as it is, for inspection and
for a later correction.  All others add to the buckets.  Nothing is kept in
state; a batch that runs again finds the same watermark and overwrites its own
folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from . import sinks
from .windows import timeline_of, timeline_parts

_PROGRESS = "batch_id int, latest timestamp"


def _bucket_end(granularity: str) -> Column:
    return F.window("ts", granularity)["end"]


def timeline_with_late(stream: DataFrame, path: str, checkpoint: str, granularity: str = "1 minute", delay: str = "1 minute",
                       trigger: dict | None = None) -> StreamingQuery:
    """Stores ``parts`` (of ``timeline_parts``), ``late`` (records), and ``progress`` below ``path``, one folder per micro-batch each."""
    spark = stream.sparkSession

    def store(batch: DataFrame, batch_id: int) -> None:
        timed = batch.withColumn("ts", F.col("ts").cast("timestamp"))
        # the first batch's folder is not there yet
        latest = None if batch_id == 0 else watermark(spark, path, delay, batch_id)
        late = F.lit(False) if latest is None else F.coalesce(_bucket_end(granularity) <= F.lit(latest), F.lit(False))
        timed.where(late).write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")
        timeline_parts(timed.where(~late), granularity).write.mode("overwrite").parquet(f"{path}/parts/batch_id={batch_id}")
        timed.agg(F.max("ts").alias("latest")).write.mode("overwrite").parquet(f"{path}/progress/batch_id={batch_id}")

    return sinks.for_each_batch(stream, store, checkpoint, "append", trigger)


def watermark(spark: SparkSession, path: str, delay: str = "1 minute", batch_id: int | None = None):
    """The watermark before ``batch_id``, or the present one; None if no record has a time.  Reads one row a batch."""
    seen = spark.read.schema(_PROGRESS).parquet(f"{path}/progress")
    seen = seen if batch_id is None else seen.where(F.col("batch_id") < batch_id)
    return seen.agg((F.max("latest") - F.expr(f"INTERVAL {delay}")).alias("mark")).first().mark


def _parts(spark: SparkSession, path: str) -> DataFrame:
    """Parts of all batches added up."""
    parts = spark.read.parquet(f"{path}/parts")
    return parts.groupBy("bucket", "ip").agg(*[F.sum(c).alias(c) for c in ("n", "bytes", "seconds", "errors")])


def final_timeline(spark: SparkSession, path: str, granularity: str = "1 minute", delay: str = "1 minute") -> DataFrame:
    """The buckets that the watermark has passed, of records in time; these rows don't change any more."""
    mark = watermark(spark, path, delay)
    closed = F.lit(False) if mark is None else F.col("bucket") + F.expr(f"INTERVAL {granularity}") <= F.lit(mark)
    return timeline_of(_parts(spark, path).where(closed))


def late_records(spark: SparkSession, path: str) -> DataFrame:
    """All late records, with the micro-batch they came in."""
    return spark.read.parquet(f"{path}/late")


def corrected_timeline(spark: SparkSession, path: str, granularity: str = "1 minute") -> DataFrame:
    """All buckets so far, late records put in: what a batch over all records gives."""
    late = timeline_parts(late_records(spark, path), granularity)
    both = _parts(spark, path).unionByName(late)
    return timeline_of(both.groupBy("bucket", "ip").agg(*[F.sum(c).alias(c) for c in ("n", "bytes", "seconds", "errors")]))
