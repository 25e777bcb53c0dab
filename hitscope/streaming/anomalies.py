"""Anomalies of buckets on a stream, against a baseline that is given from outside."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.status import is_error
from ..functions.text import count_where
from ..operators.anomaly import judged
from .windows import _timed


def _against(buckets: DataFrame, base: DataFrame, threshold: float) -> DataFrame:
    measured = buckets.select(
        "bucket", F.col("n").cast("double").alias("requests"), (F.col("errors") / F.col("n")).alias("error_rate"),
        F.try_divide("seconds", "timed").alias("response_time"))
    one = base.limit(1).select(F.struct("*").alias("_base"))  # a baseline is one row
    return judged(measured.crossJoin(F.broadcast(one)), threshold)


def stream_anomalies(df: DataFrame, base: DataFrame, threshold: float = 3.0, granularity: str = "1 minute", delay: str = "1 minute") -> DataFrame:
    """The rows of ``anomaly.detect_anomalies`` for every bucket, once, when the watermark has passed it.

    ``base`` is one row, of ``anomaly.baseline`` or ``anomaly.merge_baselines``: a stored table that is joined to the
    stream.  The state is one row for each open bucket; later records are dropped.
    """
    buckets = _timed(df, delay).groupBy(F.window("ts", granularity)).agg(
        F.count("*").alias("n"), count_where(is_error(F.col("status"))).alias("errors"),
        F.sum("response_time").alias("seconds"), F.count("response_time").alias("timed"))
    return _against(buckets.withColumn("bucket", F.col("window.start")), base, threshold)


def bucket_parts(df: DataFrame, granularity: str = "1 minute") -> DataFrame:
    """Counts and sums by bucket, which add up over micro-batches; for ``sinks.deltas_to_files``, without state."""
    timed = df.withColumn("ts", F.col("ts").cast("timestamp")).where(F.col("ts").isNotNull())
    return timed.groupBy(F.window("ts", granularity)["start"].alias("bucket")).agg(
        F.count("*").alias("n"), count_where(is_error(F.col("status"))).alias("errors"),
        F.sum("response_time").alias("seconds"), F.count("response_time").alias("timed"))


def anomalies_of(parts: DataFrame, base: DataFrame, threshold: float = 3.0) -> DataFrame:
    """The anomalies of all buckets so far, from the stored parts; no record is too late."""
    sums = parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("n", "errors", "seconds", "timed")])
    return _against(sums, base, threshold)
