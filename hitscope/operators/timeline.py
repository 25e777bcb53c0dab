"""Time series of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.status import is_error
from ..functions.text import count_where
from ..functions.times import bucket


def timeline(df: DataFrame, granularity: str = "1 minute") -> DataFrame:
    """Per bucket: requests, bytes, distinct addresses, errors, mean response time.

    Empty buckets do not appear.  Addresses are combined per (bucket, address)
    before they are counted.
    """
    per_ip = df.groupBy(bucket(F.col("ts"), granularity).alias("bucket"), "ip").agg(
        F.count("*").alias("n"), F.sum("bytes_sent").alias("bytes"), F.sum("response_time").alias("seconds"),
        count_where(is_error(F.col("status"))).alias("errors"))
    return per_ip.groupBy("bucket").agg(
        F.sum("n").alias("count"), F.sum("bytes").alias("bytes"), F.count("*").alias("unique_ips"),
        F.sum("errors").alias("error_count"), (F.sum("seconds") / F.sum("n")).alias("avg_response_time"))


def timeline_status_counts(df: DataFrame, granularity: str = "1 minute") -> DataFrame:
    return df.groupBy(bucket(F.col("ts"), granularity).alias("bucket"), "status").agg(F.count("*").alias("count"))


def timeline_with_status(df: DataFrame, granularity: str = "1 minute") -> DataFrame:
    """``timeline`` plus ``status_counts MAP<INT,BIGINT>`` (at most one entry per status)."""
    maps = timeline_status_counts(df, granularity).groupBy("bucket").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "count")))).alias("status_counts"))
    return timeline(df, granularity).join(maps, "bucket", "left")


def peak_bucket(df: DataFrame, granularity: str = "1 minute") -> DataFrame:
    """The first bucket with the most requests."""
    return timeline(df, granularity).orderBy(F.col("count").desc(), F.col("bucket").asc()).limit(1)


def security_timeline(events: DataFrame, granularity: str = "1 minute") -> DataFrame:
    """Threat events per bucket, address, type and severity."""
    return events.groupBy(
        bucket(F.col("ts"), granularity).alias("bucket"), "ip", "threat_type", "severity",
    ).agg(F.count("*").alias("count"))


def hour_profile(df: DataFrame) -> DataFrame:
    """Requests per hour of the day with ranks from the busiest and the quietest side."""
    hourly = df.groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("count"))
    # At most 24 rows reach these windows.
    busy = Window.orderBy(F.col("count").desc(), F.col("hour").asc())
    quiet = Window.orderBy(F.col("count").asc(), F.col("hour").asc())
    return hourly.select("hour", "count", F.row_number().over(busy).alias("peak_rank"),
                         F.row_number().over(quiet).alias("low_rank"))


def traffic_patterns(df: DataFrame, peaks: int = 3) -> DataFrame:
    """One row: busiest and quietest hours, weekend / weekday ratio of daily means,
    mean and peak requests per second."""
    hours = hour_profile(df)
    hour_lists = hours.agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("peak_rank") <= peaks, F.struct("peak_rank", "hour")))),
                                 lambda s: s["hour"].cast("string")), ",").alias("peak_hours"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("low_rank") <= peaks, F.struct("low_rank", "hour")))),
                                 lambda s: s["hour"].cast("string")), ",").alias("low_hours"))
    second = df.groupBy(F.date_trunc("second", "ts").alias("s")).agg(F.count("*").alias("n"))
    daily = second.groupBy(F.to_date("s").alias("day")).agg(
        F.sum("n").alias("n"), F.max("n").alias("peak"), F.min("s").alias("a"), F.max("s").alias("b"))
    weekend = F.dayofweek("day").isin(1, 7)
    span = F.unix_timestamp(F.max("b").cast("timestamp")) - F.unix_timestamp(F.min("a").cast("timestamp"))
    rates = daily.agg(
        (F.avg(F.when(weekend, F.col("n"))) / F.avg(F.when(~weekend, F.col("n")))).alias("weekend_weekday_ratio"),
        (F.sum("n") / (span + 1)).alias("avg_rps"), F.max("peak").alias("peak_rps"))
    both = hour_lists.select(F.struct("*")).scalar()
    return rates.withColumn("_h", both).select(
        F.col("_h.peak_hours").alias("peak_hours"), F.col("_h.low_hours").alias("low_hours"),
        "weekend_weekday_ratio", "avg_rps", "peak_rps")
