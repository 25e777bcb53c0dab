"""Z-score anomalies of requests, error rate and response time per bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed_values import ANOMALY_TEXT
from ..functions.status import is_error
from ..functions.text import count_where
from ..functions.times import bucket


def bucket_metrics(df: DataFrame, granularity: str = "1 minute") -> DataFrame:
    return df.groupBy(bucket(F.col("ts"), granularity).alias("bucket")).agg(
        F.count("*").cast("double").alias("requests"),
        (count_where(is_error(F.col("status"))) / F.count("*")).alias("error_rate"),
        F.avg("response_time").alias("response_time"))


def baseline(history: DataFrame, granularity: str = "1 minute") -> DataFrame:
    """One row: mean and population deviation of each metric over the buckets that occur.

    An ordinary DataFrame: it can be written and used again later.
    """
    metrics = bucket_metrics(history, granularity)
    return metrics.agg(*[c for m in ("requests", "error_rate", "response_time") for c in (
        F.avg(m).alias(f"avg_{m}"), F.stddev_pop(m).alias(f"stddev_{m}"))])


METRICS = ("requests", "error_rate", "response_time")


def baseline_state(history: DataFrame, granularity: str = "1 minute") -> DataFrame:
    """One row of mergeable moments: for each metric the number of buckets, their mean, and the sum of squared deviations.

    Store it by day (no bucket may lie in two days), and ``merge_baselines`` gives the baseline of any days without their log.
    """
    metrics = bucket_metrics(history, granularity)
    return metrics.agg(*[c for m in METRICS for c in (
        F.count(m).alias(f"n_{m}"), F.avg(m).alias(f"avg_{m}"), (F.var_pop(m) * F.count(m)).alias(f"squares_{m}"))])


def merge_baselines(states: DataFrame) -> DataFrame:
    """The baseline of all buckets that the rows of ``states`` stand for: means weighted by their buckets, and squared
    deviations inside the parts and of their means."""
    means = states.agg(*[F.try_divide(F.sum(F.col(f"n_{m}") * F.col(f"avg_{m}")), F.sum(f"n_{m}")).alias(m) for m in METRICS])
    placed = states.withColumn("_mean", means.select(F.struct("*")).scalar())
    return placed.agg(*[c for m in METRICS for c in (
        F.any_value(F.col(f"_mean.{m}")).alias(f"avg_{m}"),
        F.sqrt(F.try_divide(F.sum(F.col(f"squares_{m}") + F.col(f"n_{m}") * F.pow(F.col(f"avg_{m}") - F.col(f"_mean.{m}"), 2)), F.sum(f"n_{m}"))).alias(f"stddev_{m}"))])


def severity(z: Column) -> Column:
    size = F.abs(z)
    return F.when(size >= 5, "critical").when(size >= 4, "high").when(size >= 3, "medium").otherwise("low")


def detect_anomalies(current: DataFrame, base: DataFrame, threshold: float = 3.0,
                     granularity: str = "1 minute") -> DataFrame:
    """Buckets of ``current`` that deviate from ``base`` by more than ``threshold``.

    Traffic deviates both ways, the other metrics only upwards; a metric without
    spread in the baseline is not judged.
    """
    measured = bucket_metrics(current, granularity).withColumn("_base", base.select(F.struct("*")).scalar())
    return judged(measured, threshold)


def judged(measured: DataFrame, threshold: float = 3.0) -> DataFrame:
    """The anomalies among buckets with their metrics and the baseline as the struct ``_base``."""
    limit = threshold or 3.0
    rows = F.array(*[
        F.struct(F.lit(kind).alias("type"), F.lit(ANOMALY_TEXT[kind]).alias("description"),
                 F.col(m).alias("value"), F.col(f"_base.avg_{m}").alias("expected"),
                 F.try_divide(F.col(m) - F.col(f"_base.avg_{m}"), F.col(f"_base.stddev_{m}")).alias("z_score"))
        for kind, m in (("traffic_spike", "requests"), ("error_rate", "error_rate"), ("response_time", "response_time"))])
    scores = measured.select("bucket", F.inline(rows))
    deviates = F.when(F.col("type") == "traffic_spike", F.abs("z_score") > limit).otherwise(F.col("z_score") > limit)
    return scores.where(deviates).withColumn("severity", severity(F.col("z_score")))


def anomaly_summary(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("type", "severity").agg(F.count("*").alias("count"))


def anomaly_count(anomalies: DataFrame) -> DataFrame:
    return anomalies.agg(F.count("*").alias("total_anomalies"))
