"""Static content by extension, and SEO checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed_values import CONTENT_TYPES, DEFAULT_CONTENT_TYPE, RESOURCE_CATEGORIES, SEO_ISSUES
from ..functions.text import count_where

LARGE_IMAGE_BYTES = 500 * 1024
SLOW_SECONDS = 2.0


def extension(path: Column) -> Column:
    """Lower-case suffix from the last dot of the last segment (query included), or ``''``."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)\z", 1))


def resource_category(ext: Column) -> Column:
    chain = None
    for name, exts in RESOURCE_CATEGORIES.items():
        chain = F.when(ext.isin(*exts), name) if chain is None else chain.when(ext.isin(*exts), name)
    return chain.otherwise("other")


def content_type(ext: Column) -> Column:
    chain = None
    for name, mime in CONTENT_TYPES.items():
        chain = F.when(ext == name, mime) if chain is None else chain.when(ext == name, mime)
    return chain.otherwise(DEFAULT_CONTENT_TYPE)


def resources(df: DataFrame) -> DataFrame:
    """Records whose path has an extension, with ``extension``."""
    return df.withColumn("extension", extension(F.col("path"))).where(F.col("extension") != "")


def extension_stats(df: DataFrame) -> DataFrame:
    return resources(df).groupBy("extension").agg(
        F.count("*").alias("count"), F.sum("bytes_sent").alias("bytes"),
        F.avg("response_time").alias("avg_response_time"))


def resource_categories(df: DataFrame) -> DataFrame:
    per_ext = resources(df).groupBy("extension").agg(F.count("*").alias("n"))
    return per_ext.groupBy(resource_category(F.col("extension")).alias("category")).agg(F.sum("n").alias("count"))


def content_types(df: DataFrame) -> DataFrame:
    per_ext = resources(df).groupBy("extension").agg(F.count("*").alias("n"))
    return per_ext.groupBy(content_type(F.col("extension")).alias("content_type")).agg(F.sum("n").alias("count"))


def seo_issues(df: DataFrame) -> DataFrame:
    """(type, count, severity, description) of the issues that occur, over resources only."""
    tests = {
        "large_images": (resource_category(F.col("extension")) == "image") & (F.col("bytes_sent") > LARGE_IMAGE_BYTES),
        "broken_links": F.col("status") == 404,
        "slow_resources": F.col("response_time") > SLOW_SECONDS,
    }
    one = resources(df).agg(*[count_where(test).alias(name) for name, test in tests.items()])
    rows = F.array(*[F.struct(F.lit(name).alias("type"), F.col(name).alias("count"), F.lit(severity).alias("severity"),
                              F.lit(text).alias("description")) for name, (severity, text) in SEO_ISSUES.items()])
    return one.select(F.inline(rows)).where(F.col("count") > 0)


def content_summary(df: DataFrame) -> DataFrame:
    return resources(df).agg(F.count("*").alias("total_resources"))
