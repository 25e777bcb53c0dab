"""Shop analysis: platform, request categories, funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed_values import SHOP_CATEGORIES, SHOP_PLATFORM_CATEGORIES, SHOP_PLATFORMS
from ..functions.status import is_error
from ..functions.text import contains_any, count_where, first_match, ratio


def shop_platform_of(path: Column) -> Column:
    """Platform whose pattern the path contains, the first in order of priority."""
    low = F.lower(path)
    return first_match(low, [(name, [w.lower() for w in words]) for name, words in SHOP_PLATFORMS.items()])


def detect_shop_platform(df: DataFrame, seq: str = "seq") -> DataFrame:
    """One row: the platform of the first matching record and where that is."""
    return df.select(F.col(seq).alias("seq"), shop_platform_of(F.col("path")).alias("platform")).where(
        F.col("platform").isNotNull()).agg(F.min(F.struct("seq", "platform")).alias("first")).select(
        F.col("first.platform").alias("platform"), F.col("first.seq").alias("first_seq"))


def categorize(df: DataFrame, seq: str = "seq") -> DataFrame:
    """``df`` plus ``category`` and ``shop_platform``.

    Rules of a platform apply from its first record on.  The platform is a
    scalar subquery: one value, evaluated once, no join.
    """
    first = detect_shop_platform(df, seq).select(F.struct("*")).scalar()
    located = df.withColumn("_shop", first)
    low = F.lower("path")
    platform = F.when(F.col(seq) >= F.col("_shop.first_seq"), F.col("_shop.platform"))
    chain = None
    for label, words in SHOP_CATEGORIES:
        hit = contains_any(low, words)
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    for name, rules in SHOP_PLATFORM_CATEGORIES.items():
        for label, words in rules:
            chain = chain.when((platform == name) & contains_any(low, words), label)
    return located.withColumns({"category": chain, "shop_platform": platform}).drop("_shop")


def category_stats(df: DataFrame, seq: str = "seq") -> DataFrame:
    return categorize(df, seq).where(F.col("category").isNotNull()).groupBy("category").agg(
        F.count("*").alias("count"), F.avg("response_time").alias("avg_response_time"),
        count_where(is_error(F.col("status"))).alias("error_count"),
    ).withColumn("error_rate", ratio(F.col("error_count"), F.col("count")))


def funnel(df: DataFrame) -> DataFrame:
    """Requests without error per stage, and 1 - orders / views.

    The stages do not depend on the platform.
    """
    low = F.lower("path")
    chain = None
    for label, words in SHOP_CATEGORIES:
        hit = contains_any(low, words)
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    staged = df.where(~is_error(F.col("status"))).select(chain.alias("category"))

    def stage(name: str) -> Column:
        return F.coalesce(count_where(F.col("category") == name), F.lit(0))

    counts = staged.agg(stage("product").alias("product_views"), stage("cart").alias("cart_adds"),
                        stage("checkout").alias("checkouts"), stage("order").alias("orders"))
    views = F.col("product_views")
    return counts.withColumn("drop_off_rate", F.when(views > 0, 1 - F.try_divide(F.col("orders"), views)).otherwise(0.0))


def checkout_errors(df: DataFrame, seq: str = "seq") -> DataFrame:
    failed = categorize(df, seq).where((F.col("category") == "checkout") & is_error(F.col("status")))
    return failed.groupBy("path").agg(F.count("*").alias("count")).withColumn("error_type", F.lit("checkout_error"))


def shop_graphql(df: DataFrame, seq: str = "seq") -> DataFrame:
    """GraphQL requests of a Magento shop; no row if there are none."""
    calls = categorize(df, seq).where(
        F.col("category").isNotNull() & (F.col("shop_platform") == "magento") & F.lower("path").contains("graphql"))
    return calls.groupBy(F.lit("graphql_query").alias("operation")).agg(
        F.count("*").alias("count"), F.avg("response_time").alias("avg_response_time"),
        count_where(is_error(F.col("status"))).alias("error_count"))


def shop_summary(df: DataFrame, seq: str = "seq") -> DataFrame:
    """One row: platform and number of categorized requests."""
    found = categorize(df, seq).agg(F.count("category").alias("total_requests"))
    return found.withColumn("platform", F.coalesce(detect_shop_platform(df, seq).select("platform").scalar(), F.lit("")))
