"""API and GraphQL usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fixed_values import API_WORDS, GRAPHQL_OPERATIONS
from ..functions.status import is_error
from ..functions.text import contains_any, count_where, ratio, top
from ..plans.keys import attach, restrict, top_keys
from .performance import _averages, with_p95


def is_api_request(path: Column) -> Column:
    return contains_any(F.lower(path), API_WORDS)


def api_platform(path: Column) -> Column:
    low = F.lower(path)
    magento = contains_any(low, ("/rest/v1", "/graphql")) & (low.contains("magento") | low.rlike(r"/rest/v\d+/"))
    shopware = contains_any(low, ("store-api", "/api/")) & low.contains("shopware")
    return (F.when(contains_any(low, ("wp-json", "wc-api")), "woocommerce").when(magento, "magento")
            .when(shopware, "shopware").when(low.contains("prestashop"), "prestashop").otherwise("generic"))


def graphql_operation(path: Column, referer: Column) -> Column:
    """First listed operation named in path or referer (case matters), else ``unknown``."""
    chain = None
    for name in GRAPHQL_OPERATIONS:
        hit = path.contains(name) | referer.contains(name)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.otherwise("unknown")


def api_hits(df: DataFrame) -> DataFrame:
    return df.where(is_api_request(F.col("path")))


def api_platforms(df: DataFrame) -> DataFrame:
    return api_hits(df).groupBy(api_platform(F.col("path")).alias("platform")).agg(F.count("*").alias("count"))


def primary_platform(df: DataFrame) -> DataFrame:
    return top(api_platforms(df), 1, "count", "platform")


def api_endpoints(df: DataFrame, n: int | None = 20) -> DataFrame:
    calls = api_hits(df)
    return with_p95(calls, top(_averages(calls, ["method", "path"]), n, "count", "method", "path"), ["method", "path"], n)


def api_endpoint_statuses(df: DataFrame, n: int | None = 20) -> DataFrame:
    """Status counts of the top endpoints, one row per (method, path, status)."""
    calls = api_hits(df)
    chosen = top_keys(calls, ["method", "path"], n)
    return restrict(calls, chosen, ["method", "path"], n).groupBy("method", "path", "status").agg(F.count("*").alias("count"))


def api_endpoints_with_status(df: DataFrame, n: int = 20) -> DataFrame:
    maps = api_endpoint_statuses(df, n).groupBy("method", "path").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "count")))).alias("status_counts"))
    return attach(api_endpoints(df, n), maps, ["method", "path"], n)


def endpoint_details(df: DataFrame, text: str) -> DataFrame:
    """Every endpoint whose ``METHOD path`` contains ``text``."""
    calls = api_hits(df).where(F.concat(F.col("method"), F.lit(" "), F.col("path")).contains(text))
    return with_p95(calls, _averages(calls, ["method", "path"]), ["method", "path"], None)


def graphql_ops(df: DataFrame) -> DataFrame:
    referer = F.col("referer") if "referer" in df.columns else F.lit("")
    calls = api_hits(df).where(F.lower("path").contains("graphql"))
    return calls.groupBy(graphql_operation(F.col("path"), referer).alias("operation")).agg(
        F.count("*").alias("count"), F.avg("response_time").alias("avg_response_time"),
        count_where(is_error(F.col("status"))).alias("error_count"))


def api_summary(df: DataFrame) -> DataFrame:
    """One row, from one table of (method, path) totals; the platform follows from the path."""
    per_endpoint = api_hits(df).groupBy("method", "path").agg(
        F.count("*").alias("n"), F.sum("response_time").alias("seconds"),
        count_where(is_error(F.col("status"))).alias("errors"))
    per_platform = per_endpoint.groupBy(api_platform(F.col("path")).alias("platform")).agg(
        F.sum("n").alias("n"), F.count("*").alias("endpoints"), F.sum("seconds").alias("seconds"),
        F.sum("errors").alias("errors"))
    n = F.coalesce(F.sum("n"), F.lit(0))
    return per_platform.agg(
        n.alias("total_api_requests"), F.coalesce(F.sum("endpoints"), F.lit(0)).alias("unique_endpoints"),
        ratio(F.sum("errors"), n).alias("error_rate"), ratio(F.sum("seconds"), n).alias("avg_response_time"),
        F.min(F.struct((-F.col("n")).alias("rank"), "platform"))["platform"].alias("platform"))
