"""Report bundles: several operators over one input, read once.

The input is persisted with spill to disk.  A lost executor only costs a
recomputation, as nothing depends on the cached copy.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..operators import anomaly, api_usage, bots, commerce, content, geo, performance, security, timeline, traffic


@contextlib.contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` persisted for the length of a ``with`` block."""
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def traffic_report(hits: DataFrame, seq: str = "seq", granularity: str = "1 minute") -> dict[str, DataFrame]:
    return {
        "summary": traffic.traffic_summary(hits), "rates": traffic.traffic_rates(hits),
        "statuses": traffic.share_of_total(traffic.status_counts(hits), hits),
        "methods": traffic.method_counts(hits), "paths": traffic.paths_with_handler(hits),
        "ips": traffic.top_ips(hits, 15, seq), "countries": traffic.top_countries(hits),
        "country_ips": traffic.country_ip_share(hits, seq=seq),
        "user_agents": traffic.user_agent_types(hits), "browsers": traffic.top_browsers(hits), "os": traffic.top_os(hits),
        "bandwidth": traffic.bandwidth_stats(hits), "response_times": traffic.response_time_stats(hits),
        "timeline": timeline.timeline(hits, granularity),
    }


def security_report(hits: DataFrame, profile: DataFrame, seq: str = "seq") -> dict[str, DataFrame]:
    """``profile`` is ``security.ip_profile(hits)``, best inside ``kept``."""
    suspicious = security.suspicious_ips(profile)
    everyone = security.suspicious_ips(profile, None)
    return {
        "summary": security.security_summary(profile), "ip_categories": security.ip_categories(profile),
        "attack_categories": security.attack_categories(profile), "attack_types": security.top_attack_types(profile),
        "extended": security.extended_attack_table(profile), "suspicious_ips": suspicious,
        "threat_ips": security.threat_ip_table(suspicious), "abusive_ips": security.abusive_ips(hits, everyone, seq=seq),
        "sensitive_files": security.sensitive_files(hits), "web_shells": security.web_shells(hits),
        "methods": security.anomalous_methods(hits), "platforms": security.platform_threats(hits),
        "recommendations": security.security_recommendations(everyone),
    }


def bot_report(hits: DataFrame, profile: DataFrame) -> dict[str, DataFrame]:
    """``profile`` is ``bots.bot_profile(hits)``."""
    return {
        "summary": bots.bot_summary(hits), "categories": bots.bot_category_shares(profile),
        "top_bots": bots.top_bots(profile), "ai_bots": bots.ai_bots(profile), "behavior": bots.bot_behavior(profile),
    }


def performance_report(hits: DataFrame) -> dict[str, DataFrame]:
    return performance.performance_report(hits)


def api_report(hits: DataFrame) -> dict[str, DataFrame]:
    return {"summary": api_usage.api_summary(hits), "endpoints": api_usage.api_endpoints(hits),
            "graphql": api_usage.graphql_ops(hits)}


def shop_report(hits: DataFrame, seq: str = "seq") -> dict[str, DataFrame]:
    return {"summary": commerce.shop_summary(hits, seq), "categories": commerce.category_stats(hits, seq),
            "funnel": commerce.funnel(hits), "checkout_errors": commerce.checkout_errors(hits, seq),
            "graphql": commerce.shop_graphql(hits, seq)}


def content_report(hits: DataFrame) -> dict[str, DataFrame]:
    return {"summary": content.content_summary(hits), "extensions": content.extension_stats(hits),
            "categories": content.resource_categories(hits), "types": content.content_types(hits),
            "seo_issues": content.seo_issues(hits)}


def geo_report(hits: DataFrame, seq: str = "seq") -> dict[str, DataFrame]:
    return {"countries": geo.geo_summary(hits, seq=seq), "threat_map": geo.threat_map(hits, seq=seq)}


def anomaly_report(current: DataFrame, history: DataFrame, threshold: float = 3.0,
                   granularity: str = "1 minute") -> dict[str, DataFrame]:
    base = anomaly.baseline(history, granularity)
    found = anomaly.detect_anomalies(current, base, threshold, granularity)
    return {"baseline": base, "anomalies": found, "summary": anomaly.anomaly_summary(found)}
