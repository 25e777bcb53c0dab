"""Bot analysis: one row per bot user agent and summaries over it.

Classification runs on the distinct user agents left after aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import count_where, ratio, seconds_between, top
from ..functions.user_agents import bot_category, is_ai_bot, legitimacy_score
from .traffic import total_requests, with_bot_flag


def bot_profile(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Per bot user agent: requests, bytes, distinct paths, first and last time,
    category, legitimacy score, AI flag."""
    per_path = with_bot_flag(df).where("is_bot").groupBy("user_agent", "path").agg(
        F.count("*").alias("n"), F.sum("bytes_sent").alias("bytes"),
        F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"),
        F.min_by("ts", seq).alias("first_ts"), F.max_by("ts", seq).alias("last_ts"))
    per_agent = per_path.groupBy("user_agent").agg(
        F.sum("n").alias("count"), F.sum("bytes").alias("bytes"), F.count("*").alias("unique_paths"),
        F.min_by("first_ts", "first_seq").alias("first_ts"), F.max_by("last_ts", "last_seq").alias("last_ts"))
    span = seconds_between(F.col("first_ts"), F.col("last_ts"))
    agent = F.col("user_agent")
    return per_agent.withColumn("category", bot_category(agent)).select(
        "user_agent", "category", "count", "bytes", "unique_paths", span.alias("span"),
        ratio(span, F.col("count") - 1).alias("avg_interval"),
        legitimacy_score(agent, F.col("category")).alias("legitimacy_score"), is_ai_bot(agent).alias("is_ai_bot"))


def top_bots(profile: DataFrame, n: int | None = 10) -> DataFrame:
    return top(profile.drop("span"), n, "count", "user_agent")


def ai_bots(profile: DataFrame) -> DataFrame:
    return top_bots(profile.where("is_ai_bot"), None)


def legitimacy_scores(profile: DataFrame) -> DataFrame:
    return profile.select("user_agent", "category", "legitimacy_score")


def bot_summary(df: DataFrame) -> DataFrame:
    """Bot requests, distinct bots and their share of all requests, in one scan."""
    per_agent = with_bot_flag(df).groupBy("user_agent", "is_bot").agg(F.count("*").alias("n"))
    bots = F.coalesce(F.sum(F.when(F.col("is_bot"), F.col("n"))), F.lit(0))
    return per_agent.agg(
        bots.alias("total_bot_requests"), count_where(F.col("is_bot")).alias("unique_bots"),
        (ratio(bots, F.coalesce(F.sum("n"), F.lit(0))) * 100).alias("bot_traffic_pct"))


def bots_by_category(profile: DataFrame) -> DataFrame:
    """Per category: distinct bots and, apart from them, requests."""
    return profile.groupBy("category").agg(
        F.count("*").alias("unique_bots"), F.sum("count").alias("requests"))


def bot_category_shares(profile: DataFrame) -> DataFrame:
    """Adds each category's share of all bot requests."""
    total = profile.agg(F.sum("count")).scalar()
    return bots_by_category(profile).withColumn("percentage", F.try_divide(F.col("requests"), total) * 100)


def bots_in_category(profile: DataFrame, n: int | None = None) -> DataFrame:
    """Bots inside their category, most requests first.

    With ``n`` only the ``n`` leading ones, ranked.  Without it the whole list
    is sorted by range, so that no category has to fit one task.
    """
    listed = profile.select("category", "user_agent", "count", "bytes", "unique_paths", "legitimacy_score", "is_ai_bot")
    if n is None:
        return listed.orderBy("category", F.col("count").desc(), "user_agent")
    w = Window.partitionBy("category").orderBy(F.col("count").desc(), F.col("user_agent").asc())
    return listed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def bot_behavior(profile: DataFrame) -> DataFrame:
    rps = F.when((F.col("count") > 1) & (F.col("span") > 0), F.try_divide("count", "span")).otherwise(0.0)
    kind = (F.when(F.col("requests_per_second") > 10, "aggressive")
            .when(F.col("requests_per_second") > 1, "moderate")
            .when(F.col("unique_paths") > 100, "comprehensive")
            .when(F.col("unique_paths") > 10, "targeted").otherwise("light"))
    return profile.select("user_agent", "category", F.col("count").alias("request_count"), "unique_paths",
                          rps.alias("requests_per_second")).withColumn("behavior_type", kind)


def bot_share(df: DataFrame) -> DataFrame:
    """(is_bot, count, percentage)."""
    counted = with_bot_flag(df).groupBy("is_bot").agg(F.count("*").alias("count"))
    return counted.withColumn("percentage", F.try_divide(F.col("count"), total_requests(df)) * 100)
