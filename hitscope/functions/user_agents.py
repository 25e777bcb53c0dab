"""User-agent classification: bot flag, browser / OS / device, bot category."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .fixed_values import (
    AI_BOT_NAMES, BOT_BASE_SCORES, BOT_CATEGORIES, BOT_DEFAULT_SCORE, BOT_SIGNATURES,
    GENERIC_BOT_WORDS, MALICIOUS_USER_AGENTS, TSV_BOT_WORDS,
)
from .text import any_of, contains_any, first_match

# Browser families: (name, words one of which must occur, pattern whose first
# group is the version).  Order matters, since most browsers also name the ones
# they imitate.  The words keep most texts away from the patterns.
BROWSER_RULES = (
    ("Edge", ("Edg/", "Edge/"), r"Edge?/([0-9.]+)"),
    ("Opera", ("OPR/", "Opera/"), r"(?:OPR|Opera)/([0-9.]+)"),
    ("Samsung Internet", ("SamsungBrowser/",), r"SamsungBrowser/([0-9.]+)"),
    ("Firefox", ("Firefox/", "FxiOS/"), r"(?:Firefox|FxiOS)/([0-9.]+)"),
    ("Chrome", ("Chrome/", "CriOS/"), r"(?:Chrome|CriOS)/([0-9.]+)"),
    ("Internet Explorer", ("MSIE ", "Trident/"), r"(?:MSIE |Trident/.*rv:)([0-9.]+)"),
    ("Safari", ("Version/",), r"Version/([0-9.]+).*Safari/"),
    ("Safari", ("Safari/",), r"Safari/([0-9.]+)"),
)
# Operating systems: (name, substring).
OS_RULES = (
    ("Windows 10", "Windows NT 10.0"),
    ("Windows 8.1", "Windows NT 6.3"),
    ("Windows 8", "Windows NT 6.2"),
    ("Windows 7", "Windows NT 6.1"),
    ("Windows", "Windows"),
    ("iOS", "iPhone"),
    ("iOS", "iPad"),
    ("Android", "Android"),
    ("ChromeOS", "CrOS"),
    ("macOS", "Mac OS X"),
    ("Linux", "Linux"),
)
MOBILE_WORDS = ("Mobile", "Android", "iPhone", "iPad", "iPod")


def is_bot(user_agent: Column) -> Column:
    return contains_any(F.lower(user_agent), BOT_SIGNATURES)


def is_bot_short(user_agent: Column) -> Column:
    """The shorter test applied to tab-separated input."""
    return contains_any(F.lower(user_agent), TSV_BOT_WORDS)


def parse_user_agent(user_agent: Column) -> Column:
    """STRUCT<browser, os, device>; ``Unknown`` three times for ``''`` and ``-``."""
    product = F.regexp_extract(user_agent, r"^([A-Za-z][^/ ]*)/([0-9][0-9.]*)", 1)
    version = F.regexp_extract(user_agent, r"^([A-Za-z][^/ ]*)/([0-9][0-9.]*)", 2)
    browser = None
    for name, words, pattern in BROWSER_RULES:
        hit = any_of(user_agent.contains(w) for w in words) & user_agent.rlike(pattern)
        label = F.concat(F.lit(name + " "), F.regexp_extract(user_agent, pattern, 1))
        browser = F.when(hit, label) if browser is None else browser.when(hit, label)
    # Clients that are not browsers are named by their leading product token.
    browser = browser.when(~user_agent.startswith("Mozilla/") & (product != ""),
                           F.concat(product, F.lit(" "), version)).otherwise("")
    system = first_match(user_agent, [(name, (word,)) for name, word in OS_RULES], default="")
    device = (F.when(contains_any(user_agent, MOBILE_WORDS), "Mobile")
              .when(is_bot(user_agent), "Bot").otherwise("Desktop"))
    blank = user_agent.isin("", "-")

    def or_unknown(value: Column) -> Column:
        return F.when(blank, "Unknown").otherwise(value)

    return F.when(user_agent.isNotNull(), F.struct(
        or_unknown(browser).alias("browser"), or_unknown(system).alias("os"), or_unknown(device).alias("device")))


def bot_category(user_agent: Column) -> Column:
    low = F.lower(user_agent)
    chain = None
    for word, category in BOT_CATEGORIES.items():
        chain = F.when(low.contains(word), category) if chain is None else chain.when(low.contains(word), category)
    return chain.when(contains_any(low, GENERIC_BOT_WORDS), "generic").otherwise("unknown")


def is_ai_bot(user_agent: Column) -> Column:
    return contains_any(F.lower(user_agent), AI_BOT_NAMES)


def legitimacy_score(user_agent: Column, category: Column) -> Column:
    low = F.lower(user_agent)
    base = None
    for name, score in BOT_BASE_SCORES.items():
        base = F.when(category == name, score) if base is None else base.when(category == name, score)
    score = (base.otherwise(BOT_DEFAULT_SCORE)
             + F.when(contains_any(low, ("http://", "https://")), 10.0).otherwise(0.0)
             + F.when(F.octet_length(user_agent) > 100, 5.0).otherwise(0.0)
             + F.when(low.contains("compatible"), 5.0).otherwise(0.0))
    return F.least(score, F.lit(100.0))


def agent_threat(user_agent: Column) -> Column:
    """``empty``, ``malicious`` or NULL."""
    return (F.when(user_agent.isin("", "-"), "empty")
            .when(contains_any(F.lower(user_agent), MALICIOUS_USER_AGENTS), "malicious"))
