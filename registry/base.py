"""Registration of queries, each with its DuckDB text where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from hitscope.functions.fixed_values import ATTACK_PATTERNS, BOT_SIGNATURES
from hitscope.session import require_utc

from .view import hits, hits_oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TIE = 1e-12


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 9 decimals, so that the order of summation does not show.

    The tiny addend settles means that lie exactly between two roundings, such
    as those over 320 values of 4 decimals; both engines add it.
    """
    return df.select(*[F.round(F.col(f.name) + TIE, 9).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
                       for f in df.schema.fields])


def add(name: str, build: Callable[[DataFrame], DataFrame], sql: str | None = None, referer: bool = False) -> None:
    """A query over the access-log view."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(build(hits(require_utc(spark), sf_dir, referer)))

    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = with_hits(sql, referer)


def add_raw(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None, referer: bool = False) -> None:
    """A query that needs the session and the folder."""
    QUERIES[name] = lambda spark, sf_dir: rounded(run(require_utc(spark), sf_dir))
    if sql is not None:
        ORACLES[name] = with_hits(sql, referer)


def with_hits(sql: str, referer: bool = False) -> str:
    """``sql`` with the view as common table ``hits``; it may start with its own WITH."""
    body = sql.strip()
    head = f"WITH hits AS ({hits_oracle(referer)})"
    return f"{head}, {body[5:].lstrip()}" if body[:5].upper() == "WITH " else f"{head} {body}"


def r(expression: str) -> str:
    return f"round({expression} + {TIE}, 9)"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def contains_any_sql(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {text(w)})" for w in words) + ")"


def matches(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {text(pattern)})"


def is_bot_sql(column: str = "user_agent") -> str:
    return matches(f"lower({column})", "|".join(re.escape(w) for w in BOT_SIGNATURES))


def pattern_sql(name: str, column: str) -> str:
    return matches(column, ATTACK_PATTERNS[name])


ERRORS = "count(*) FILTER (status >= 400)"
