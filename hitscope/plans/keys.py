"""Top-k first, details after.

A report over the ``n`` largest keys needs details of those keys only, so the
wide aggregates (distinct counts, percentiles) run over a restricted scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .workspace import stored

BROADCAST_KEYS = 10_000
#: Keys counted up to this number are sent to all tasks; beyond it every key is met in so many places.
COUNTED_KEYS = 100_000
SALTS = 32


def top_keys(df: DataFrame, keys: list[str], n: int | None) -> DataFrame:
    """The ``n`` keys with most rows: (keys..., count)."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("count"))
    if n is None:
        return counted
    return counted.orderBy(F.col("count").desc(), *[F.col(k).asc() for k in keys]).limit(n)


def restrict(df: DataFrame, chosen: DataFrame, keys: list[str], n: int | None) -> DataFrame:
    """Rows of ``df`` whose key is in ``chosen``; without ``n``, of any number of keys."""
    return df.join(_bounded(chosen.select(*keys), n), keys, "left_semi")


def restrict_counted(df: DataFrame, chosen: DataFrame, key: str, spread: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``chosen``, of which nothing is known.

    The keys are stored and counted: few are sent to all tasks; many are joined, and each is dealt out over ``SALTS``
    places by ``spread``, a column that differs from row to row, so that no task gets all rows of a busy key.
    """
    keys = stored(chosen.select(key).distinct(), "keys")
    if keys.limit(COUNTED_KEYS + 1).count() <= COUNTED_KEYS:
        return df.join(F.broadcast(keys), key, "left_semi").select(df.columns)
    everywhere = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return salted.join(everywhere, [key, "_salt"], "left_semi").select(df.columns)


def attach(left: DataFrame, right: DataFrame, keys: list[str], n: int | None, how: str = "left") -> DataFrame:
    """Join per-key columns, one row for each key of ``right``."""
    return left.join(_bounded(right, n), keys, how)


def _bounded(side: DataFrame, n: int | None) -> DataFrame:
    """A hint only where the side can't hold more than a small ``n`` of rows; else the engine decides from measured sizes."""
    return F.broadcast(side.limit(n)) if n is not None and n <= BROADCAST_KEYS else side
