"""Small Column builders shared by all operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


#: ASCII white space, as trimmed from the ends of raw lines.
WHITE = " \t\n\x0b\f\r"


def trimmed(value: str) -> Column:
    """A column without white space at either end; ``trim`` alone takes blanks only."""
    return F.btrim(F.col(value), F.lit(WHITE))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def contains_any(text: Column, words) -> Column:
    """True where ``text`` contains one of ``words``.

    A word that contains another listed word can never decide the outcome, so
    only the shortest ones are tested.
    """
    needed = [w for w in words if not any(o != w and o in w for o in words)]
    return any_of(text.contains(w) for w in dict.fromkeys(needed))


def first_match(text: Column, labelled_words, default=None) -> Column:
    """Label of the first entry of ``[(label, words), ...]`` found in ``text``."""
    chain = None
    for label, words in labelled_words:
        hit = any_of(text.contains(w) for w in words)
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain.otherwise(F.lit(default))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 where there is no whole.

    Divisions here use ``try_divide``: a guard beside a plain division does not
    stop the engine from evaluating it early, which fails in ANSI mode.
    """
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def fixed(number: Column, digits: int) -> Column:
    """``number`` with a fixed count of decimals and no digit grouping."""
    return F.replace(F.format_number(number.cast("double"), digits), F.lit(","), F.lit(""))


def shorten(text: Column, limit: int) -> Column:
    """Cut to ``limit`` bytes with a trailing ellipsis (ASCII text)."""
    return F.when(F.octet_length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit - 3), F.lit("...")))


def count_where(condition: Column) -> Column:
    """Rows that satisfy ``condition`` (never NULL, also over no rows)."""
    return F.count_if(condition)


def top(df, n, by: str, *keys: str):
    """Largest ``by`` first, ties broken by key; all rows when ``n`` is None."""
    ordered = df.orderBy(F.col(by).desc(), *[F.col(k).asc() for k in keys])
    return ordered if n is None else ordered.limit(n)
