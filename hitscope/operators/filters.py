"""Record filters: each is a predicate; a filter set is their conjunction."""

from __future__ import annotations

import dataclasses
import datetime as dt
import ipaddress

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import addresses
from ..functions.addresses import v4_number, v6_hex
from ..functions.fixed_values import API_ONLY_PATTERN, BLOCKED_STATUSES
from ..functions.text import all_of, any_of
from ..functions.user_agents import is_bot
from ..plans import networks


def in_countries(countries) -> Column:
    """The listed names are upper-cased, the record's country is not."""
    return F.col("country").isin([c.upper() for c in countries])


def in_statuses(statuses) -> Column:
    return F.col("status").isin(list(statuses))


def in_methods(methods) -> Column:
    return F.col("method").isin([m.upper() for m in methods])


def in_networks(cidrs) -> Column:
    return addresses.in_networks(F.col("ip"), cidrs)


def in_time_range(start, end) -> Column:
    """Both ends belong to the range."""
    return F.col("ts").between(F.lit(start), F.lit(end))


def path_matches(patterns) -> Column:
    return any_of(F.col("path").rlike(p) for p in patterns)


def no_bots(df: DataFrame | None = None) -> Column:
    flagged = df is None or "is_bot" in df.columns
    return ~(F.col("is_bot") if flagged else is_bot(F.col("user_agent")))


def is_blocked(statuses=()) -> Column:
    return F.col("status").isin(list(statuses) or list(BLOCKED_STATUSES))


def slow_requests(seconds: float) -> Column:
    return F.col("response_time") >= seconds


def large_responses(size: int) -> Column:
    return F.col("bytes_sent") >= size


@dataclasses.dataclass(frozen=True)
class HitFilter:
    """A set of filters; what is left empty does not filter."""

    countries: tuple[str, ...] = ()
    statuses: tuple[int, ...] = ()
    methods: tuple[str, ...] = ()
    networks: tuple[str, ...] = ()
    time_range: tuple[dt.datetime, dt.datetime] | None = None
    path_patterns: tuple[str, ...] = ()
    exclude_bots: bool = False
    ignore_blocked: bool = False
    blocked_statuses: tuple[int, ...] = ()


def predicate(spec: HitFilter, df: DataFrame | None = None) -> Column:
    """The conjunction of a filter set, cheap tests first."""
    tests: list[Column] = []
    if spec.ignore_blocked:
        tests.append(~is_blocked(spec.blocked_statuses))
    if spec.statuses:
        tests.append(in_statuses(spec.statuses))
    if spec.time_range:
        tests.append(in_time_range(*spec.time_range))
    if spec.methods:
        tests.append(in_methods(spec.methods))
    if spec.countries:
        tests.append(in_countries(spec.countries))
    if spec.exclude_bots:
        tests.append(no_bots(df))
    if spec.networks:
        tests.append(in_networks(spec.networks))
    if spec.path_patterns:
        tests.append(path_matches(spec.path_patterns))
    return all_of(tests) if tests else F.lit(True)


def apply_filters(df: DataFrame, spec: HitFilter) -> DataFrame:
    return df.where(predicate(spec, df))


#: So many networks are written into the plan.
_IN_PLAN = 1_000


def in_network_table(df: DataFrame, cidrs: list[str], spread: str = "seq") -> DataFrame:
    """Rows whose address lies in any of MANY networks, each row once.

    A few are looked up by literals of the plan, more in an interval index that is sent to all tasks, and where that
    would be too large, in a table: see ``networks``.  An empty list filters nothing, as in a filter set.
    """
    if not cidrs:
        return df
    if len(cidrs) <= _IN_PLAN:
        return _in_literals(df, cidrs)
    index = networks.NetworkIndex(cidrs)
    if index.nbytes <= networks.SENT:
        return df.where(index.holds(df.sparkSession, F.col("ip")))
    table = df.sparkSession.createDataFrame([(c,) for c in cidrs], "network string")
    return networks.in_network_frame(df, table, spread=spread)


def _in_literals(df: DataFrame, cidrs: list[str]) -> DataFrame:
    """Networks are merged first.  For every prefix length in use the address's bits up to that length are looked up in
    a set, so there is no join and no shuffle."""
    nets = [ipaddress.ip_network(c, strict=False) for c in cidrs]
    merged = [n for v in (4, 6) for n in ipaddress.collapse_addresses([n for n in nets if n.version == v])]
    known: dict[tuple[int, int], list[str]] = {}
    for n in merged:
        width = 32 if n.version == 4 else 128
        known.setdefault((n.version, n.prefixlen), []).append(format(int(n.network_address), f"0{width}b")[:n.prefixlen])
    bits = {4: F.lpad(F.bin(v4_number(F.col("ip"))), 32, "0")}
    digits = F.filter(F.split(v6_hex(F.col("ip")), ""), lambda d: d != "")
    bits[6] = F.when(F.col("ip").contains(":"), F.array_join(
        F.transform(digits, lambda d: F.lpad(F.conv(d, 16, 2), 4, "0")), ""))
    used = {v for v, _ in known}
    named = df.withColumns({f"_bits{v}": bits[v] for v in used})
    tests = [F.coalesce(F.substring(f"_bits{v}", 1, length).isin(prefixes), F.lit(False)) for (v, length), prefixes in known.items()]
    return named.where(any_of(tests)).drop(*[f"_bits{v}" for v in used])


# Presets -------------------------------------------------------------------

def errors_only() -> Column:
    return F.col("status").between(400, 599)


def success_only() -> Column:
    return F.col("status").between(200, 299)


def client_errors_only() -> Column:
    return F.col("status").between(400, 499)


def server_errors_only() -> Column:
    return F.col("status").between(500, 599)


def api_only() -> Column:
    return path_matches([API_ONLY_PATTERN])


def recent_activity(hours: int, as_of: dt.datetime) -> Column:
    return in_time_range(as_of - dt.timedelta(hours=hours), as_of)


by_countries = in_countries
by_status = in_statuses
by_method = in_methods
