"""Security analysis: threat events, the per-address threat profile, summaries.

``ip_profile`` is the centre: one row per address with all counters.  Every
summary below is a small aggregate or top-k over it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.attacks import (
    ATTACK_TYPES, CORE, EXTENDED, RECORD_TYPES, agent_flags, flag_attacks, path_flags,
    platform_flags, sensitive_file_label, sequence_flags, web_shell_label, xxe_head, xxe_tail,
)
from ..functions.fixed_values import (
    ATTACK_LABELS, EXTENDED_ATTACK_LABELS, RECOMMENDATIONS, RECOMMENDATION_DEFAULT,
    SECURITY_ADVICE, THREAT_SEVERITY, THREAT_TEXT, THREAT_WEIGHTS,
)
from ..functions.text import any_of, count_where, fixed, ratio, seconds_between, shorten, thousands, top
from ..plans.arrival import CHUNK_ROWS
from ..plans.keys import attach, restrict, restrict_counted
from ..plans.workspace import stored
from .once_per_ip import LOGIN_FAILURES, first_logins, merged_logins, running_rules, third_type

DDOS_REQUESTS = 500
DDOS_RATE = 10.0
# Enough threats to fill any shortened text of a report (at most 40 bytes).
_SHOWN = 10


def flagged_hits(df: DataFrame, scan_user_agent: bool = True) -> DataFrame:
    return flag_attacks(df, scan_user_agent)


def attack_types_of(flags: tuple[str, ...] = RECORD_TYPES) -> Column:
    """ARRAY of the rules that a flagged record satisfies."""
    return F.array_compact(F.array(*[F.when(F.col(t), F.lit(t)) for t in flags]))


def _lookup(key: Column, table: dict[str, str], default: str) -> Column:
    chain = reduce(lambda acc, kv: acc.when(key == kv[0], kv[1]) if acc is not None else F.when(key == kv[0], kv[1]),
                   table.items(), None)
    return chain.otherwise(default)


def severity_of(threat_type: Column) -> Column:
    return _lookup(threat_type, THREAT_SEVERITY, "low")


def threat_events(df: DataFrame, seq: str = "seq", scan_user_agent: bool = True) -> DataFrame:
    """One row per record and core threat.  Narrow: no shuffle."""
    flagged = flag_attacks(df, scan_user_agent)
    country = [F.col("country")] if "country" in df.columns else []
    kind = F.col("threat_type")
    events = flagged.where(any_of(F.col(t) for t in CORE)).select(
        seq, "ts", "ip", "path", *country, F.posexplode(attack_types_of(CORE)).alias("position", "threat_type"))
    return events.select(
        seq, "position", "ts", "ip", "threat_type", "path", *country,
        severity_of(kind).alias("severity"),
        F.concat(_lookup(kind, THREAT_TEXT, "Security threat detected"), F.lit(": "), F.col("path")).alias("description"))


# The per-address profile ----------------------------------------------------

# The expressions below repeat over some twenty attack types.  They are written
# as SQL text: one call per column instead of one per operator in it.

def score() -> Column:
    """Threat score 0..100 from the counters of a profile row."""
    weighted = " + ".join(f"{weight}D * {name}" for name, weight in THREAT_WEIGHTS.items())
    return F.expr(f"""least({weighted}
        + 20D * coalesce(try_divide(error_count, request_count), 0D)
        + CASE WHEN duration > 0 AND try_divide(request_count, duration) > {DDOS_RATE}D THEN 15D ELSE 0D END
        + CASE WHEN attack_type_count >= 5 THEN 10D WHEN attack_type_count >= 3 THEN 5D ELSE 0D END, 100D)""")


def attack_type_count() -> Column:
    return F.expr(" + ".join(f"CAST({t} > 0 AS INT)" for t in ATTACK_TYPES))


def _agent_groups(df: DataFrame, seq: str, scan_user_agent: bool) -> DataFrame:
    """Counters per (address, country, user agent).

    Records are counted by what their path says.  What the user agent says
    holds for the whole group, so its rules run once per group and not once
    per record: if it matches, all records of the group do.
    """
    by_path = path_flags(df)
    path_types = [t for t in RECORD_TYPES if t in by_path]
    rows = df.select("ip", "country", "user_agent", "status", F.col(seq).alias("_seq"), "ts",
                     *[by_path[t].alias(t) for t in path_types],
                     by_path["introspection"].alias("_introspection"), by_path["is_api_path"].alias("_api"), xxe_tail(F.col("path")).alias("_xxe_tail"))
    counters = {"error_count": "status >= 400", "core_hits": " OR ".join(CORE), "_xxe_any": "xxe OR _xxe_tail"}
    counters |= {t: t for t in path_types} | {"api_count": "_api"}
    firsts = {"_introspection": "_introspection", "_first_xxe_any": "xxe OR _xxe_tail"}
    firsts |= {f"_first_{t}": t for t in path_types}
    groups = rows.groupBy("ip", "country", "user_agent").agg(*map(F.expr, (
        "count(*) AS request_count", "min(_seq) AS _from", "max(_seq) AS _to",
        "min_by(ts, _seq) AS _first_ts", "max_by(ts, _seq) AS _last_ts",
        *[f"count_if({test}) AS {name}" for name, test in counters.items()],
        *[f"min(CASE WHEN {test} THEN _seq END) AS {name}" for name, test in firsts.items()])))
    says = agent_flags(F.col("user_agent"), scan_user_agent)
    groups = groups.withColumns({f"_agent_{t}": c for t, c in says.items()} | {
        "_quote": xxe_head(F.col("user_agent")) if scan_user_agent else F.lit(False)})

    def total(t: str) -> str:
        count = t if t in by_path else "0"
        if t == "xxe":
            count = "CASE WHEN _quote THEN _xxe_any ELSE xxe END"
        return f"CASE WHEN _agent_{t} THEN request_count ELSE {count} END" if t in says else count

    def first(t: str) -> str:
        at = f"_first_{t}" if t in by_path else "NULL"
        if t == "xxe":
            at = "CASE WHEN _quote THEN _first_xxe_any ELSE _first_xxe END"
        return f"CASE WHEN _agent_{t} THEN _from ELSE {at} END" if t in says else at

    core_by_agent = " OR ".join(f"_agent_{t}" for t in CORE) if scan_user_agent else "false"
    return groups.selectExpr(
        "ip", "country", "request_count", "error_count", "api_count",
        f"CASE WHEN {core_by_agent} THEN request_count ELSE core_hits END AS core_hits",
        "CASE WHEN _agent_empty_ua THEN request_count ELSE 0 END AS empty_ua",
        "_from", "_to", "_first_ts", "_last_ts", "_introspection",
        *[f"{total(t)} AS {t}" for t in RECORD_TYPES], *[f"{first(t)} AS _first_{t}" for t in RECORD_TYPES])


def ip_profile(df: DataFrame, seq: str = "seq", scan_user_agent: bool = True,
               chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per address: request and error counts, country and time of the
    first record, time of the last, one counter per attack type, the number of
    attack types and the threat score.

    Counters combine map-side, so an address with a third of all records
    arrives as a few rows per task.
    """
    return profile_of(profile_state(df, seq, scan_user_agent, chunk_rows))


_SUMS = ("request_count", "error_count", "api_count", "core_hits", "empty_ua", *RECORD_TYPES)
_MINIMA = ("introspection_seq", *[f"first_{t}" for t in RECORD_TYPES], "error_ratio_seq", "api_rate_seq")


def profile_state(df: DataFrame, seq: str = "seq", scan_user_agent: bool = True, chunk_rows: int = CHUNK_ROWS,
                  before: DataFrame | None = None) -> DataFrame:
    """What ``profile_of`` needs of some records, one row of bounded size for each of their addresses.

    ``before`` is the state of all earlier records: the rules with running totals go on from there, so that
    ``merge_states`` of it and the result is the state of all.  Store it by day, and a new day costs a pass over that day.
    """
    state = _agent_groups(df, seq, scan_user_agent).groupBy("ip").agg(*map(F.expr, (
        *[f"sum({c}) AS {c}" for c in _SUMS], "min_by(country, _from) AS country", "min_by(_first_ts, _from) AS first_seen",
        "max_by(_last_ts, _to) AS last_seen", "min(_from) AS from_seq", "max(_to) AS to_seq", "min(_introspection) AS introspection_seq",
        *[f"min(_first_{t}) AS first_{t}" for t in RECORD_TYPES])))
    marked = df.withColumns(sequence_flags())
    return (state.join(running_rules(marked, seq, chunk_rows, before), "ip", "left")
            .join(first_logins(marked, seq), "ip", "left"))


def merge_states(before: DataFrame, after: DataFrame) -> DataFrame:
    """The state of two stretches of the log, the first ``before`` the second, from the state of each."""
    both = before.unionByName(after)
    merged = both.groupBy("ip").agg(*map(F.expr, (
        *[f"sum({c}) AS {c}" for c in _SUMS], "min_by(country, from_seq) AS country", "min_by(first_seen, from_seq) AS first_seen",
        "max_by(last_seen, to_seq) AS last_seen", "min(from_seq) AS from_seq", "max(to_seq) AS to_seq",
        *[f"min({c}) AS {c}" for c in _MINIMA])), F.collect_list("logins").alias("logins"))
    return merged.withColumn("logins", F.when(F.size("logins") > 0, merged_logins(F.col("logins")))).select(before.columns)


def profile_of(state: DataFrame) -> DataFrame:
    """The columns of ``ip_profile`` from the state of the whole log."""
    profile = state.withColumns({"credential_seq": F.get(F.col("logins.seq"), F.lit(LOGIN_FAILURES)),
                                 "api_abuse_seq": F.least("introspection_seq", "api_rate_seq")})
    seen = {t: f"first_{t}" for t in RECORD_TYPES}
    seen |= {"credential_stuffing": "credential_seq", "api_abuse": "api_abuse_seq"}
    profile = profile.withColumn("third_type", third_type(seen)).selectExpr(
        "ip", "country", "request_count", "error_count", "first_seen", "last_seen", "core_hits", "empty_ua", *RECORD_TYPES,
        "error_ratio_seq", "credential_seq", "api_abuse_seq",
        # Found after the scanning test, a third type needs one more record.
        "CASE WHEN third_type.after = 0 OR third_type.seq < to_seq THEN third_type END AS third_type",
        "CAST(credential_seq IS NOT NULL AS BIGINT) AS credential_stuffing",
        "CAST(api_abuse_seq IS NOT NULL AS BIGINT) AS api_abuse")
    profile = profile.withColumns({
        "is_scanning": F.expr("third_type IS NOT NULL OR error_ratio_seq IS NOT NULL"),
        "duration": seconds_between(F.col("first_seen"), F.col("last_seen")),
    }).withColumn("scanning", F.expr("CAST(is_scanning AS BIGINT)"))
    return profile.withColumn("attack_type_count", attack_type_count()).withColumn("threat_score", score()).select(
        "ip", "country", "request_count", "error_count", "first_seen", "last_seen", "duration", "core_hits", "empty_ua",
        *ATTACK_TYPES, "attack_type_count", "threat_score", "is_scanning", "third_type", "error_ratio_seq",
        "credential_seq", "api_abuse_seq")


def error_ratio() -> Column:
    return ratio(F.col("error_count"), F.col("request_count"))


def recommendation(threat_score: Column) -> Column:
    chain = None
    for bound, text in RECOMMENDATIONS:
        chain = F.when(threat_score >= bound, text) if chain is None else chain.when(threat_score >= bound, text)
    return chain.otherwise(RECOMMENDATION_DEFAULT)


def threat_level(threat_score: Column) -> Column:
    return (F.when(threat_score >= 70, "CRITICAL").when(threat_score >= 50, "HIGH")
            .when(threat_score >= 30, "MEDIUM").otherwise("LOW"))


def core_threat_count() -> Column:
    return F.expr(" + ".join(CORE))


def suspicious_ips(profile: DataFrame, n: int | None = 100) -> DataFrame:
    """Addresses with a core threat or a score above 30, highest score first."""
    found = profile.where((core_threat_count() > 0) | (F.col("threat_score") > 30))
    return top(found, n, "threat_score", "ip").withColumns({
        "threat_count": core_threat_count(),
        "recommendation": recommendation(F.col("threat_score")),
        "threat_level": threat_level(F.col("threat_score")),
        "total_attacks": F.expr(" + ".join(ATTACK_TYPES)),
    })


def attack_patterns_map() -> Column:
    """MAP<STRING,BIGINT> of the attack types an address has shown."""
    pairs = F.array(*[F.struct(F.lit(t).alias("key"), F.col(t).alias("value")) for t in ATTACK_TYPES])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"] > 0))


def attack_patterns(suspicious: DataFrame) -> DataFrame:
    """The same as rows: (ip, attack_type, count)."""
    return suspicious.select("ip", F.inline(F.map_entries(attack_patterns_map())).alias("attack_type", "count"))


def suspicious_threats(df: DataFrame, suspicious: DataFrame, seq: str = "seq", scan_user_agent: bool = True) -> DataFrame:
    """(ip, seq, position, threat_type): every threat of every suspicious address, repeats included.

    ``seq`` and ``position`` are the order within an address.
    """
    return restrict_counted(threat_events(df, seq, scan_user_agent), suspicious, "ip", seq).select("ip", seq, "position", "threat_type")


def with_threat_text(df: DataFrame, suspicious: DataFrame, n: int | None = None, seq: str = "seq",
                     scan_user_agent: bool = True) -> DataFrame:
    """Adds ``threat_text`` for reports that show at most 40 bytes of an address's threats.

    It names the first threats only, enough to fill that width; all of them
    are the rows of ``suspicious_threats``.  The rank limit acts before the
    shuffle.  ``suspicious`` is stored first, as it is used twice: so its profile is computed once, and its size is
    known to the engine.  ``n``: at most how many rows it has, if that is known.
    """
    suspicious = stored(suspicious, "suspicious")
    events = threat_events(df, seq, scan_user_agent)
    events = restrict(events, suspicious, ["ip"], n) if n is not None else restrict_counted(events, suspicious, "ip", seq)
    w = Window.partitionBy("ip").orderBy(seq, "position")
    head = events.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= _SHOWN)
    shown = head.groupBy("ip").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_rank", "threat_type"))), lambda s: s["threat_type"]), ", ").alias("threat_text"))
    return attach(suspicious, shown, ["ip"], n).withColumn("threat_text", F.coalesce("threat_text", F.lit("")))


# Summaries over the profile --------------------------------------------------

def is_ddos() -> Column:
    fast = (F.col("duration") > 0) & (F.try_divide("request_count", "duration") > DDOS_RATE)
    return (F.col("request_count") > DDOS_REQUESTS) | F.coalesce(fast, F.lit(False))


def _sum(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).cast("bigint")


def security_summary(profile: DataFrame) -> DataFrame:
    """One row: totals and one counter per rule.

    ``total_threats`` counts records with a core threat, every extended match,
    and each address once for credential stuffing and API abuse.
    """
    extra = ("credential_stuffing", "api_abuse")
    totals = profile.agg(
        _sum("request_count").alias("total_requests"), _sum("error_count").alias("total_errors"),
        F.count("*").alias("unique_ips"), _sum("core_hits").alias("_core"),
        _sum("empty_ua").alias("empty_ua"), *[_sum(t).alias(t) for t in ATTACK_TYPES])
    total = F.expr(" + ".join(("_core", *EXTENDED, *extra)))
    return totals.select(
        "total_requests", "total_errors", "unique_ips",
        (ratio(F.col("total_errors"), F.col("total_requests")) * 100).alias("error_percentage"),
        total.alias("total_threats"), *ATTACK_TYPES, "empty_ua",
        (F.col("malicious_ua") + F.col("empty_ua")).alias("suspicious_user_agents"))


def unique_attack_types(profile: DataFrame) -> DataFrame:
    """How many of six families occurred at all."""
    six = ("sql_injection", "xss", "directory_traversal", "command_injection", "brute_force", "scanning")
    return profile.agg(reduce(lambda a, b: a + b, [
        F.coalesce(F.max((F.col(t) > 0).cast("int")), F.lit(0)) for t in six]).alias("unique_attack_types"))


def ip_categories(profile: DataFrame) -> DataFrame:
    return profile.agg(
        count_where(F.col("threat_score") >= 30).alias("suspicious_ips"),
        count_where(is_ddos()).alias("potential_ddos_ips"),
        count_where((error_ratio() > 0.8) | (F.col("attack_type_count") >= 3)).alias("scanning_ips"),
        count_where(F.col("brute_force") > 0).alias("admin_access_ips"))


def _per_type(profile: DataFrame, types) -> DataFrame:
    """(attack_type, unique_ips, attempts): one pass, then a handful of rows."""
    one = profile.agg(*[c for t in types for c in (
        _sum(t).alias(t), count_where(F.col(t) > 0).alias(f"{t}_ips"))])
    rows = F.array(*[F.struct(F.lit(t).alias("attack_type"), F.col(f"{t}_ips").alias("unique_ips"),
                              F.col(t).alias("attempts")) for t in types])
    return one.select(F.inline(rows))


def attack_categories(profile: DataFrame) -> DataFrame:
    five = ("brute_force", "sql_injection", "xss", "directory_traversal", "command_injection")
    return _per_type(profile, five).select(
        _lookup(F.col("attack_type"), ATTACK_LABELS, "").alias("category"), "unique_ips", "attempts")


def top_attack_types(profile: DataFrame) -> DataFrame:
    found = _per_type(profile, tuple(ATTACK_LABELS)).where(F.col("attempts") > 0)
    return found.select(_lookup(F.col("attack_type"), ATTACK_LABELS, "").alias("attack_type"), "attempts", "unique_ips"
                        ).orderBy(F.col("attempts").desc(), "attack_type")


def extended_attack_table(profile: DataFrame) -> DataFrame:
    labels = {k: v[0] for k, v in EXTENDED_ATTACK_LABELS.items()}
    severities = {k: v[1] for k, v in EXTENDED_ATTACK_LABELS.items()}
    kind = F.col("attack_type")
    return _per_type(profile, tuple(EXTENDED_ATTACK_LABELS)).where(F.col("attempts") > 0).select(
        _lookup(kind, labels, "").alias("category"), "attempts", _lookup(kind, severities, "").alias("severity"))


def threat_ip_table(suspicious: DataFrame, n: int = 10) -> DataFrame:
    return top(suspicious.where(F.col("threat_score") >= 10), n, "threat_score", "ip").select(
        "ip", "threat_score", "request_count", (error_ratio() * 100).alias("error_percentage"),
        F.col("brute_force").alias("failed_logins"), "total_attacks")


def abusive_ips(df: DataFrame, suspicious: DataFrame, n: int = 15, seq: str = "seq", scan_user_agent: bool = True) -> DataFrame:
    """Of all suspicious addresses those with most requests."""
    named = with_threat_text(df, top(suspicious, n, "request_count", "ip"), n, seq, scan_user_agent)
    text = F.when(F.col("threat_text") == "", "High Error Rate").otherwise(F.col("threat_text"))
    return named.select(
        "ip", "threat_score", "request_count", (error_ratio() * 100).alias("error_percentage"),
        shorten(text, 30).alias("attack_types"), F.col("brute_force").alias("failed_logins"))


def security_recommendations(suspicious: DataFrame) -> DataFrame:
    found = suspicious.agg(
        F.bool_or(F.col("request_count") > DDOS_REQUESTS).alias("ddos"),
        F.bool_or(F.col("threat_score") >= 70).alias("high_threat"),
        F.bool_or(F.col("brute_force") > 0).alias("brute_force"),
        F.bool_or(error_ratio() > 0.8).alias("scanning"))
    found = found.select(*[F.coalesce(c, F.lit(False)).alias(c) for c in found.columns])
    found = found.withColumn("none", ~any_of(F.col(c) for c in found.columns))
    rows = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(k).alias("topic"), F.lit(t).alias("advice"),
                              F.col(k).alias("applies")) for i, (k, t) in enumerate(SECURITY_ADVICE.items())])
    return found.select(F.inline(rows)).where("applies").drop("applies")


def block_list(named: DataFrame, option: str = "critical") -> DataFrame:
    """Deny rules for suspicious addresses: (request_count, ip, line).

    ``critical``: score of at least 70; ``all``: every one of them;
    ``error100``: no request succeeded.  Most requests come first, then by
    address; the writer sorts by these.
    """
    error = error_ratio() * 100
    text = F.col("threat_text")
    if option == "all":
        text = F.when(text != "", text).when(error >= 80, "High error rate").otherwise("")
    text = shorten(text, 40)
    score_text = F.concat(F.lit("Score: "), fixed(F.col("threat_score"), 1))
    requests = F.concat(F.lit("Requests: "), thousands(F.col("request_count")))
    errors = F.concat(F.lit("Error: "), fixed(error, 0), F.lit("%"))
    deny = F.concat(F.lit("deny "), F.col("ip"), F.lit(";  # "))
    wanted, parts = {
        "critical": (F.col("threat_score") >= 70, [score_text, requests, errors, F.concat(F.lit("Attacks: "), text)]),
        "all": (F.lit(True), [score_text, requests, errors, text]),
        "error100": (error >= 100, [requests, score_text, text]),
    }[option]
    return named.where(wanted).select(
        "request_count", "ip", F.concat(deny, F.concat_ws(", ", *parts)).alias("line"))


# Record-level breakdowns -----------------------------------------------------

def rule_counts(df: DataFrame, scan_user_agent: bool = True) -> DataFrame:
    """(rule, records): matches per record-level rule, without any per-address state."""
    flagged = flag_attacks(df, scan_user_agent)
    names = (*RECORD_TYPES, "empty_ua", "failed_login", "is_api_path", "introspection")
    one = flagged.agg(*[count_where(F.col(t)).alias(t) for t in names])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(t).alias("rule"), F.col(t).alias("records")) for t in names])))


def platform_threats(df: DataFrame) -> DataFrame:
    flags = platform_flags()
    one = df.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in flags.items()])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(t).alias("threat"), F.col(t).alias("count")) for t in flags]))).where(F.col("count") > 0)


def sensitive_files(df: DataFrame, n: int | None = 10) -> DataFrame:
    flagged = flag_attacks(df).where("sensitive_files")
    return top(flagged.groupBy(sensitive_file_label(F.col("path")).alias("file_type")).agg(
        F.count("*").alias("count")), n, "count", "file_type")


def web_shells(df: DataFrame, scan_user_agent: bool = True) -> DataFrame:
    flagged = flag_attacks(df, scan_user_agent).where("web_shell")
    text = F.concat(F.col("path"), F.lit(" "), F.col("user_agent"))
    return flagged.groupBy(web_shell_label(text).alias("shell_type")).agg(F.count("*").alias("count"))


def anomalous_methods(df: DataFrame) -> DataFrame:
    return flag_attacks(df).where("http_method_anomaly").groupBy("method").agg(F.count("*").alias("count"))


