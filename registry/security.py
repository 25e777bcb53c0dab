"""Queries on security.

The expected profile follows the definition record by record, with running
windows per address and the next record found by ``lead``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from hitscope.functions import attacks as at
from hitscope.functions.fixed_values import (
    ADMIN_PATHS, ATTACK_LABELS, BRUTE_FORCE_WORDS, CREDENTIAL_WORDS, EXTENDED_ATTACK_LABELS, MALICIOUS_USER_AGENTS,
    THREAT_WEIGHTS,
)
from hitscope.operators import once_per_ip, security as s
from hitscope.plans.history import advance_profile
from hitscope.plans.workspace import shared_folder, stored

from .base import ORACLES, add, contains_any_sql, pattern_sql, r, text
from .view import hits_oracle

_PATH, _PU, _PR, _PUR = "path", "path || ' ' || user_agent", "path || ' ' || referer", "path || ' ' || user_agent || ' ' || referer"
READS = {**{t: _PU for t in (*at.CORE, "web_shell", "xxe")}, "log4shell": _PUR, "ssrf": _PR}
RULES = {
    **{t: pattern_sql(t, READS.get(t, _PATH)) for t in (
        *at.CORE, "sensitive_files", "web_shell", "log4shell", "ssrf", "path_traversal_ext", "open_redirect", "xxe",
        "crlf_injection", "template_injection", "nosql_injection", "prototype_pollution")},
    "malicious_ua": f"user_agent NOT IN ('', '-') AND {contains_any_sql('lower(user_agent)', MALICIOUS_USER_AGENTS)}",
    "empty_ua": "user_agent IN ('', '-')",
    "http_method_anomaly": "method IN ('TRACE', 'TRACK', 'DEBUG', 'CONNECT')",
    "brute_force": f"status IN (401, 403) AND {contains_any_sql('lower(path)', BRUTE_FORCE_WORDS)}",
    "failed_login": f"status IN (401, 403) AND {contains_any_sql('lower(path)', CREDENTIAL_WORDS)}",
    "is_api_path": contains_any_sql("lower(path)", ("/api/", "/rest/", "/graphql")),
    "introspection": "contains(lower(path), '/graphql') AND contains(lower(path), 'introspection')",
}
FLAGS = "flags AS (SELECT *, " + ", ".join(f"({c}) AS {n}" for n, c in RULES.items()) + " FROM hits)"

_RECORD = at.RECORD_TYPES
_ONCE = {*at.CORE, "brute_force"}
_ANY_CORE = " OR ".join(at.CORE)
_SCORE = " + ".join(f"{w} * {t}" for t, w in THREAT_WEIGHTS.items())
_TYPES = " + ".join(f"({t} > 0)::INTEGER" for t in at.ATTACK_TYPES)
PROFILE = f"""WITH {FLAGS},
ordered AS (SELECT *, row_number() OVER w AS rn, sum((status >= 400)::INT) OVER w AS re, sum(is_api_path::INT) OVER w AS ra,
    first_value(ts) OVER w AS first_ts, lead(seq) OVER (PARTITION BY ip ORDER BY seq) AS nxt FROM flags
    WINDOW w AS (PARTITION BY ip ORDER BY seq ROWS UNBOUNDED PRECEDING)),
timed AS (SELECT *, (epoch_us(ts) - epoch_us(first_ts)) / 1e6 AS since FROM ordered),
logins AS (SELECT ip, seq, ts, nxt, row_number() OVER (PARTITION BY ip ORDER BY seq) AS k FROM (
    SELECT ip, ts, min(seq) AS seq, arg_min(nxt, seq) AS nxt FROM ordered WHERE failed_login GROUP BY ip, ts)),
cred AS (SELECT ip, seq AS credential_seq, nxt AS credential_next FROM logins WHERE k = 6),
abuse AS (SELECT ip, min(seq) AS api_abuse_seq, arg_min(nxt, seq) AS api_abuse_next FROM timed
    WHERE introspection OR (is_api_path AND ra > 100 AND since > 0 AND ra / since > 5) GROUP BY ip),
ratios AS (SELECT ip, min(seq) AS error_ratio_seq FROM timed WHERE rn > 10 AND re / rn > 0.8 GROUP BY ip),
shown AS (
    SELECT ip, unnest([{", ".join(f"min(seq) FILTER ({t})" if t in _ONCE else f"min(nxt) FILTER ({t})" for t in _RECORD)}]) AS eff
    FROM ordered GROUP BY ip
    UNION ALL SELECT ip, credential_next FROM cred UNION ALL SELECT ip, api_abuse_next FROM abuse),
third AS (SELECT ip, eff AS third_seq FROM (SELECT ip, eff, row_number() OVER (PARTITION BY ip ORDER BY eff) AS k FROM shown WHERE eff IS NOT NULL) WHERE k = 3),
base AS (SELECT ip, arg_min(country, seq) AS country, count(*) AS request_count, count(*) FILTER (status >= 400) AS error_count,
    arg_min(ts, seq) AS first_seen, arg_max(ts, seq) AS last_seen,
    (epoch_us(arg_max(ts, seq)) - epoch_us(arg_min(ts, seq))) / 1e6 AS duration,
    count(*) FILTER ({_ANY_CORE}) AS core_hits, count(*) FILTER (empty_ua) AS empty_ua,
    {", ".join(f"count(*) FILTER ({t}) AS {t}" for t in _RECORD)} FROM flags GROUP BY ip),
full_base AS (SELECT base.*, (third_seq IS NOT NULL OR error_ratio_seq IS NOT NULL)::BIGINT AS scanning,
    (credential_seq IS NOT NULL)::BIGINT AS credential_stuffing, (api_abuse_seq IS NOT NULL)::BIGINT AS api_abuse,
    least(third_seq, error_ratio_seq) AS scanning_seq, error_ratio_seq, credential_seq, api_abuse_seq
    FROM base LEFT JOIN third USING (ip) LEFT JOIN ratios USING (ip) LEFT JOIN cred USING (ip) LEFT JOIN abuse USING (ip)),
typed AS (SELECT *, ({_TYPES})::INTEGER AS attack_type_count FROM full_base),
profile AS (SELECT *, least(100.0, {_SCORE} + 20.0 * error_count / request_count
    + CASE WHEN duration > 0 AND request_count / duration > 10 THEN 15 ELSE 0 END
    + CASE WHEN attack_type_count >= 5 THEN 10 WHEN attack_type_count >= 3 THEN 5 ELSE 0 END)::DOUBLE AS threat_score FROM typed)"""
EVERYONE = PROFILE + f""",
suspicious AS (SELECT *, {" + ".join(at.CORE)} AS threat_count, {" + ".join(at.ATTACK_TYPES)} AS total_attacks,
    error_count * 100.0 / request_count AS error_pct FROM profile
    WHERE {" + ".join(at.CORE)} > 0 OR threat_score > 30)"""
SUSPICIOUS = EVERYONE + " , top AS (SELECT * FROM suspicious ORDER BY threat_score DESC, ip LIMIT 100)"

# Record level ------------------------------------------------------------------
_names = (*_RECORD, "empty_ua", "failed_login", "is_api_path", "introspection")
add("rule_counts", s.rule_counts, f"WITH {FLAGS} " + " UNION ALL ".join(
    f"SELECT {text(t)} AS rule, count(*) FILTER ({t}) AS records FROM flags" for t in _names), True)
for _t in (*_RECORD, "empty_ua", "is_api_path"):
    add(_t, lambda df, t=_t: s.flagged_hits(df).where(t).select("seq", "path"),
        f"SELECT seq, path FROM hits WHERE {RULES[_t]}", True)
add("rule_counts_path_only", lambda df: s.rule_counts(df, scan_user_agent=False),
    "WITH " + FLAGS.replace(_PU + ",", "path,") + " " + " UNION ALL ".join(
        f"SELECT {text(t)} AS rule, count(*) FILTER ({t}) AS records FROM flags" for t in _names), True)
add("sensitive_file_types", s.sensitive_files, f"""SELECT CASE WHEN contains(lower(path), '.git') THEN '.git/'
    WHEN contains(lower(path), '.env') THEN '.env' WHEN contains(lower(path), 'wp-config') THEN 'wp-config.php'
    WHEN contains(lower(path), 'backup.sql') OR contains(lower(path), 'dump.sql') THEN 'database_backups'
    WHEN contains(lower(path), '.bak') OR contains(lower(path), '.old') THEN 'backup_files' ELSE 'other_sensitive' END AS file_type,
    count(*) AS count FROM hits WHERE {RULES["sensitive_files"]} GROUP BY 1 ORDER BY count DESC, file_type LIMIT 10""")
add("web_shell_labels", s.web_shells, f"""SELECT coalesce(nullif(regexp_extract(lower({_PU}), 'c99'), ''),
    nullif(regexp_extract(lower({_PU}), 'r57'), ''), nullif(regexp_extract(lower({_PU}), 'wso'), ''),
    nullif(regexp_extract(lower({_PU}), 'b374k'), ''),
    CASE WHEN regexp_matches(lower({_PU}), '(eval|base64_decode)[(]') THEN 'php_backdoor' ELSE 'generic' END) AS shell_type,
    count(*) AS count FROM hits WHERE {RULES["web_shell"]} GROUP BY 1""")
add("anomalous_methods", s.anomalous_methods, f"SELECT method, count(*) AS count FROM hits WHERE {RULES['http_method_anomaly']} GROUP BY method")
add("user_agent_threats", lambda df: df.groupBy(F.coalesce(at.agent_threat(F.col("user_agent")), F.lit("none")).alias("kind")).agg(
        F.count("*").alias("count")),
    f"""SELECT CASE WHEN {RULES["empty_ua"]} THEN 'empty' WHEN {RULES["malicious_ua"]} THEN 'malicious' ELSE 'none' END AS kind,
    count(*) AS count FROM hits GROUP BY 1""")
add("platform_threats", s.platform_threats, """WITH p AS (SELECT lower(path) AS p, status FROM hits), c AS (
    SELECT 'wordpress_brute_force' AS threat, count(*) FILTER (contains(p, 'wp-login') AND status = 401) AS count FROM p
    UNION ALL SELECT 'wordpress_unauthorized', count(*) FILTER (contains(p, 'wp-admin') AND status = 403) FROM p
    UNION ALL SELECT 'wordpress_xmlrpc_abuse', count(*) FILTER (contains(p, 'xmlrpc.php') AND (contains(p, 'wp-') OR contains(p, 'wordpress'))) FROM p
    UNION ALL SELECT 'magento_admin_brute_force', count(*) FILTER (contains(p, '/admin') AND status = 401) FROM p
    UNION ALL SELECT 'shopware_admin_brute_force', count(*) FILTER (contains(p, '/backend') AND status = 401) FROM p
    UNION ALL SELECT 'admin_path_probe', count(*) FILTER (status >= 400 AND contains(p, a)) FROM p, (SELECT unnest([""" + ", ".join(
        text(a) for a in ADMIN_PATHS) + """]) AS a)) SELECT * FROM c WHERE count > 0""")
for _t, _f in (("sql_injection", at.detect_sql_injection), ("xss", at.detect_xss),
               ("directory_traversal", at.detect_directory_traversal), ("command_injection", at.detect_command_injection)):
    add(f"detect_{_t}", lambda df, f=_f: df.where(f(F.col("path"))).select("seq", "path"),
        f"SELECT seq, path FROM hits WHERE {pattern_sql(_t, 'path')}")

EVENTS = f"""(SELECT seq, ts, ip, country, path, unnest(list_concat({", ".join(
    f"CASE WHEN {t} THEN [{text(t)}] ELSE [] END" for t in at.CORE)})) AS threat_type FROM flags)"""
_SEVERITY = "CASE WHEN threat_type IN ('xss', 'directory_traversal') THEN 'high' ELSE 'critical' END"
add("threat_events", lambda df: s.threat_events(df).drop("position"), f"""WITH {FLAGS}
    SELECT seq, ts, ip, threat_type, path, country, {_SEVERITY} AS severity, CASE threat_type
    WHEN 'sql_injection' THEN 'SQL injection attempt detected in request' WHEN 'xss' THEN 'Cross-site scripting (XSS) attempt detected'
    WHEN 'directory_traversal' THEN 'Directory traversal attempt detected' WHEN 'command_injection' THEN 'Command injection attempt detected'
    ELSE 'File inclusion attempt detected' END || ': ' || path AS description FROM {EVENTS}""", True)

# Per address --------------------------------------------------------------------
_COLUMNS = ("ip", "country", "request_count", "error_count", "first_seen", "last_seen", "core_hits", "empty_ua", *at.ATTACK_TYPES,
            "attack_type_count")
add("ip_profile", lambda df: s.ip_profile(df).select(*_COLUMNS, "duration", "threat_score"),
    PROFILE + f" SELECT {', '.join(_COLUMNS)}, {r('duration')} AS duration, {r('threat_score')} AS threat_score FROM profile", True)
# A small chunk size makes every address span many chunks.
add("ip_profile_chunked", lambda df: s.ip_profile(df, chunk_rows=500).select(*_COLUMNS),
    PROFILE + f" SELECT {', '.join(_COLUMNS)} FROM profile", True)
add("scanning", lambda df: once_per_ip.scanning(df, stored(s.ip_profile(df), "profile")),
    PROFILE + " SELECT ip, scanning_seq FROM profile WHERE scanning = 1", True)
#: Stretches of the log that arrive one after the other; the rules with running totals go on from one to the next.
_STRETCHES = 3


def _by_stretches(df):
    spark, before = df.sparkSession, None
    last = df.agg(F.max("seq")).first()[0]
    for k in range(_STRETCHES):
        part = df.where((F.col("seq") * _STRETCHES > k * last) & (F.col("seq") * _STRETCHES <= (k + 1) * last) | (F.lit(k) == 0) & (F.col("seq") <= 0))
        target = shared_folder(spark, "profile")
        state = advance_profile(spark, before, part, target, chunk_rows=2_000)
        before = target
    return s.profile_of(state).select(*_COLUMNS, "duration", "threat_score")


add("ip_profile_by_day", _by_stretches,
    PROFILE + f" SELECT {', '.join(_COLUMNS)}, {r('duration')} AS duration, {r('threat_score')} AS threat_score FROM profile", True)
add("scanning_error_ratio", lambda df: s.ip_profile(df).where("error_ratio_seq IS NOT NULL").select("ip", "error_ratio_seq"),
    PROFILE + " SELECT ip, error_ratio_seq FROM profile WHERE error_ratio_seq IS NOT NULL", True)
add("credential_stuffing", lambda df: once_per_ip.credential_stuffing(s.flagged_hits(df)),
    PROFILE + " SELECT ip, credential_seq FROM cred", True)
add("api_abuse", lambda df: s.ip_profile(df).where("api_abuse = 1").select("ip", "api_abuse_seq"),
    PROFILE + " SELECT ip, api_abuse_seq FROM abuse", True)
_ADVICE = """CASE WHEN threat_score >= 80 THEN 'BLOCK IMMEDIATELY - Critical threat detected'
    WHEN threat_score >= 60 THEN 'Consider blocking - High threat level' WHEN threat_score >= 40 THEN 'Monitor closely - Moderate threat level'
    WHEN threat_score >= 20 THEN 'Watch for patterns - Low threat level' ELSE 'Continue monitoring' END"""
_LEVEL = "CASE WHEN threat_score >= 70 THEN 'CRITICAL' WHEN threat_score >= 50 THEN 'HIGH' WHEN threat_score >= 30 THEN 'MEDIUM' ELSE 'LOW' END"
add("threat_score", lambda df: s.ip_profile(df).select("ip", "threat_score"),
    PROFILE + f" SELECT ip, {r('threat_score')} AS threat_score FROM profile", True)
add("recommendation", lambda df: s.ip_profile(df).select("ip", s.recommendation(F.col("threat_score")).alias("recommendation")),
    PROFILE + f" SELECT ip, {_ADVICE} AS recommendation FROM profile", True)
add("threat_level", lambda df: s.ip_profile(df).select("ip", s.threat_level(F.col("threat_score")).alias("threat_level")),
    PROFILE + f" SELECT ip, {_LEVEL} AS threat_level FROM profile", True)


def _everyone(df):
    """All suspicious addresses; only the lists that are a top list by name are limited."""
    return s.suspicious_ips(s.ip_profile(df), None)


add("suspicious_ips", lambda df: s.suspicious_ips(s.ip_profile(df)).select(
        "ip", "country", "threat_score", "request_count", "error_count", "first_seen", "last_seen", "threat_count",
        "total_attacks", "recommendation", "threat_level"),
    SUSPICIOUS + f""" SELECT ip, country, {r("threat_score")} AS threat_score, request_count, error_count, first_seen, last_seen,
    threat_count, total_attacks, {_ADVICE} AS recommendation, {_LEVEL} AS threat_level FROM top""", True)
add("attack_patterns", lambda df: s.attack_patterns(_everyone(df)),
    EVERYONE + " SELECT ip, attack_type, count FROM (UNPIVOT (SELECT ip, " + ", ".join(at.ATTACK_TYPES) + " FROM suspicious) ON "
    + ", ".join(at.ATTACK_TYPES) + " INTO NAME attack_type VALUE count) WHERE count > 0", True)
_THREATS = f"""threats AS (SELECT ip, string_agg(threat_type, ', ' ORDER BY seq, position) AS threats FROM (
    SELECT ip, seq, threat_type, list_position([{", ".join(text(t) for t in at.CORE)}], threat_type) AS position FROM {EVENTS}) GROUP BY ip),
named AS (SELECT suspicious.*, coalesce(threats, '') AS threats FROM suspicious LEFT JOIN threats USING (ip))"""


def _short(column: str, limit: int) -> str:
    return f"CASE WHEN length({column}) <= {limit} THEN {column} ELSE left({column}, {limit - 3}) || '...' END"


add("suspicious_threats", lambda df: s.suspicious_threats(df, _everyone(df)).drop("position"), EVERYONE + f"""
    SELECT ip, seq, threat_type FROM {EVENTS} WHERE ip IN (SELECT ip FROM suspicious)""", True)
add("abusive_ips", lambda df: s.abusive_ips(df, _everyone(df)), EVERYONE + f""", {_THREATS}
    SELECT ip, {r("threat_score")} AS threat_score, request_count, {r("error_pct")} AS error_percentage,
    {_short("CASE threats WHEN '' THEN 'High Error Rate' ELSE threats END", 30)} AS attack_types, brute_force AS failed_logins
    FROM named ORDER BY request_count DESC, ip LIMIT 15""", True)
add("threat_ip_table", lambda df: s.threat_ip_table(_everyone(df)), EVERYONE + f""" SELECT ip, {r("threat_score")} AS threat_score, request_count,
    {r("error_pct")} AS error_percentage, brute_force AS failed_logins, total_attacks FROM suspicious WHERE threat_score >= 10
    ORDER BY threat_score DESC, ip LIMIT 10""", True)
_DENY = {
    "critical": ("threat_score >= 70", f"printf('deny %s;  # Score: %.1f, Requests: %s, Error: %.0f%%, Attacks: %s', ip, threat_score, format('{{:,}}', request_count), error_pct, {_short('threats', 40)})"),
    "all": ("true", "printf('deny %s;  # Score: %.1f, Requests: %s, Error: %.0f%%, %s', ip, threat_score, format('{:,}', request_count), error_pct, "
            + _short("(CASE WHEN threats <> '' THEN threats WHEN error_pct >= 80 THEN 'High error rate' ELSE '' END)", 40) + ")"),
    "error100": ("error_pct >= 100", f"printf('deny %s;  # Requests: %s, Score: %.1f, %s', ip, format('{{:,}}', request_count), threat_score, {_short('threats', 40)})"),
}
for _option, (_where, _line) in _DENY.items():
    add("block_list" if _option == "critical" else f"block_list_{_option}", lambda df, o=_option: s.block_list(s.with_threat_text(df, _everyone(df)), o), EVERYONE + f""", {_THREATS}
        SELECT request_count, ip, {_line} AS line FROM named WHERE {_where}""", True)

# The same log with few, very busy addresses, some of which only fail: the rules on rates and on errors alone fire.
_BUSY_IP = "CASE WHEN status >= 400 AND seq % 2 = 0 THEN '198.51.100.' ELSE '203.0.113.' END || CAST(seq % 5 AS {string})"


def _busy(df):
    return df.withColumns({"ts": F.timestamp_micros(F.expr("unix_micros(cast(ts AS timestamp)) div 100000")).cast("timestamp_ntz"),
                           "ip": F.expr(_BUSY_IP.format(string="STRING"))})


def _add_busy(name, build, sql):
    add(name, lambda df: build(_busy(df)), "", True)
    calm = f"calm AS ({hits_oracle(True)}), hits AS (SELECT * REPLACE (make_timestamp(epoch_us(ts) // 100000) AS ts, {_BUSY_IP.format(string='VARCHAR')} AS ip) FROM calm)"
    ORACLES[name] = f"WITH {calm}, {sql.strip()[5:].lstrip()}"


_add_busy("api_abuse_busy", lambda df: s.ip_profile(df, chunk_rows=300).where("api_abuse = 1").select("ip", "api_abuse_seq"), PROFILE + " SELECT ip, api_abuse_seq FROM abuse")
_add_busy("block_list_error100_busy", lambda df: s.block_list(s.with_threat_text(df, _everyone(df)), "error100"), EVERYONE + f""", {_THREATS}
    SELECT request_count, ip, {_DENY["error100"][1]} AS line FROM named WHERE {_DENY["error100"][0]}""")
_add_busy("threat_score_busy", lambda df: s.ip_profile(df).select("ip", "threat_score"), PROFILE + f" SELECT ip, {r('threat_score')} AS threat_score FROM profile")

# Summaries ------------------------------------------------------------------------
_SUMS = ", ".join(f"sum({t})::BIGINT AS {t}" for t in at.ATTACK_TYPES)
_TOTAL = "sum(core_hits + " + " + ".join((*at.EXTENDED, "credential_stuffing", "api_abuse")) + ")::BIGINT"
add("security_summary", lambda df: s.security_summary(s.ip_profile(df)), PROFILE + f""" SELECT sum(request_count)::BIGINT AS total_requests,
    sum(error_count)::BIGINT AS total_errors, count(*) AS unique_ips, {r("sum(error_count) * 100.0 / sum(request_count)")} AS error_percentage,
    {_TOTAL} AS total_threats, {_SUMS}, sum(empty_ua)::BIGINT AS empty_ua, sum(malicious_ua + empty_ua)::BIGINT AS suspicious_user_agents
    FROM profile""", True)
add("error_totals", lambda df: s.security_summary(s.ip_profile(df)).select("total_requests", "total_errors", "error_percentage"),
    f"""SELECT count(*) AS total_requests, count(*) FILTER (status >= 400) AS total_errors,
    {r("count(*) FILTER (status >= 400) * 100.0 / count(*)")} AS error_percentage FROM hits""")
add("unique_attack_types", lambda df: s.unique_attack_types(s.ip_profile(df)), PROFILE + """ SELECT ((sum(sql_injection) > 0)::INTEGER
    + (sum(xss) > 0)::INTEGER + (sum(directory_traversal) > 0)::INTEGER + (sum(command_injection) > 0)::INTEGER
    + (sum(brute_force) > 0)::INTEGER + (sum(scanning) > 0)::INTEGER)::INTEGER AS unique_attack_types FROM profile""", True)
add("ip_categories", lambda df: s.ip_categories(s.ip_profile(df)), PROFILE + """ SELECT count(*) FILTER (threat_score >= 30) AS suspicious_ips,
    count(*) FILTER (request_count > 500 OR (duration > 0 AND request_count / duration > 10)) AS potential_ddos_ips,
    count(*) FILTER (error_count / request_count > 0.8 OR attack_type_count >= 3) AS scanning_ips,
    count(*) FILTER (brute_force > 0) AS admin_access_ips FROM profile""", True)
_five = ("brute_force", "sql_injection", "xss", "directory_traversal", "command_injection")
add("attack_categories", lambda df: s.attack_categories(s.ip_profile(df)), PROFILE + " " + " UNION ALL ".join(
    f"SELECT {text(ATTACK_LABELS[t])} AS category, count(*) FILTER ({t} > 0) AS unique_ips, sum({t})::BIGINT AS attempts FROM profile" for t in _five), True)
add("top_attack_types", lambda df: s.top_attack_types(s.ip_profile(df)), PROFILE + " SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT {text(v)} AS attack_type, sum({t})::BIGINT AS attempts, count(*) FILTER ({t} > 0) AS unique_ips FROM profile"
    for t, v in ATTACK_LABELS.items()) + ") WHERE attempts > 0", True)
add("extended_attack_table", lambda df: s.extended_attack_table(s.ip_profile(df)), PROFILE + " SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT {text(v)} AS category, sum({t})::BIGINT AS attempts, {text(sev)} AS severity FROM profile"
    for t, (v, sev) in EXTENDED_ATTACK_LABELS.items()) + ") WHERE attempts > 0", True)
add("security_recommendations", lambda df: s.security_recommendations(_everyone(df)), EVERYONE + """, found AS (
    SELECT bool_or(request_count > 500) AS a, bool_or(threat_score >= 70) AS b, bool_or(brute_force > 0) AS c, bool_or(error_pct > 80) AS d FROM suspicious)
    SELECT 1 AS position, 'ddos' AS topic, 'Consider implementing rate limiting for IPs with high request rates' AS advice FROM found WHERE a
    UNION ALL SELECT 2, 'high_threat', 'Review and consider blocking suspicious IPs with threat scores >= 70' FROM found WHERE b
    UNION ALL SELECT 3, 'brute_force', 'Implement account lockout policies after failed login attempts' FROM found WHERE c
    UNION ALL SELECT 4, 'scanning', 'Monitor scanning behavior from IPs with high error rates' FROM found WHERE d
    UNION ALL SELECT 5, 'none', 'Continue monitoring for suspicious activity' FROM found WHERE NOT (a OR b OR c OR d)""", True)
