"""Attack rules as Columns: one boolean per rule and record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .fixed_values import (
    ABUSE_API_WORDS, ADMIN_PATHS, ATTACK_PATTERNS, BRUTE_FORCE_WORDS, CREDENTIAL_WORDS,
    FAILED_LOGIN_STATUSES, SUSPICIOUS_METHODS,
)
from .text import contains_any
from .user_agents import agent_threat

CORE = ("sql_injection", "xss", "directory_traversal", "command_injection", "file_inclusion")
# Rules a record is tested for after the core rules, in the order of testing.
EXTENDED = (
    "sensitive_files", "web_shell", "log4shell", "malicious_ua", "http_method_anomaly", "ssrf",
    "path_traversal_ext", "open_redirect", "xxe", "crlf_injection", "template_injection",
    "nosql_injection", "prototype_pollution",
)
# Set at most once per address.
ONCE_PER_IP = ("scanning", "credential_stuffing", "api_abuse")
RECORD_TYPES = (*CORE, "brute_force", *EXTENDED)
ATTACK_TYPES = (*RECORD_TYPES, *ONCE_PER_IP)

# Which texts a rule reads besides the path.  No match can reach from one text
# into the next, except in the XXE rule, which allows white space.
READS_AGENT = (*CORE, "web_shell", "xxe")
READS_REFERER = ("ssrf",)
READS_BOTH = ("log4shell",)

# Characters a match of each pattern can start with.  Put in front as a
# look-ahead they let the regex engine skip most positions with one test.
_STARTS = {
    "sql_injection": "usidaej<",
    "xss": "<jo",
    "directory_traversal": ".",
    "command_injection": ";|&$`",
    "file_inclusion": "fped",
    "sensitive_files": ".wciabdpr",
    "web_shell": "crwbpes",
    "log4shell": "$",
    "ssrf": "1l0fdg",
    "open_redirect": "?&",
    "xxe": "<sp",
    "crlf_injection": "%\\",
    "template_injection": "{<$#[",
    "nosql_injection": "[$",
    "prototype_pollution": "_cp",
    "path_traversal_ext": "%.\\",
}


def _starts(name: str) -> str:
    letters = "".join(c + c.upper() if c.isalpha() else c if c.isdigit() else "\\" + c for c in _STARTS[name])
    return f"(?=[{letters}])"


def detect(name: str, text: Column) -> Column:
    """One pattern on one text."""
    return text.rlike(f"{_starts(name)}(?:{ATTACK_PATTERNS[name]})")


def detect_sql_injection(path: Column) -> Column:
    return detect("sql_injection", path)


def detect_xss(path: Column) -> Column:
    return detect("xss", path)


def detect_directory_traversal(path: Column) -> Column:
    return detect("directory_traversal", path)


def detect_command_injection(path: Column) -> Column:
    return detect("command_injection", path)


def is_failed_login(status: Column) -> Column:
    return status.isin(*FAILED_LOGIN_STATUSES)


def is_abuse_api_path(path: Column) -> Column:
    return contains_any(F.lower(path), ABUSE_API_WORDS)


def is_introspection(path: Column) -> Column:
    low = F.lower(path)
    return low.contains("/graphql") & low.contains("introspection")


def path_flags(df: DataFrame) -> dict[str, Column]:
    """Rule name -> what path, referer, method and status say."""
    path, status = F.col("path"), F.col("status")
    flags = {name: detect(name, path) for name in ATTACK_PATTERNS}
    if "referer" in df.columns:
        for name in (*READS_REFERER, *READS_BOTH):
            flags[name] = flags[name] | detect(name, F.col("referer"))
    low, failed = F.lower(path), is_failed_login(status)
    flags["http_method_anomaly"] = F.col("method").isin(*SUSPICIOUS_METHODS)
    flags["brute_force"] = failed & contains_any(low, BRUTE_FORCE_WORDS)
    flags |= sequence_flags()
    flags["introspection"] = is_introspection(path)
    return flags


def sequence_flags() -> dict[str, Column]:
    """What the once-per-address rules need to know of a record."""
    path = F.col("path")
    return {"failed_login": is_failed_login(F.col("status")) & contains_any(F.lower(path), CREDENTIAL_WORDS),
            "is_api_path": is_abuse_api_path(path)}


def agent_flags(agent: Column, scan_user_agent: bool = True) -> dict[str, Column]:
    """Rule name -> what the user agent alone says."""
    names = (*READS_AGENT, *READS_BOTH) if scan_user_agent else READS_BOTH
    flags = {name: detect(name, agent) for name in names}
    flags["malicious_ua"] = F.coalesce(agent_threat(agent) == "malicious", F.lit(False))
    flags["empty_ua"] = agent.isin("", "-")
    return flags


def xxe_tail(path: Column) -> Column:
    """The path ends in a keyword that a quote in the user agent would complete."""
    return path.rlike(r"(?i)(SYSTEM|PUBLIC)\s*$")


def xxe_head(agent: Column) -> Column:
    return agent.rlike(r"""^\s*["']""")


def record_flags(df: DataFrame, scan_user_agent: bool = True) -> dict[str, Column]:
    """Rule name -> boolean Column for the columns of ``df``.

    ``scan_user_agent=False`` tests core, web-shell and XXE rules on the path
    alone: browsers' user agents contain ``;``, which the command-injection
    rule takes for an attack.
    """
    agent = F.col("user_agent")
    flags = path_flags(df)
    for name, flag in agent_flags(agent, scan_user_agent).items():
        flags[name] = flags[name] | flag if name in flags else flag
    if scan_user_agent:
        flags["xxe"] = flags["xxe"] | (xxe_tail(F.col("path")) & xxe_head(agent))
    return flags


def flag_attacks(df: DataFrame, scan_user_agent: bool = True) -> DataFrame:
    """``df`` plus one boolean column per rule."""
    return df.withColumns(record_flags(df, scan_user_agent))


def sensitive_file_label(path: Column) -> Column:
    low = F.lower(path)
    return (F.when(low.contains(".git"), ".git/")
            .when(low.contains(".env"), ".env")
            .when(low.contains("wp-config"), "wp-config.php")
            .when(contains_any(low, ("backup.sql", "dump.sql")), "database_backups")
            .when(contains_any(low, (".bak", ".old")), "backup_files")
            .otherwise("other_sensitive"))


def web_shell_label(text: Column) -> Column:
    low = F.lower(text)
    return (F.when(low.contains("c99"), "c99").when(low.contains("r57"), "r57")
            .when(low.contains("wso"), "wso").when(low.contains("b374k"), "b374k")
            .when(contains_any(low, ("eval(", "base64_decode(")), "php_backdoor")
            .otherwise("generic"))


def platform_flags() -> dict[str, Column]:
    """Platform rule -> number of times a record counts for it."""
    low, status = F.lower("path"), F.col("status")

    def once(condition: Column) -> Column:
        return condition.cast("bigint")

    wordpress = contains_any(low, ("wp-", "wordpress"))
    admin_hits = sum((low.contains(p).cast("bigint") for p in ADMIN_PATHS), F.lit(0).cast("bigint"))
    return {
        "wordpress_brute_force": once(low.contains("wp-login") & (status == 401)),
        "wordpress_unauthorized": once(low.contains("wp-admin") & (status == 403)),
        "wordpress_xmlrpc_abuse": once(wordpress & low.contains("xmlrpc.php")),
        "magento_admin_brute_force": once(low.contains("/admin") & (status == 401)),
        "shopware_admin_brute_force": once(low.contains("/backend") & (status == 401)),
        "admin_path_probe": F.when(status >= 400, admin_hits).otherwise(0),
    }
