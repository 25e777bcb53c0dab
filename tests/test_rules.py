import re

import pytest
from pyspark.sql import functions as F

from hitscope.functions import attacks as at
from hitscope.functions.fixed_values import ATTACK_PATTERNS

# Per pattern: hits, then misses.
CASES = {
    "sql_injection": (["/?q=UNION", "/selection", "/JavaScript"], ["/", "/product/1"]),
    "xss": (["/<SCRIPT>", "/?a=onclick=1", "javascript:x", "<embed"], ["/online", "on =1"]),
    "directory_traversal": (["/../x", "..%2Fx", "..%2fx", "..\\x"], ["/..", "..%5c"]),
    "command_injection": (["a;b", "a|b", "a&&b", "$(x)", "`x`"], ["a&b", "$x"]),
    "file_inclusion": (["FILE://x", "php://input", "data:text"], ["file:/x", "dat:"]),
    "sensitive_files": (["/.git/x", "/.ENV", "/wp-config.php", "/a.bak", "/phpinfo.php", "/package.json"], ["/.gitx", "/env"]),
    "web_shell": (["/C99.php", "eval(1)", "system(x)", "/wso"], ["evaluate", "systems"]),
    "log4shell": (["${jndi:ldap://x}", "${JNDI:dns:"], ["${jndi:http:", "jndi:ldap:"]),
    "ssrf": (["127.0.0.1", "LOCALHOST", "/v10.2", "172.16.0.1", "169.254.169.254", "dict://"], ["172.15.0.1", "192.169.1.1"]),
    "open_redirect": (["/?url=http://x", "/?a=1&NEXT=https://x"], ["/?url=/x", "/url=http://x"]),
    "xxe": (["<!entity", "<!DOCTYPE", 'SYSTEM "x', "public\t'"], ["SYSTEM", "SYSTEM x"]),
    "crlf_injection": (["%0d%0a", "%0D%0A", "\\r\\n", "%00"], ["%0d%0A", "\r\n"]),
    "template_injection": (["{{x", "{%", "<%", "${x", "#set(", "[#assign"], ["{x}", "#sets"]),
    "nosql_injection": (["[$NE]", "[$gt]", "[$where]", "$where:"], ["$ne", "[ne]"]),
    "prototype_pollution": (["__PROTO__", "constructor.prototype", "prototype.x"], ["_proto_", "prototypes"]),
    "path_traversal_ext": (["%2e%2e/", "%252e%252e/", "..%c0%af", "..\\x", "%5c..%5c"], ["%2E%2E/", "../"]),
}


@pytest.mark.parametrize("name", ATTACK_PATTERNS)
def test_pattern(spark, name):
    hits, misses = CASES[name]
    df = spark.createDataFrame([(t, True) for t in hits] + [(t, False) for t in misses], "t string, want boolean")
    wrong = df.where(at.detect(name, F.col("t")) != F.col("want")).collect()
    assert not wrong


def test_lookahead_changes_nothing(spark):
    """The first-character shortcut against the bare pattern, on mixed-case fragments."""
    pieces = [t for hits, misses in CASES.values() for t in (*hits, *misses)]
    texts = [a + b for a in pieces for b in ("", "Z", pieces[len(a) % len(pieces)])] + [t.upper() for t in pieces] + [t.swapcase() for t in pieces]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    cols = [at.detect(n, F.col("t")).alias(n) for n in ATTACK_PATTERNS]
    for row in df.select("t", *cols).collect():
        for name, pattern in ATTACK_PATTERNS.items():
            assert row[name] == bool(re.search(pattern, row.t, re.ASCII)), (name, row.t)


def test_labels(log):
    rows = [{"path": p} for p in ("/.git/x", "/.env", "/wp-config.php", "/backup.sql", "/a.bak", "/.htaccess")]
    got = [r[0] for r in log(rows).orderBy("seq").select(at.sensitive_file_label(F.col("path"))).collect()]
    assert got == [".git/", ".env", "wp-config.php", "database_backups", "backup_files", "other_sensitive"]
    shells = ["/c99", "/r57", "/wso", "/b374k", "eval(", "p0wny"]
    got = [r[0] for r in log([{"path": p} for p in shells]).orderBy("seq").select(at.web_shell_label(F.col("path"))).collect()]
    assert got == ["c99", "r57", "wso", "b374k", "php_backdoor", "generic"]


def test_platform_rules_count_every_admin_path(log):
    from hitscope.operators.security import platform_threats
    rows = [{"path": "/administrator", "status": 404}, {"path": "/wp-login.php", "status": 401}, {"path": "/xmlrpc.php"},
            {"path": "/wp-x/xmlrpc.php"}, {"path": "/backend", "status": 401}]
    got = {r.threat: r["count"] for r in platform_threats(log(rows)).collect()}
    assert got == {"admin_path_probe": 4, "wordpress_brute_force": 1, "wordpress_xmlrpc_abuse": 1, "shopware_admin_brute_force": 1}
