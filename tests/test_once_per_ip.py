"""Order-dependent rules against a plain fold over the records."""

import random

import pytest
from pyspark.sql import functions as F

from hitscope.functions.attacks import CORE, EXTENDED, flag_attacks
from hitscope.operators import once_per_ip, security

FLAGS = (*CORE, "brute_force", *EXTENDED, "failed_login", "is_api_path", "introspection")


def fold(rows):
    """ip -> sequence numbers at which scanning, credential stuffing and API abuse are first found."""
    found = {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        s = found.setdefault(r["ip"], {"n": 0, "errors": 0, "api": 0, "types": set(), "logins": set(), "start": r["ts"]})
        s["n"] += 1
        s["errors"] += r["status"] >= 400
        s["api"] += r["is_api_path"]
        s["types"] |= {t for t in (*CORE, "brute_force") if r[t]}
        if "scanning" not in s and ((s["n"] > 10 and s["errors"] / s["n"] > 0.8) or len(s["types"]) >= 3):
            s["scanning"] = r["seq"]
        s["types"] |= {t for t in EXTENDED if r[t]}
        if r["failed_login"]:
            s["logins"].add(r["ts"])
            if len(s["logins"]) > 5 and "credential_stuffing" not in s:
                s["credential_stuffing"] = r["seq"]
                s["types"].add("credential_stuffing")
        since = (r["ts"] - s["start"]).total_seconds()
        fast = r["is_api_path"] and s["api"] > 100 and since > 0 and s["api"] / since > 5
        if (r["introspection"] or fast) and "api_abuse" not in s:
            s["api_abuse"] = r["seq"]
            s["types"].add("api_abuse")
    return found


def check(df, chunk_rows):
    flagged = flag_attacks(df)
    expected = fold([r.asDict() for r in flagged.select("seq", "ts", "ip", "status", *FLAGS).collect()])
    profile = security.ip_profile(df, chunk_rows=chunk_rows)
    got = {r.ip: r for r in profile.collect()}
    scans = {r.ip: r.scanning_seq for r in once_per_ip.scanning(flagged, profile).collect()}
    assert set(got) == set(expected)
    for ip, s in expected.items():
        assert scans.get(ip) == s.get("scanning"), ip
        assert got[ip].credential_seq == s.get("credential_stuffing"), ip
        assert got[ip].api_abuse_seq == s.get("api_abuse"), ip
        types = s["types"] | ({"scanning"} if "scanning" in s else set())
        assert got[ip].attack_type_count == len(types), ip
    return got


PATHS = ["/", "/x", "/login", "/api/a", "/api/b", "/admin", "/a/../b", "/?q=union", "/.env", "/c99.php", "/{{x}}", "/graphql",
         "/graphql?introspection", "/?a=$ne", "/rest/1;x"]


@pytest.mark.parametrize("seed", range(4))
def test_random_logs(log, seed):
    rnd = random.Random(seed)
    rows, at = [], 0.0
    for _ in range(1200):
        at += rnd.choice([0, 0.01, 0.05, 0.2, 5]) if seed % 2 else rnd.choice([-3, 0.02, 1, 30])
        # One address owns a third of the log.
        ip = "9.9.9.9" if rnd.random() < 0.34 else f"1.1.1.{rnd.randrange(25)}"
        weights = [8] * 2 + [2, 12, 12] + [1] * 10
        rows.append({"at": at, "ip": ip, "path": rnd.choices(PATHS, weights)[0],
                     "status": rnd.choices([200, 401, 404, 500], [5, 4, 2, 1])[0],
                     "user_agent": rnd.choices(["x", "sqlmap", "", "a;b"], [20, 1, 1, 1])[0],
                     "method": rnd.choices(["GET", "TRACE"], [60, 1])[0]})
    check(log(rows), chunk_rows=37)


def test_burst_api_with_shuffled_input(log):
    rows = [{"at": i * 0.1, "path": "/api/x"} for i in range(101)] + [{"ip": "2.2.2.2", "at": 50, "path": "/graphql?q=IntrospectionQuery"}]
    got = check(log(rows, 7), chunk_rows=10)
    assert got["1.1.1.1"].api_abuse == 1 and got["2.2.2.2"].api_abuse == 1
    slow = [{"at": i * 0.3, "path": "/api/x"} for i in range(150)]
    assert check(log(slow), chunk_rows=10)["1.1.1.1"].api_abuse == 0


def test_error_ratio_bounds(log):
    def errors(ip, bad, n):
        return [{"ip": ip, "status": 404 if i < bad else 200} for i in range(n)]

    got = check(log(errors("1.0.0.1", 9, 11) + errors("1.0.0.2", 8, 11) + errors("1.0.0.3", 10, 10)), 4)
    assert [got[f"1.0.0.{i}"].scanning for i in (1, 2, 3)] == [1, 0, 0]


def test_third_type_needs_a_later_record_if_found_late(log):
    first = [{"ip": "1.0.0.1", "path": "/?q=union"}, {"ip": "1.0.0.1", "path": "/x|y"}, {"ip": "1.0.0.1", "path": "/.env"}]
    more = [{**r, "ip": "1.0.0.2"} for r in first] + [{"ip": "1.0.0.2"}]
    got = check(log(first + more), 2)
    assert (got["1.0.0.1"].scanning, got["1.0.0.2"].scanning) == (0, 1)


def test_credential_stuffing_counts_distinct_times(log):
    def fails(ip, times):
        return [{"ip": ip, "path": "/login", "status": 401, "at": t} for t in times]

    got = check(log(fails("1.0.0.1", range(5)) + fails("1.0.0.2", range(6)) + fails("1.0.0.3", [1] * 6)), 3)
    assert [got[f"1.0.0.{i}"].credential_stuffing for i in (1, 2, 3)] == [0, 1, 0]


def test_request_floods(log):
    slow = [{"ip": "1.0.0.1", "at": i * 7.2} for i in range(501)]
    fast = [{"ip": "1.0.0.2", "at": i * 3 / 39} for i in range(40)]
    profile = security.ip_profile(log(slow + fast + [{"ip": "1.0.0.3"}]))
    assert security.ip_categories(profile).first().potential_ddos_ips == 2


def test_result_does_not_depend_on_partitioning(log):
    rnd = random.Random(5)
    rows = [{"ip": f"1.1.1.{rnd.randrange(4)}", "path": rnd.choice(PATHS), "status": rnd.choice([200, 401])} for _ in range(200)]
    a = security.ip_profile(log(rows, 1)).collect()
    b = security.ip_profile(log(rows, 9).orderBy(F.rand(3))).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_path_only_scan_leaves_browsers_alone(log):
    browser = {"user_agent": "Mozilla/5.0 (Windows NT 10.0; Win64; x64)"}
    df = log([browser])
    assert security.ip_profile(df).first().command_injection == 1
    assert security.ip_profile(df, scan_user_agent=False).first().command_injection == 0


def test_match_across_path_and_agent(log):
    rows = [{"ip": "1.0.0.1", "path": "/x?SYSTEM", "user_agent": '"quoted'}, {"ip": "1.0.0.2", "path": "/x?SYSTEM", "user_agent": "plain"}]
    got = {r.ip: r.xxe for r in security.ip_profile(log(rows)).collect()}
    assert got == {"1.0.0.1": 1, "1.0.0.2": 0}
