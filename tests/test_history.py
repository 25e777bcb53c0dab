"""The profile from stored states, part by part, and look-ups that no busy key slows down."""

import random

import pytest
from pyspark.sql import functions as F

from hitscope.operators import once_per_ip, security, traffic
from hitscope.plans import keys
from hitscope.plans.history import advance_profile

PATHS = ["/", "/x", "/login", "/api/a", "/api/b", "/admin", "/a/../b", "/?q=union", "/.env", "/c99.php", "/{{x}}", "/graphql", "/graphql?introspection", "/rest/1;x"]


def random_log(seed, n=900):
    rnd, at, rows = random.Random(seed), 0.0, []
    for i in range(n):
        at += rnd.choice([0, 0.01, 0.05, 0.2, 5])
        if i % 110 == 0:
            rows.append({"at": at, "ip": "7.7.7.7", "path": "/login", "status": 401})
        ip = "9.9.9.9" if rnd.random() < 0.34 else f"1.1.1.{rnd.randrange(25)}"
        rows.append({"at": at, "ip": ip, "path": rnd.choices(PATHS, [8, 8, 2, 12, 12] + [1] * 9)[0], "status": rnd.choices([200, 401, 404], [5, 4, 2])[0],
                     "user_agent": rnd.choices(["x", "sqlmap", "", "a;b"], [20, 1, 1, 1])[0]})
    # fire over the border of two parts: only errors, and a quick run of API requests
    rows += [{"at": at + i, "ip": "5.5.5.5", "status": 404} for i in range(9)] + [{"at": at + 10 + i / 50, "ip": "6.6.6.6", "path": "/api/z"} for i in range(90)]
    rows += [{"at": at + 20 + i, "ip": "5.5.5.5", "status": 404} for i in range(9)] + [{"at": at + 12 + i / 50, "ip": "6.6.6.6", "path": "/api/z"} for i in range(90)]
    return rows


@pytest.mark.parametrize("cuts", [(999,), (300, 600, 950, 999, 1_040)])
def test_parts_merge_to_the_whole(spark, log, tmp_path, cuts):
    df = log(random_log(3)).cache()
    before, low = None, -1
    for k, high in enumerate((*cuts, 10**9)):
        part = df.where((F.col("seq") > low) & (F.col("seq") <= high))
        state = advance_profile(spark, before, part, str(tmp_path / f"state-{k}"), chunk_rows=50)
        before, low = str(tmp_path / f"state-{k}"), high
    got, want = security.profile_of(state), security.ip_profile(df)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    rules = {r.ip: (r.error_ratio_seq, r.api_abuse_seq) for r in got.collect()}
    assert rules["5.5.5.5"][0] is not None and rules["6.6.6.6"][1] is not None
    assert {r.ip for r in got.where("credential_seq IS NOT NULL").collect()} >= {"7.7.7.7"}
    # whatever an address did, its state is one row with at most six logins
    assert state.count() == want.count() and state.agg(F.max(F.size("logins"))).first()[0] == 6


def test_an_empty_day_changes_nothing(spark, log, tmp_path):
    df = log(random_log(4, 60))
    state = advance_profile(spark, None, df, str(tmp_path / "a"))
    after = advance_profile(spark, str(tmp_path / "a"), df.where("false"), str(tmp_path / "b"))
    assert sorted(map(str, after.collect())) == sorted(map(str, state.collect()))


@pytest.mark.parametrize("chunk_rows", [7, 10**6])
def test_scanning_by_chunks(log, chunk_rows):
    df = log(random_log(5))
    flagged = df.select("ip", "seq")
    profile = security.ip_profile(df).cache()
    late = {r.ip: r.third_type.seq for r in profile.where("is_scanning AND third_type.after = 1").collect()}
    assert len(late) > 3
    seqs = {}
    for r in flagged.collect():
        seqs.setdefault(r.ip, []).append(r.seq)
    scans = {r.ip: r.scanning_seq for r in once_per_ip.scanning(flagged, profile, chunk_rows=chunk_rows).collect()}
    ratio = {r.ip: r.error_ratio_seq for r in profile.collect()}
    for ip, seq in late.items():
        following = min(s for s in seqs[ip] if s > seq)
        assert scans[ip] == (following if ratio[ip] is None else min(following, ratio[ip]))


@pytest.mark.parametrize("most", [0, 100_000])
def test_rows_of_counted_keys(log, monkeypatch, most):
    monkeypatch.setattr(keys, "COUNTED_KEYS", most)
    df = log([{"ip": "1.1.1.1"}] * 50 + [{"ip": "2.2.2.2"}] * 9 + [{"ip": "3.3.3.3", "country": "DE"}])
    chosen = df.where("ip != '2.2.2.2'").select("ip", F.lit(1).alias("seq"))
    rows = keys.restrict_counted(df, chosen, "ip", "seq")
    assert rows.columns == df.columns and {r["ip"]: r["count"] for r in rows.groupBy("ip").count().collect()} == {"1.1.1.1": 50, "3.3.3.3": 1}
    best = {(r.country, r.ip, r["count"], r["rank"]) for r in traffic.ips_per_country(df, 1).collect()}
    assert best == {("NL", "1.1.1.1", 50, 1), ("DE", "3.3.3.3", 1, 1)}
