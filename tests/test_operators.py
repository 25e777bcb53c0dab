import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitscope.functions.user_agents import bot_category, legitimacy_score, parse_user_agent
from hitscope.operators import anomaly, api_usage, bots, commerce, content, performance, security, timeline, traffic
from hitscope.plans.percentiles import exact_percentiles
from hitscope.plans.reports import kept, security_report, traffic_report


@pytest.mark.parametrize("seed", range(3))
def test_percentiles_are_exact(spark, seed):
    rnd = random.Random(seed)
    rows = [(("hot" if rnd.random() < 0.5 else f"k{rnd.randrange(40)}"),
             rnd.choice([0.0, -1.5, round(rnd.random(), 2), rnd.lognormvariate(0, 3)])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = {r.k: r for r in exact_percentiles(df, ["k"], "v", probs).collect()}
    for key in {k for k, _ in rows}:
        values = [v for k, v in rows if k == key]
        for name, p in probs.items():
            assert got[key][name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)
    whole = exact_percentiles(df, [], "v", probs).first()
    assert whole.p95 == pytest.approx(np.quantile([v for _, v in rows], 0.95))


def test_empty_input(log):
    none = log([{}]).where("false")
    s = traffic.traffic_summary(none).first()
    assert (s.total_requests, s.unique_ips, s.error_rate, s.p95_response_time, s.start_time) == (0, 0, 0.0, 0.0, None)
    assert traffic.traffic_rates(none).first().requests_per_hour is None
    assert security.security_summary(security.ip_profile(none)).first().total_threats == 0
    assert content.seo_issues(none).count() == 0 and commerce.funnel(none).first().drop_off_rate == 0.0
    assert [r.topic for r in security.security_recommendations(security.suspicious_ips(security.ip_profile(none))).collect()] == ["none"]


def test_sketches_are_near(log):
    df = log([{"ip": f"1.1.{i % 40}.{i % 7}", "response_time": i / 100, "status": 500 if i % 4 == 0 else 200} for i in range(600)])
    exact, near = traffic.traffic_summary(df).first(), traffic.traffic_summary(df, approx=True).first()
    assert near.asDict().keys() == exact.asDict().keys()
    for name in ("unique_ips", "median_response_time", "p95_response_time", "p99_response_time"):
        assert near[name] == pytest.approx(exact[name], rel=0.1)
    assert (near.total_requests, near.error_rate, near.total_bytes) == (exact.total_requests, exact.error_rate, exact.total_bytes)
    assert traffic.response_time_stats(df, approx=True).first().p95 == pytest.approx(5.7, rel=0.1)


def test_first_record_rules_follow_arrival_not_time(log):
    df = log([{"at": 100, "country": "NL", "user_agent": "x"}, {"at": 0, "country": "DE", "user_agent": "bot"}, {"at": 40, "country": "FR"}])
    r = traffic.top_ips(df).first()
    assert (r.country, r.is_bot, r.first_seen.second, r.last_seen.second, r.avg_interval) == ("NL", False, 40, 40, -30.0)


def test_ties_break_by_key(log):
    df = log([{"path": p, "handler": h} for p, h in (("/b", "z"), ("/a", "y"), ("/b", "a"), ("/a", ""))])
    assert [r.path for r in traffic.top_paths(df, 1).collect()] == ["/a"]
    assert {r.path: r.handler for r in traffic.path_handler(df).collect()} == {"/a": "y", "/b": "a"}


def test_bot_behavior(log):
    fast = [{"user_agent": "fast-bot", "at": i * 5 / 99} for i in range(100)]
    calm = [{"user_agent": "calm-bot", "at": i * 60 / 99} for i in range(100)]
    wide = [{"user_agent": "wide-bot", "at": i * 10, "path": f"/{i}"} for i in range(101)]
    some = [{"user_agent": "some-bot", "at": i * 10, "path": f"/{i}"} for i in range(11)]
    got = {r.user_agent: r.behavior_type for r in bots.bot_behavior(bots.bot_profile(log(fast + calm + wide + some + [{"user_agent": "one-bot"}]))).collect()}
    assert got == {"fast-bot": "aggressive", "calm-bot": "moderate", "wide-bot": "comprehensive", "some-bot": "targeted", "one-bot": "light"}


def test_user_agents(spark):
    cases = {
        "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36": ("Chrome 120.0.0.0", "Windows 10", "Desktop"),
        "Mozilla/5.0 (Windows NT 10.0) AppleWebKit/537.36 Chrome/120.0 Safari/537.36 Edg/120.0.1": ("Edge 120.0.1", "Windows 10", "Desktop"),
        "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) Version/17.0 Mobile/15E Safari/604.1": ("Safari 17.0", "iOS", "Mobile"),
        "Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0": ("Firefox 121.0", "Linux", "Desktop"),
        "curl/8.0": ("curl 8.0", "", "Bot"), "-": ("Unknown", "Unknown", "Unknown"), "": ("Unknown", "Unknown", "Unknown"),
    }
    got = spark.createDataFrame([(a,) for a in cases], "a string").select("a", parse_user_agent(F.col("a")).alias("u")).collect()
    assert {r.a: tuple(r.u) for r in got} == cases
    scored = spark.createDataFrame([("Googlebot (compatible; http://x)" + "y" * 80,), ("nope",), ("curl/1",)], "a string")
    assert [r[0] for r in scored.select(legitimacy_score(F.col("a"), bot_category(F.col("a")))).collect()] == [100.0, 30.0, 40.0]


def test_cache_and_advice(log):
    varnish = [{"handler": "varnish", "status": 304, "response_time": 1.0}, {"handler": "varnish", "response_time": 0.009},
               {"handler": "varnish", "response_time": 0.010}, {"handler": "php", "response_time": 0.001}]
    got = {r.handler: (r.hits, r.misses) for r in performance.cache_stats(log(varnish)).collect()}
    assert got == {"varnish": (2, 1), "php": (0, 0)}
    slow = [{"handler": "varnish", "response_time": 4.0, "status": 500 if i % 5 == 0 else 200} for i in range(101)]
    kinds = [r.type for r in performance.perf_recommendations(log(slow)).collect()]
    assert kinds == ["response_time", "response_time_p95", "slow_endpoints", "cache_hit_rate", "handler_errors"]
    assert performance.perf_recommendations(log(slow[:10]).where("response_time < 1")).count() == 0
    assert performance.slow_endpoints(log(slow), 0).count() == 1


def test_shop_platform_follows_the_first_record(log):
    rows = [{"path": p} for p in ("/x", "/checkout/", "/graphql", "/store-api/x")]
    assert commerce.detect_shop_platform(log(rows)).first()[:] == ("magento", 1)
    shop = [{"path": p} for p in ("/store-api", "/store-api/x", "/graphql", "/catalogsearch/q", "/Basket", "/payment", "/search", "/my-order")]
    got = [r.category for r in commerce.categorize(log(shop)).orderBy("seq").collect()]
    # Before the first shop record a platform rule does not apply; Magento's API is none of Shopware's.
    assert got == [None, "api", None, "product", "cart", "checkout", "search", "order"]
    assert commerce.shop_graphql(log(rows)).first()["count"] == 1
    assert commerce.shop_graphql(log(shop)).count() == 0


def test_content(log):
    cases = {"/a.JPG": ".jpg", "/a.b/c": "", "/x.js?v=1.2": ".2", "/.env": ".env", "/a.": ".", "/a.tar.gz": ".gz", "/a.js?u=/b": ""}
    got = log([{"path": p} for p in cases]).select("path", content.extension(F.col("path")).alias("e")).collect()
    assert {r.path: r.e for r in got} == cases
    rows = [{"path": "/a.png", "bytes_sent": 512_001}, {"path": "/a.png", "bytes_sent": 512_000}, {"path": "/a.js", "bytes_sent": 600_000},
            {"path": "/none", "status": 404}, {"path": "/b.css", "status": 404, "response_time": 2.0}, {"path": "/b.css", "response_time": 2.01}]
    assert {r.type: r["count"] for r in content.seo_issues(log(rows)).collect()} == {"large_images": 1, "broken_links": 1, "slow_resources": 1}


def test_anomaly_bounds(log, spark):
    base = spark.createDataFrame([(10.0, 2.0, 0.5, 0.0, 1.0, 0.5)],
                                 "avg_requests double, stddev_requests double, avg_error_rate double, stddev_error_rate double, avg_response_time double, stddev_response_time double")
    sizes = {0: 16, 1: 17, 2: 18, 3: 20, 4: 4, 5: 3}
    rows = [{"at": m * 60 + i, "response_time": 1.0, "status": 500} for m, n in sizes.items() for i in range(n)]
    found = {r.bucket.minute: (r.type, r.severity) for r in anomaly.detect_anomalies(log(rows), base).collect()}
    assert found == {1: ("traffic_spike", "medium"), 2: ("traffic_spike", "high"), 3: ("traffic_spike", "critical"), 5: ("traffic_spike", "medium")}
    slow = log([{"at": 0, "response_time": 2.51}, {"at": 61, "response_time": -1.0}])
    assert [(r.type, r.severity) for r in anomaly.detect_anomalies(slow, base.withColumn("stddev_requests", F.lit(0.0))).collect()] == [("response_time", "medium")]


def test_api_platforms(spark):
    cases = {"/wp-json/x": "woocommerce", "/rest/V1/a": "magento", "/graphql": "generic", "/magento/graphql": "magento",
             "/shopware/api/x": "shopware", "/prestashop/api/": "prestashop", "/v1/x": "generic"}
    got = spark.createDataFrame([(p,) for p in cases], "p string").select("p", api_usage.api_platform(F.col("p")).alias("k")).collect()
    assert {r.p: r.k for r in got} == cases


def test_traffic_patterns(log):
    # 2024-01-01 is a Monday: four requests on it, eight on the Saturday.
    rows = [{"at": i} for i in range(4)] + [{"at": 5 * 86400 + 3600 + i // 4} for i in range(8)]
    r = timeline.traffic_patterns(log(rows)).first()
    assert (r.peak_hours, r.low_hours, r.weekend_weekday_ratio, r.peak_rps) == ("1,0", "0,1", 2.0, 4)
    assert timeline.peak_bucket(log(rows), "1 hour").first().bucket == dt.datetime(2024, 1, 6, 1)


def test_threat_text_is_cut_exactly(log):
    rows = [{"path": "/<script>"}] * 3 + [{"path": "/x"}]
    df = log(rows)
    suspicious = security.suspicious_ips(security.ip_profile(df), None)
    named = security.with_threat_text(df, suspicious)
    line = security.block_list(named, "all").first().line
    assert line.endswith("sql_injection, xss, sql_injection, xs...")
    assert security.abusive_ips(df, suspicious).first().attack_types == "sql_injection, xss, sql_inj..."


def test_report_bundles(log):
    rows = [{"ip": f"1.1.1.{i % 5}", "path": "/login" if i % 3 else "/?q=union", "status": 401 if i % 3 else 200} for i in range(60)]
    with kept(log(rows)) as hits, kept(security.ip_profile(hits)) as profile:
        found = security_report(hits, profile)
        assert found["summary"].first().brute_force == 40
        assert {k: v.count() for k, v in found.items()}["suspicious_ips"] == 5
        assert traffic_report(hits)["summary"].first().total_requests == 60
