"""Reports on many days from rows kept by day, against the whole log."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from hitscope.plans.daily import ADDRESS_ERROR, RANK_ERROR, DailyTables, stretches
from hitscope.plans.percentiles import exact_percentiles

PROBS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
DAY = 86_400


def rows(seed, n=3_000, days=6):
    rnd = random.Random(seed)
    return [{"at": rnd.randrange(days * DAY), "ip": rnd.choice(["9.9.9.9", None, f"1.{rnd.randrange(9)}.1.{rnd.randrange(200)}"]),
             "country": rnd.choices(["NL", "DE", "", None], [8, 3, 1, 2])[0],
             "response_time": rnd.choice([None, 0.0, 0.25, rnd.random(), rnd.expovariate(0.2)])} for _ in range(n)]


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def close(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or math.isclose(x, y, rel_tol=1e-12) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("keys", [{}, {"country": "string"}])
def test_days_merge_to_the_whole(spark, log, tmp_path, keys):
    df = log(rows(4)).cache()
    tables = DailyTables(str(tmp_path / "daily"), keys)
    odd = F.dayofmonth("ts") % 2 == 1
    tables.add(df.where(~odd))
    tables.add(df.where(odd))
    tables.add(df.where(F.dayofmonth("ts") == 3))  # a day once more
    name = F.coalesce("country", F.lit("<none>")).alias("country")
    for first, last in ((None, None), (dt.date(2024, 1, 2), dt.date(2024, 1, 4))):
        part = df if first is None else df.where(F.to_date("ts").between(first, last))
        close(values(tables.unique_ips(spark, first, last)), values(part.groupBy(*keys).agg(F.countDistinct("ip"))))
        named = part.withColumn("country", name) if keys else part
        got = tables.percentiles(spark, PROBS, first, last)
        got = got.withColumn("country", name) if keys else got
        close(values(got), values(exact_percentiles(named, list(keys), "response_time", PROBS)))
        exact = {r[0] if keys else 0: r for r in part.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct("ip").alias("u"),
                                                                        F.sort_array(F.collect_list("response_time")).alias("t")).collect()}
        for row in tables.estimates(spark, PROBS, first, last).collect():
            want = exact[row[0] if keys else 0]
            assert row.requests == want.n
            assert abs(row.unique_ips - want.u) <= max(1, 3 * ADDRESS_ERROR * want.u)
            for p, q in PROBS.items():
                below, upto = sum(t < row[p] for t in want.t), sum(t <= row[p] for t in want.t)
                assert below - 2 * RANK_ERROR * len(want.t) - 1 <= q * len(want.t) <= upto + 2 * RANK_ERROR * len(want.t) + 1


def test_only_wanted_slices_are_read(spark, log, tmp_path):
    tables = DailyTables(str(tmp_path / "daily"))
    tables.add(log([{"response_time": math.exp(i / 100), "at": i} for i in range(2_000)]))
    plan = tables.percentiles(spark, PROBS)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(_slice" in plan and "Or(" in plan


def test_empty_days_and_times_all_null(spark, log, tmp_path):
    tables = DailyTables(str(tmp_path / "daily"), {"country": "string"})
    tables.add(log([{}]).where("false"))
    assert values(tables.unique_ips(spark)) == values(tables.percentiles(spark, PROBS)) == values(tables.estimates(spark, PROBS)) == []
    tables.add(log([{"response_time": 1.5}, {"response_time": 2.5}]))
    tables.add(log([{"response_time": None, "ip": None}]))  # replaces the day
    assert values(tables.unique_ips(spark)) == [("NL", 0)]
    assert values(tables.percentiles(spark, PROBS)) == []
    assert values(tables.estimates(spark, PROBS)) == [("NL", 1, 0, None, None, None)]


def test_whole_log_without_rows(spark, log, tmp_path):
    tables = DailyTables(str(tmp_path / "daily"))
    tables.add(log([{}]).where("false"))
    assert values(tables.unique_ips(spark)) == [(0,)]
    assert values(tables.estimates(spark, PROBS)) == [(0, 0, None, None, None)]
    assert values(tables.percentiles(spark, PROBS)) in ([], [(None, None, None)])


def test_stretches():
    assert stretches([]) == []
    assert stretches([5]) == [(5, 5)]
    assert stretches([1, 2, 3, 9, 10, 40], 2) == [(1, 10), (40, 40)]
    many = stretches(list(range(0, 900, 3)))
    assert len(many) == 16 and many[0][0] == 0 and many[-1][1] == 897
