"""An address that owns more of a micro-batch than a process may hold."""

import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hitscope.functions.attacks import ATTACK_TYPES
from hitscope.operators import security
from hitscope.streaming import sinks, threats

PATHS = ["/", "/login", "/api/a", "/?q=union", "/.env", "/c99.php", "/{{x}}", "/graphql?introspection", "/rest/1;x"]
COLUMNS = ["ip", "country", "request_count", "error_count", "core_hits", "first_seen", "last_seen", *ATTACK_TYPES, "attack_type_count", "threat_score"]


class Values:
    """A value state and a map state in memory."""

    def __init__(self):
        self.value, self.most = {}, 0

    def exists(self):
        return None in self.value

    def get(self):
        return self.value[None]

    def update(self, value):
        self.value[None] = value

    def clear(self):
        self.value.clear()

    def getValue(self, key):
        return self.value[key]

    def updateValue(self, key, value):
        self.value[key] = value

    def removeKey(self, key):
        del self.value[key]


class Handle:
    def __init__(self):
        self.timers, self.states = [], {}

    def getValueState(self, name, schema):
        return self.states.setdefault(name, Values())

    def getMapState(self, name, key, schema):
        return self.states.setdefault(name, Values())

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.append(at)


def frame(rng, n, start):
    place = np.arange(start, start + n)
    return pd.DataFrame({"stretch": [f"{p // 50:05d}" for p in place], "place": place, "said": "NL", "us": place * 1000, "mask": rng.integers(0, 1 << 20, n)})


def test_a_process_holds_one_stretch(monkeypatch):
    rng = np.random.default_rng(5)
    rows = frame(rng, 3_000, 100)
    sizes, step = [], threats._step

    def measured(state, country, ts, mask):
        sizes.append(len(ts))
        return step(state, country, ts, mask)

    monkeypatch.setattr(threats, "_step", measured)
    mixed = rows.sample(frac=1, random_state=1)
    pieces = [mixed.iloc[i: i + 170] for i in range(0, len(mixed), 170)]
    handle, whole = Handle(), step(None, "NL", rows["us"].to_numpy(), rows["mask"].to_numpy())
    profile = threats._Profile(idle_us=None)
    profile.init(handle)
    done = list(profile.handleInputRows(("1.1.1.1",), iter(pieces), None))
    assert max(sizes) <= 50 and sum(sizes) == 3_000 and handle.states["profile"].get() == whole
    assert handle.states["aside"].value == {} and done[0]["request_count"].tolist() == [3_000]
    # a batch that is one Arrow batch is taken as it is
    sizes.clear()
    more = frame(rng, 120, 4_000).sample(frac=1, random_state=2)
    list(profile.handleInputRows(("1.1.1.1",), iter([more]), None))
    assert sizes == [120]


def test_idle_addresses_are_forgotten():
    handle, profile = Handle(), threats._Profile(idle_us=5_000_000)
    profile.init(handle)
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: 2)
    for start in (0, 1_000):
        list(profile.handleInputRows(("1.1.1.1",), iter([frame(np.random.default_rng(1), 10, start)]), clock))
    assert handle.timers == [(1_009 * 1000 + 5_000_000) // 1000]  # one timer, of the last record
    assert list(profile.handleExpiredTimer(("1.1.1.1",), clock, None)) == [] and not handle.states["profile"].exists()


@pytest.mark.parametrize("key", ["number", "struct"])
def test_a_busy_address_equals_the_profile(spark, log, tmp_path, monkeypatch, key):
    monkeypatch.setattr(threats, "RANGE_ROWS", 64)
    rnd, at, rows = random.Random(2), 0.0, []
    for _ in range(1_500):
        at += rnd.choice([0.01, 0.05, 0.3])
        rows.append({"at": at, "ip": rnd.choice(["9.9.9.9"] * 9 + ["1.1.1.1"]), "path": rnd.choices(PATHS, [8, 3, 12, 1, 1, 1, 1, 1, 1])[0], "status": rnd.choices([200, 401, 404], [4, 2, 1])[0]})
    df = log(rows, 1)
    if key == "struct":
        df = df.withColumn("seq", F.struct(F.date_trunc("minute", "ts").alias("time"), F.lit("a.log").alias("file"), F.col("seq").alias("line")))
    for i in range(2):
        df.where(F.floor((F.col("seq.line") if key == "struct" else F.col("seq")) / 750) == i).repartition(4).write.parquet(str(tmp_path / f"in/file={i}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in/*"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        sinks.updates_to_files(threats.stream_ip_threats(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    got = sinks.latest_updates(spark, str(tmp_path / "out"), ["ip"]).select(COLUMNS)
    assert sorted(map(str, got.collect())) == sorted(map(str, security.ip_profile(df).select(COLUMNS).collect()))


def test_rows_go_to_python_without_their_timestamp(spark, log, tmp_path):
    """without a watermark nothing reads it there, and as an object it costs more than all other columns."""
    log([{"ip": "1.1.1.1"}], 1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    for hours, sent in ((None, False), (1.0, True)):
        plan = threats.stream_ip_threats(stream, idle_hours=hours)._jdf.queryExecution().analyzed().toString().splitlines()
        state = next(i for i, line in enumerate(plan) if "TransformWithState" in line)
        rows = next(line for line in plan[state + 1:] if "Project [" in line and "stretch#" in line)
        assert ("ts#" in rows.split("stretch#")[0]) == sent


@pytest.mark.parametrize("nulls", [False, True])
def test_an_address_is_taken_in_order_of_arrival(monkeypatch, nulls):
    rng, seen = np.random.default_rng(8), []
    rows = frame(rng, 400, 0).sample(frac=1, replace=True, random_state=4)  # some arrival keys twice
    if nulls:
        rows.loc[rows.index[:9], ["stretch", "place"]] = None
    monkeypatch.setattr(threats, "_step", lambda state, country, ts, mask: seen.append((ts.tolist(), mask.tolist())))
    threats._Profile(None)._take(None, rows)
    by_sort = rows.sort_values(["stretch", "place"], kind="stable")
    assert seen == [(by_sort["us"].tolist(), by_sort["mask"].tolist())]


def test_failed_logins_count_by_different_times():
    ts = np.array([5, 1, 5, 2, 9, 1, 7, 8, 3]) * 1_000_000
    bit = 1 << threats._BITS.index("failed_login")
    once = threats._step(None, "NL", ts, np.full(len(ts), bit))
    state = None
    for t in ts:
        state = threats._step(state, "NL", np.array([t]), np.array([bit]))
    assert once[-1] == state[-1] == [5_000_000, 1_000_000, 2_000_000, 9_000_000, 7_000_000, 8_000_000][:len(state[-1])]
