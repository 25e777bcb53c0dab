"""Running threat score per address on a stream.

The once-per-address rules depend on the order of records, so each address has
a small state: counters, the types seen, at most six login times.  The rules
themselves are evaluated in the JVM; only (position, time, bit mask) of a
record reaches Python, where bounded stretches of an address's records are
handled as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.attacks import ATTACK_TYPES, CORE, RECORD_TYPES, flag_attacks
from ..functions.text import any_of, seconds_between
from ..operators import once_per_ip as rules
from ..operators.security import attack_type_count, score

_BITS = (*RECORD_TYPES, "_error", "failed_login", "is_api_path", "introspection", "_core")
_AT_ONCE = {*CORE, "brute_force"}

_STATE = ("country string, n bigint, errors bigint, api bigint, core_hits bigint, first_ts bigint, last_ts bigint, "
          "counts array<bigint>, logins array<bigint>")
_OUT = ("ip string, country string, request_count bigint, error_count bigint, core_hits bigint, "
        "first_us bigint, last_us bigint, counts array<bigint>")


#: Records of an address that are put in order at once.
RANGE_ROWS = 8192
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _first(condition: np.ndarray) -> int | None:
    where = np.flatnonzero(condition)
    return int(where[0]) if len(where) else None


def _step(state: tuple | None, country: str | None, ts: np.ndarray, mask: np.ndarray) -> tuple:
    """The state after some more records of an address, which are in order of arrival."""
    bit = {name: (mask >> i & 1).astype(bool) for i, name in enumerate(_BITS)}
    if state is not None:
        country, n, errors, api, core, first_ts, _, counts, logins = state
        counts, logins = list(counts), list(logins)
    else:
        n, errors, api, core = 0, 0, 0, 0
        first_ts, counts, logins = int(ts[0]), [0] * len(ATTACK_TYPES), []
    total = dict(zip(ATTACK_TYPES, counts))
    size = len(ts)

    run_n = n + np.arange(1, size + 1)
    run_e = errors + np.cumsum(bit["_error"])
    run_a = api + np.cumsum(bit["is_api_path"])

    new_login = None
    if len(logins) <= rules.LOGIN_FAILURES:
        failed = np.flatnonzero(bit["failed_login"])
        times, at = np.unique(ts[failed], return_index=True)  # where each time comes first
        fresh = ~np.isin(times, logins)
        times, at = times[fresh], failed[at[fresh]]
        take = np.argsort(at)[:rules.LOGIN_FAILURES + 1 - len(logins)]
        logins += times[take].tolist()
        if len(logins) > rules.LOGIN_FAILURES:
            new_login = int(at[take[-1]])

    since = (ts - first_ts) / 1e6
    with np.errstate(divide="ignore", invalid="ignore"):
        fast = bit["is_api_path"] & (run_a > rules.API_MIN_REQUESTS) & (since > 0) & (run_a / since > rules.API_RATE)
    firsts = {t: _first(bit[t]) for t in RECORD_TYPES}
    firsts["credential_stuffing"] = new_login
    firsts["api_abuse"] = _first(bit["introspection"] | fast)

    if not total["scanning"]:
        known_at = sorted(
            0 if total[t] else at if t in _AT_ONCE else at + 1
            for t, at in firsts.items() if total[t] or at is not None)
        by_type = len(known_at) >= rules.SCAN_TYPES and known_at[rules.SCAN_TYPES - 1] < size
        by_ratio = bool(((run_n > rules.SCAN_MIN_REQUESTS) & (run_e / run_n > rules.SCAN_ERROR_RATIO)).any())
        total["scanning"] = int(by_type or by_ratio)
    for t in RECORD_TYPES:
        total[t] += int(bit[t].sum())
    for t in ("credential_stuffing", "api_abuse"):
        total[t] = int(bool(total[t]) or firsts[t] is not None)
    return (country, int(run_n[-1]), int(run_e[-1]), int(run_a[-1]), int(core + bit["_core"].sum()),
            int(first_ts), int(ts[-1]), [int(total[t]) for t in ATTACK_TYPES], logins)


class _Profile(StatefulProcessor):
    """One address: its state, and a map that puts its records of a micro-batch in order.

    Rows come in Arrow batches in no order.  What doesn't fit one batch is laid aside in the map by ranges of the
    arrival key, a few thousand records each; the ranges are then taken in order, one at a time.  So a process holds
    one Arrow batch or one range, however much of the micro-batch an address has.
    """

    def __init__(self, idle_us: int | None):
        self.idle_us = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("profile", _STATE)
        self.aside = handle.getMapState("aside", "stretch string, piece int", "place array<bigint>, us array<bigint>, mask array<bigint>, said array<string>")

    def _take(self, state: tuple | None, rows: pd.DataFrame) -> tuple:
        place, stretch = rows["place"].to_numpy(), rows["stretch"].to_numpy(object)
        if place.dtype.kind != "i" or pd.isna(stretch).any():  # an arrival key may be null: those come last
            order = rows.reset_index(drop=True).sort_values(["stretch", "place"], kind="stable").index.to_numpy()
        elif (stretch == stretch[0]).all():
            order = np.argsort(place, kind="stable")
        else:
            order = np.lexsort((place, np.unique(stretch, return_inverse=True)[1]))
        return _step(state, rows["said"].iloc[order[0]], rows["us"].to_numpy(np.int64)[order], rows["mask"].to_numpy(np.int64)[order])

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        state = self.state.get() if self.state.exists() else None
        held, ranges = None, {}
        for piece, rows_ in enumerate(rows):
            if not len(rows_):
                continue
            if held is not None:
                self._lay_aside(held, ranges)
            held = rows_
        if held is None:
            return
        if not ranges:
            state = self._take(state, held)
        else:
            self._lay_aside(held, ranges)
            held = None
            for name in sorted(ranges):
                pieces = []
                for piece in range(ranges[name]):
                    place, us, mask, said = self.aside.getValue((name, piece))
                    pieces.append(pd.DataFrame({"stretch": name, "place": list(place), "us": list(us), "mask": list(mask), "said": list(said)}))
                    self.aside.removeKey((name, piece))
                state = self._take(state, pd.concat(pieces))
        self.state.update(state)
        if self.idle_us is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(max((state[6] + self.idle_us) // 1000, timer_values.getCurrentWatermarkInMs() + 1))
        yield _row(key[0], state)

    def _lay_aside(self, rows: pd.DataFrame, ranges: dict[str, int]) -> None:
        for name, part in rows.groupby("stretch", sort=False):
            piece = ranges.get(name, 0)
            self.aside.updateValue((name, piece), tuple(part[c].tolist() for c in ("place", "us", "mask", "said")))
            ranges[name] = piece + 1

    def handleExpiredTimer(self, key, timer_values, expired_timer_info) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def _row(ip: str, state: tuple) -> pd.DataFrame:
    country, n, errors, _, core, first_ts, last_ts, counts, _ = state
    return pd.DataFrame({"ip": [ip], "country": [country], "request_count": [n], "error_count": [errors], "core_hits": [core],
                         "first_us": [first_ts], "last_us": [last_ts], "counts": [list(counts)]})


def _arrival(df: DataFrame, seq: str) -> tuple[Column, Column]:
    """(stretch, number): texts that order ranges of ``RANGE_ROWS`` arrivals, and the place inside one.

    The key is a number, or a struct that ends with one (the line) and may begin with a time.
    """
    kind = df.schema[seq].dataType
    if not isinstance(kind, T.StructType):
        return F.lpad((F.floor(F.col(seq) / RANGE_ROWS) + F.lit(1 << 62)).cast("string"), 20, "0"), F.col(seq).cast("bigint")
    names = kind.fieldNames()
    line = F.col(f"{seq}.{names[-1]}").cast("bigint")
    head = []
    for name in names[:-1]:
        part = F.col(f"{seq}.{name}")
        if isinstance(kind[name].dataType, (T.TimestampType, T.TimestampNTZType)):
            part = F.unix_micros(part.cast("timestamp"))
        if not isinstance(kind[name].dataType, T.StringType):
            part = F.lpad((part.cast("bigint") + F.lit(1 << 62)).cast("string"), 20, "0")
        head.append(part)
    return F.concat_ws("\x01", *head, F.lpad((F.floor(line / RANGE_ROWS) + F.lit(1 << 62)).cast("string"), 20, "0")), line


def stream_ip_threats(df: DataFrame, seq: str = "seq", delay: str = "10 minutes", idle_hours: float | None = None,
                      scan_user_agent: bool = True) -> DataFrame:
    """Per micro-batch one row for every address in it, with its profile so far.

    ``seq`` orders the records: a number, or a struct of times, texts and, last, a line number.  An address may own any
    part of a micro-batch: see ``_Profile``.  An address without records for ``idle_hours`` of event time is forgotten,
    and late records are dropped, if that is given; by default everything is kept.  The state lives in RocksDB, which
    this sets for the session if another store is set.
    """
    timed = df.withColumn("ts", F.col("ts").cast("timestamp"))
    if idle_hours is not None:
        timed = timed.withWatermark("ts", delay)
    spark = df.sparkSession
    if spark.conf.get(_STORE, None) != _ROCKSDB:
        spark.conf.set(_STORE, _ROCKSDB)
    flagged = flag_attacks(timed, scan_user_agent).withColumns({"_error": F.col("status") >= 400})
    flagged = flagged.withColumn("_core", any_of(F.col(t) for t in CORE))
    mask = sum((F.shiftleft(F.col(b).cast("bigint"), i) for i, b in enumerate(_BITS)), F.lit(0).cast("bigint"))
    stretch, place = _arrival(df, seq)
    # A row's time goes to Python only where the watermark needs it: as a timestamp it is an object there.
    rows = flagged.select("ip", *["ts"] * (idle_hours is not None), stretch.alias("stretch"), place.alias("place"), F.col("country").alias("said"),
                          F.unix_micros("ts").alias("us"), mask.alias("mask"))
    idle_us = None if idle_hours is None else int(idle_hours * 3600e6)
    states = rows.groupBy("ip").transformWithStateInPandas(
        _Profile(idle_us), _OUT, "update", "none" if idle_us is None else "eventTime")
    wide = states.select(
        "ip", "country", "request_count", "error_count", "core_hits",
        F.timestamp_micros("first_us").alias("first_seen"), F.timestamp_micros("last_us").alias("last_seen"),
        *[F.col("counts")[i].alias(t) for i, t in enumerate(ATTACK_TYPES)])
    return (wide.withColumn("duration", seconds_between(F.col("first_seen"), F.col("last_seen")))
            .withColumn("attack_type_count", attack_type_count()).withColumn("threat_score", score()).drop("duration"))
