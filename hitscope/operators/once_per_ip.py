"""Rules that fire once per address, at a certain record of its history.

A sequential reader decides these with running state.  Here each is a closed
form over minima, top-k ranks and chunked running totals:

* the totals per (address, chunk) give every chunk its starting totals;
* bounds on what a chunk can reach discard the chunks in which nothing can
  fire, so only rows of suspect chunks are ever sorted;
* a chunk holds a bounded number of rows, whatever share one address has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.attacks import CORE
from ..functions.text import count_where, seconds_between
from ..plans.arrival import CHUNK_ROWS, chunk_of

SCAN_MIN_REQUESTS = 10
SCAN_ERROR_RATIO = 0.8
SCAN_TYPES = 3
LOGIN_FAILURES = 5
API_MIN_REQUESTS = 100
API_RATE = 5.0


def _first_logins(flagged: DataFrame, seq: str) -> DataFrame:
    """(ip, ts, credential_seq, _rank): the first six distinct times of a failed login, by their first record."""
    times = flagged.where("failed_login").groupBy("ip", "ts").agg(F.min(seq).alias("credential_seq"))
    w = Window.partitionBy("ip").orderBy("credential_seq")
    return times.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= LOGIN_FAILURES + 1)


def credential_stuffing(flagged: DataFrame, seq: str = "seq") -> DataFrame:
    """(ip, credential_seq): where the 6th distinct time of a failed login occurs."""
    return _first_logins(flagged, seq).where(F.col("_rank") == LOGIN_FAILURES + 1).select("ip", "credential_seq")


def first_logins(flagged: DataFrame, seq: str = "seq") -> DataFrame:
    """(ip, logins): an array of seq and ts of the first failed logins at six different times, at most six; what
    ``credential_stuffing`` needs to go on with later records."""
    return _first_logins(flagged, seq).groupBy("ip").agg(
        F.array_sort(F.collect_list(F.struct(F.col("credential_seq").alias("seq"), "ts"))).alias("logins"))


def merged_logins(logins: Column) -> Column:
    """An array of ``logins`` arrays as one: of equal times the first record, then the first six."""
    ordered = F.array_sort(F.flatten(logins))
    fresh = F.filter(ordered, lambda x, i: ~F.exists(F.slice(ordered, F.lit(1), i), lambda y: y["ts"] == x["ts"]))
    return F.slice(fresh, 1, LOGIN_FAILURES + 1)


def running_rules(flagged: DataFrame, seq: str = "seq", chunk_rows: int = CHUNK_ROWS, start: DataFrame | None = None) -> DataFrame:
    """(ip, error_ratio_seq, api_rate_seq): first record at which the address has

    * more than 10 requests of which over 80 % failed;
    * more than 100 API requests, at over 5 per second since its first record
      (only an API record can fire this).

    Either is NULL if it never happens; addresses without either are absent.  ``start``: (ip, request_count,
    error_count, api_count, first_seen) of all records before these, one row for each address.
    """
    rows = flagged.select("ip", F.col(seq).alias("_seq"), F.col("ts").alias("_ts"),
                          (F.col("status") >= 400).alias("_error"), F.col("is_api_path").alias("_api"),
                          chunk_of(flagged, seq, chunk_rows).alias("_chunk"))
    chunks = rows.groupBy("ip", "_chunk").agg(
        F.count("*").alias("_n"), count_where(F.col("_error")).alias("_e"), count_where(F.col("_api")).alias("_a"),
        F.min(F.when(F.col("_api"), F.col("_ts"))).alias("_api_from"),
        F.min_by("_ts", "_seq").alias("_chunk_first"))
    history = Window.partitionBy("ip").orderBy("_chunk")
    before = history.rowsBetween(Window.unboundedPreceding, -1)

    def so_far(name: str) -> Column:
        return F.coalesce(F.sum(name).over(before), F.lit(0))

    placed = chunks.select(
        "ip", "_chunk", "_n", "_e", "_a", "_api_from",
        so_far("_n").alias("_n0"), so_far("_e").alias("_e0"), so_far("_a").alias("_a0"),
        F.first("_chunk_first").over(history.rowsBetween(Window.unboundedPreceding, 0)).alias("_first_ts"))
    if start is not None:
        earlier = start.select("ip", *[F.col(c).alias(f"_s{k}") for k, c in enumerate(("request_count", "error_count", "api_count", "first_seen"))])
        placed = placed.join(earlier, "ip", "left").withColumns({
            **{n: F.col(n) + F.coalesce(f"_s{k}", F.lit(0)) for k, n in enumerate(("_n0", "_e0", "_a0"))},
            "_first_ts": F.coalesce("_s3", "_first_ts")}).drop("_s0", "_s1", "_s2", "_s3")
    # The running ratio inside a chunk is largest if all its errors come first.
    may_scan = ((F.col("_n0") + F.col("_n") > SCAN_MIN_REQUESTS)
                & (F.try_divide(F.col("_e0") + F.col("_e"), F.col("_n0") + F.col("_e")) > SCAN_ERROR_RATIO))
    shortest = seconds_between(F.col("_first_ts"), F.col("_api_from"))
    may_abuse = ((F.col("_a") > 0) & (F.col("_a0") + F.col("_a") > API_MIN_REQUESTS)
                 & ((shortest <= 0) | (F.try_divide(F.col("_a0") + F.col("_a"), shortest) > API_RATE)))
    suspect = placed.where(F.coalesce(may_scan, F.lit(False)) | F.coalesce(may_abuse, F.lit(False))).select(
        "ip", "_chunk", "_n0", "_e0", "_a0", "_first_ts")
    inside = Window.partitionBy("ip", "_chunk").orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
    running = rows.join(suspect, ["ip", "_chunk"]).select(
        "ip", "_seq", "_api", "_ts", "_first_ts",
        (F.col("_n0") + F.count("*").over(inside)).alias("_n"),
        (F.col("_e0") + F.sum(F.col("_error").cast("bigint")).over(inside)).alias("_e"),
        (F.col("_a0") + F.sum(F.col("_api").cast("bigint")).over(inside)).alias("_a"))
    since_first = seconds_between(F.col("_first_ts"), F.col("_ts"))
    scans = (F.col("_n") > SCAN_MIN_REQUESTS) & (F.col("_e") / F.col("_n") > SCAN_ERROR_RATIO)
    abuses = (F.col("_api") & (F.col("_a") > API_MIN_REQUESTS) & (since_first > 0)
              & (F.try_divide(F.col("_a"), since_first) > API_RATE))
    return (running.select("ip", "_seq", scans.alias("_scans"), F.coalesce(abuses, F.lit(False)).alias("_abuses"))
            .where("_scans OR _abuses").groupBy("ip").agg(
                F.min(F.when(F.col("_scans"), F.col("_seq"))).alias("error_ratio_seq"),
                F.min(F.when(F.col("_abuses"), F.col("_seq"))).alias("api_rate_seq")))


def third_type(first: dict[str, str]) -> Column:
    """STRUCT<seq, after>: when an address has shown three attack types.

    ``first`` maps a type to the column with its first record.  Types of core
    rules and brute force count at that record (``after`` 0); all others are
    found after the scanning test and count from the address's next record on
    (``after`` 1).
    """
    at_once = {*CORE, "brute_force"}
    seen = ", ".join(
        f"CASE WHEN {c} IS NOT NULL THEN struct({c} AS seq, {0 if t in at_once else 1} AS after) END" for t, c in first.items())
    return F.expr(f"get(array_sort(array_compact(array({seen}))), {SCAN_TYPES - 1})")


def scanning(flagged: DataFrame, per_ip: DataFrame, seq: str = "seq", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(ip, scanning_seq): the record at which each scanning address is found out.

    ``flagged`` need only have (ip, seq); ``per_ip`` is the table of ``security.ip_profile``, stored rather than
    computed here.  Only addresses whose third type counts from their next record need another look at the rows: the
    first and last record of every (address, chunk) tell the chunk that holds the next one, and only rows of such
    chunks, which are bounded, are joined.
    """
    third = F.col("third_type")
    found = per_ip.where("is_scanning")
    pending = found.where(third["after"] == 1).select("ip", third["seq"].alias("_after"))
    rows = flagged.select("ip", F.col(seq).alias("_seq"), chunk_of(flagged, seq, chunk_rows).alias("_chunk"))
    chunks = rows.groupBy("ip", "_chunk").agg(F.min("_seq").alias("_from"), F.max("_seq").alias("_to"))
    next_chunk = chunks.join(pending, "ip").where(F.col("_to") > F.col("_after")).groupBy("ip", "_after").agg(
        F.min(F.struct("_chunk", "_from")).alias("_next"))
    here = F.col("_next._from") > F.col("_after")
    first = next_chunk.where(here).select("ip", F.col("_next._from").alias("_following"))
    inside = next_chunk.where(~here).select("ip", "_after", F.col("_next._chunk").alias("_chunk"))
    second = rows.join(inside, ["ip", "_chunk"]).where(F.col("_seq") > F.col("_after")).groupBy("ip").agg(F.min("_seq").alias("_following"))
    by_type = F.when(third["after"] == 0, third["seq"]).otherwise(F.col("_following"))
    return (found.join(first.unionByName(second), "ip", "left")
            .select("ip", F.least(by_type, F.col("error_ratio_seq")).alias("scanning_seq")))
