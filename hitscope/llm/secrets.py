"""Secrets in text, told from examples by who has them.

One pass finds candidates: keyword assignments, access keys, hex strings, and
further known and random-looking forms.  The hash of each candidate's value is
then counted over the corpus by distinct repositories and distinct owners.  A
value that many owners have is a widely copied example; one that stays with a
few looks live.  Forms beyond the first three are reported only where they
look live.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import named, over_batches
from .workspace import stored

#: Fixed values of the first three kinds: pattern, shortest, and the group whose length and value count.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 12, 2),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 18, 0),
    ("hex", re.compile(r"[0-9a-f]+"), 16, 0),
)
#: Further forms, in the order of their names in results: a text it needs to hold, pattern, and the group that is the value.
MORE = (
    ("private_key", "PRIVATE KEY-----", re.compile(r"-----BEGIN ([A-Z ]{0,40})PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}?-----END \1PRIVATE KEY-----", re.A), 0),
    ("signed_token", "eyJ", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0),
    ("url_login", "://", re.compile(r"(?<=://)[A-Za-z0-9._~%-]{1,64}:([A-Za-z0-9._~%!$&*+=-]{6,128})@(?=[A-Za-z0-9])"), 1),
    ("prefixed", "_", re.compile(r"(?<![A-Za-z0-9])(?:gh[opsur]_|[rs]k_(?:live|test)_|glpat-|xox[abprs]-)[A-Za-z0-9_-]{16,}"), 0),
    ("random", "", re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])"), 0),
)
KINDS = tuple(k[0] for k in BASE) + tuple(k[0] for k in MORE)
#: A value that more owners have than this is an example.
MAX_OWNERS = 2
#: Bits a character that a random-looking string has at least; it also needs small and capital letters and three digits.
MIN_ENTROPY = 3.8
_RANDOM = (re.compile("[a-z]"), re.compile("[A-Z]"), re.compile("[0-9].*?[0-9].*?[0-9]"))
#: Verdicts of values that hold more than this share of all candidates, so at most 10,000 of them, are sent to all tasks.
FREQUENT = 1e-4

_SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"


def entropy(value: str) -> float:
    """Bits a character, by the value's own counts."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> Iterator[tuple[int, int, int, str]]:
    """(kind number, start, end, value) in code points, ends exclusive; leftmost and not overlapping within a kind, then the short ones left out."""
    for number, (_, pattern, shortest, group) in enumerate(BASE):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= shortest:
                yield number, m.start(), m.end(), m.group(group)


def more_spans(text: str, taken: list[tuple[int, int]] = ()) -> Iterator[tuple[int, int, int, str]]:
    """As ``base_spans``, of the further forms; a random-looking string that overlaps another form or a ``taken`` place is left out."""
    taken, number = list(taken), len(BASE)
    for name, holds, pattern, group in MORE:
        if name == "random":
            taken.sort()
            starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
        for m in pattern.finditer(text) if holds in text else ():
            if name == "random":
                value, before = m.group(), bisect_left(starts, m.end())
                if before and reach[before - 1] > m.start() or not all(p.search(value) for p in _RANDOM) or entropy(value) < MIN_ENTROPY:
                    continue
            taken.append(m.span())
            yield number, m.start(), m.end(), m.group(group)
        number += 1


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted((s, k, e) for k, s, e in spans))


def candidates(df: DataFrame, text: str = "text", key: str = "doc_id", owner: str | None = None, repository: str | None = None) -> DataFrame:
    """One row for each row of ``df``: key, owner, repository, n_assign, n_access, n_hex, base_sha256, and found: an array
    of all candidates' start, kind (a number into ``KINDS``), end and the SHA-256 of the value."""
    key_type = df.schema[key].dataType.simpleString()

    def work(batch: pa.RecordBatch):
        counts = {n: [] for n in ("n_assign", "n_access", "n_hex")}
        digests, starts, kinds, ends, values = [], [], [], [], []
        for value in batch.column("text").to_pylist():
            value = value or ""
            base = list(base_spans(value))
            spans = base + list(more_spans(value, [x[1:3] for x in base]))
            for number, name in enumerate(counts):
                counts[name].append(sum(k == number for k, *_ in base))
            digests.append(hashlib.sha256(_joined([x[:3] for x in base]).encode()).hexdigest())
            spans.sort(key=lambda x: (x[1], x[0]))
            starts.append([s for _, s, _, _ in spans])
            kinds.append([k for k, _, _, _ in spans])
            ends.append([e for _, _, e, _ in spans])
            values.append([hashlib.sha256(v.encode()).hexdigest() for _, _, _, v in spans])
        yield counts | {"key": batch.column("key"), "owner": batch.column("owner"), "repository": batch.column("repository"), "base_sha256": digests,
                        "start": starts, "kind": kinds, "end": ends, "value": values}

    def said(column):
        return F.col(column).cast("string") if column else F.col(key).cast("string")

    rows = named(df, key=key, text=F.col(text).cast("string"), owner=said(owner), repository=said(repository))
    flat = over_batches(rows, work, f"key {key_type}, owner string, repository string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, "
                                    "start array<bigint>, kind array<int>, end array<bigint>, value array<string>")
    return flat.withColumn("found", F.arrays_zip("start", "kind", "end", "value").cast(_SPAN)).drop("start", "kind", "end", "value")


def ownership(found: DataFrame) -> DataFrame:
    """(value, n_owners, n_repositories, n_found) of every candidate value; null owners count as one owner."""
    rows = found.select("owner", "repository", F.explode("found.value").alias("value"))
    pairs = rows.groupBy("value", "owner", "repository").agg(F.count("*").alias("n"))
    absent = F.lit("\0")  # distinct counts pass over nulls
    return pairs.groupBy("value").agg(
        F.countDistinct(F.coalesce("owner", absent)).alias("n_owners"), F.countDistinct(F.coalesce("repository", absent)).alias("n_repositories"),
        F.sum("n").alias("n_found"))


def _live(spans: DataFrame, verdicts: DataFrame, most: int) -> DataFrame:
    """The rows of ``spans`` whose value at most ``most`` owners have.

    No key is hot in the join: values above a share of all candidates, so few
    by that, are told by a broadcast.
    """
    total = verdicts.agg(F.coalesce(F.sum("n_found"), F.lit(0))).first()[0]
    frequent = verdicts.where(F.col("n_found") > FREQUENT * total).select("value", (F.col("n_owners") <= most).alias("few"))
    told = spans.join(F.broadcast(frequent), "value", "left")
    seldom = verdicts.where((F.col("n_found") <= FREQUENT * total) & (F.col("n_owners") <= most)).select("value")
    return told.where("few").drop("few").unionByName(told.where("few is null").drop("few").join(seldom, "value", "left_semi"))


def scan(df: DataFrame, text: str = "text", key: str = "doc_id", owner: str | None = None, repository: str | None = None,
         max_owners: int = MAX_OWNERS) -> DataFrame:
    """Per row of ``df``: key, n_assign, n_access, n_hex, base_sha256 (of the spans of these three kinds), spans (these, and
    further forms whose value at most ``max_owners`` owners have), and n_added.

    Spans are ``kind:start:end`` in code points, end exclusive, by start, then kind, joined by commas.  Without ``owner``
    or ``repository`` every key is one of its own.  Null and empty texts have no spans.  Repeated rows are rows of their
    own, of one owner and repository; null keys are passed on, null owners are one owner.
    """
    found = stored(candidates(df, text, key, owner, repository).withColumn("row", F.monotonically_increasing_id()), "secret-candidates")
    verdicts = stored(ownership(found), "secret-owners")
    extra = found.where(F.exists("found.kind", lambda k: k >= len(BASE)))
    spans = extra.select("row", F.explode("found").alias("s")).where(f"s.kind >= {len(BASE)}").select("row", "s.*")
    added = _live(spans, verdicts, max_owners).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end", "value")).alias("added"))
    base = F.filter("found", lambda s: s["kind"] < len(BASE))

    def said(rows: DataFrame, spans, n) -> DataFrame:
        name = F.array(*map(F.lit, KINDS))
        listed = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"]))
        return rows.select(F.col("key").alias(key), "n_assign", "n_access", "n_hex", "base_sha256", F.concat_ws(",", listed).alias("spans"), n.cast("bigint").alias("n_added"))

    none = F.array().cast(_SPAN)
    plain = found.where(~F.exists("found.kind", lambda k: k >= len(BASE)))
    both = extra.join(added, "row", "left").withColumn("added", F.coalesce("added", none))
    return said(plain, base, F.lit(0)).unionByName(said(both, F.concat(base, F.col("added")), F.size("added")))


def owned(df: DataFrame, text: str = "text", key: str = "doc_id", owner: str | None = None, repository: str | None = None) -> DataFrame:
    """One row for each candidate: key, kind, start, end, value_sha256, n_owners, n_repositories."""
    found = stored(candidates(df, text, key, owner, repository), "secret-candidates")
    spans = found.select("key", F.explode("found").alias("s")).select("key", "s.*")
    name = F.array(*map(F.lit, KINDS))
    return spans.join(ownership(found), "value").select(
        F.col("key").alias(key), F.element_at(name, F.col("kind") + 1).alias("kind"), "start", "end", F.col("value").alias("value_sha256"), "n_owners", "n_repositories")
