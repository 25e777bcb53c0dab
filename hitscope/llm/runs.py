"""Periodic runs of words: passages that say the same words over and over.

A run is a stretch of consecutive words with smallest period q, at least
``max(6, 4 q)`` words long, that no neighbouring word extends keeping q.  They
are found by internal pattern matching over the words of an Arrow batch:

* prefix doubling sorts the suffixes and, on its way, gives every dyadic block
  (2**k words from a multiple of 2**k) the interval of suffixes that begin
  with it;
* a wavelet matrix over the suffix array tells how many occurrences of a block
  begin in a window of positions, and which are the first;
* a run of period q, 2**k <= q < 2**(k+1), holds an aligned block of 2**k words
  within its first q, and that block again q words on.  So the window from
  2**k to 2**(k+1) words behind a block holds every period it has to answer
  for.  Three or more occurrences there are one arithmetic progression: the
  block then has a shorter period itself, and the ends of the stretches with
  that period leave two candidates;
* each candidate is extended to both sides by comparing hashes, and what is
  long enough is compared word by word.

A batch is worked on in time n log n and memory n log n, whatever its texts are.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import Texts, Words, mix, named, over_batches

#: Words and periods a run has at least.
SHORTEST, REPEATS = 6, 4
#: Bytes of text that are worked on at once; a longer text is worked on alone.
BLOCK = 1 << 20
_BASE = np.uint64(0xD1342543DE82EF95)

COLUMNS = ("n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, "
           "collapsed_sha256 string")


class WaveletMatrix:
    """Counts and order statistics of slices of an array of numbers below 2**bits; all queries take arrays."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.zeros, self.before = bits, [], []
        for b in range(bits - 1, -1, -1):
            zero = (values >> b) & 1 == 0
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(zero, out=before[1:])
            self.before.append(before)
            self.zeros.append(int(before[-1]))
            values = np.concatenate([values[zero], values[~zero]])

    def count_below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of values[lo:hi] are smaller than x."""
        count = np.zeros(len(lo), np.int64)
        for k, (before, zeros) in enumerate(zip(self.before, self.zeros)):
            one = (x >> (self.bits - 1 - k)) & 1 == 1
            zl, zh = before[lo], before[hi]
            count += np.where(one, zh - zl, 0)
            lo, hi = np.where(one, zeros + lo - zl, zl), np.where(one, zeros + hi - zh, zh)
        return count

    def nth(self, lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The n-th smallest (from 0) of values[lo:hi]."""
        out = np.zeros(len(lo), np.int64)
        for k, (before, zeros) in enumerate(zip(self.before, self.zeros)):
            zl, zh = before[lo], before[hi]
            one = n >= zh - zl
            n = np.where(one, n - (zh - zl), n)
            out |= one.astype(np.int64) << (self.bits - 1 - k)
            lo, hi = np.where(one, zeros + lo - zl, zl), np.where(one, zeros + hi - zh, zh)
        return out


def sorted_suffixes(ids: np.ndarray, longest: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Suffixes ordered by at least their first ``longest`` symbols, and for each k with 2**k <= longest
    the interval of them that begins with the block of 2**k symbols at 0, 2**k, 2 * 2**k ..."""
    n = len(ids)
    _, rank = np.unique(ids, return_inverse=True)
    counts = np.bincount(rank)
    rank = (np.cumsum(counts) - counts)[rank]
    blocks, width = [], 1
    while True:
        size = np.bincount(rank, minlength=n)[rank]
        if width <= longest:
            blocks.append((rank[::width].copy(), (rank + size)[::width]))
        open_ = np.flatnonzero(size > 1)
        if width >= longest or not len(open_):
            break
        behind = np.where(open_ + width < n, rank[np.minimum(open_ + width, n - 1)] + 1, 0)
        key = rank[open_] * (n + 1) + behind
        order = np.argsort(key, kind="stable")
        key, group = key[order], rank[open_][order]
        place = np.arange(len(key))
        new_key, new_group = np.ones(len(key), bool), np.ones(len(key), bool)
        new_key[1:], new_group[1:] = key[1:] != key[:-1], group[1:] != group[:-1]
        first = np.maximum.accumulate(np.where(new_key, place, 0)) - np.maximum.accumulate(np.where(new_group, place, 0))
        rank[open_[order]] = group + first
        width *= 2
    return np.argsort(rank, kind="stable"), blocks


class _Extension:
    """How far two places of a sequence agree, by hashes of their words."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        power = np.ones(1, np.uint64)
        while len(power) <= n:
            power = np.concatenate([power, power * np.uint64(pow(int(_BASE), len(power), 2**64))])
        self.power = power[: n + 1]
        self.sum = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(ids.astype(np.uint64)) * self.power[:n], out=self.sum[1:])
        self.steps = [1 << b for b in range(n.bit_length() - 1, -1, -1)]

    def _equal(self, i, j, m):
        return (self.sum[i + m] - self.sum[i]) * self.power[j - i] == self.sum[j + m] - self.sum[j]

    def right(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """The most words from i and from j > i that agree, at most ``limit``."""
        done = np.zeros(len(i), np.int64)
        for step in self.steps:
            fits = done + step <= limit
            m = np.where(fits, step, 0)
            done += np.where(fits & self._equal(i + done, j + done, m), step, 0)
        return done

    def left(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """The most words before i and before j > i that agree, at most ``limit``."""
        done = np.zeros(len(i), np.int64)
        for step in self.steps:
            fits = done + step <= limit
            m = np.where(fits, step, 0)
            done += np.where(fits & self._equal(i - done - m, j - done - m, m), step, 0)
        return done


def find_runs(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of every run, by start, then period.

    ``ids`` are equal where words are; document d has ids[bounds[d]:bounds[d + 1]],
    and no run goes over a document's end.
    """
    nothing = (np.zeros(0, np.int64),) * 3
    words = np.diff(bounds)
    longest = int(words.max(initial=0))
    if longest < SHORTEST:
        return nothing
    # one symbol of its own behind each document
    docs = len(words)
    place = np.arange(len(ids)) + np.repeat(np.arange(docs), words)
    _, dense = np.unique(ids, return_inverse=True)
    text = np.empty(len(ids) + docs, np.int64)
    text[place] = dense
    ends = bounds[1:] + np.arange(docs)
    text[ends] = len(ids) + np.arange(docs)
    n = len(text)
    first = bounds[:-1] + np.arange(docs)
    order, blocks = sorted_suffixes(text, max(1, longest // REPEATS))
    tree = WaveletMatrix(order.astype(np.int32), n.bit_length())
    extend = _Extension(text)
    found = []
    for k, (lo, hi) in enumerate(blocks):
        width = 1 << k
        use = np.flatnonzero(hi - lo >= REPEATS - 1)  # a run has its block three times at least
        b = use * width
        lo, hi = lo[use], hi[use]
        near, far = np.minimum(b + width, n), np.minimum(b + 2 * width, n)
        skip = tree.count_below(lo, hi, near)
        inside = tree.count_below(lo, hi, far) - skip
        hit = np.flatnonzero(inside > 0)
        if not len(hit):
            continue
        b, lo, hi, skip, inside = b[hit], lo[hit], hi[hit], skip[hit], inside[hit]
        one = tree.nth(lo, hi, skip)
        more = np.flatnonzero(inside > 1)
        two = tree.nth(lo[more], hi[more], skip[more] + 1)
        few = inside[more] == 2
        at = [b[inside <= 2], b[more][few]]
        period = [(one - b)[inside <= 2], two[few] - b[more][few]]
        # progressions: the stretch of the block and the one of its next occurrence begin, or end, q words apart
        home, next_, step = b[more][~few], one[more][~few], (two - one[more])[~few]
        if len(home):
            doc = np.searchsorted(ends, home)
            top, bottom = ends[doc], first[doc]
            left = home - extend.left(home, home + step, home - bottom)
            right = home + step + extend.right(home, home + step, top - home - step)
            left_next = next_ - extend.left(next_, next_ + step, next_ - bottom)
            right_next = next_ + step + extend.right(next_, next_ + step, np.maximum(top - next_ - step, 0))
            at += [home, home]
            period += [left_next - left, right_next - right]
        at, period = np.concatenate(at), np.concatenate(period)
        good = (period >= width) & (period < 2 * width)
        at, period = at[good], period[good]
        doc = np.searchsorted(ends, at)
        good = at + period < ends[doc]
        at, period, doc = at[good], period[good], doc[good]
        start = at - extend.left(at, at + period, at - first[doc])
        end = at + period + extend.right(at, at + period, ends[doc] - at - period)
        long = end - start >= np.maximum(SHORTEST, REPEATS * period)
        found.append(np.stack([start[long], end[long], period[long]], axis=1))
    runs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
    runs = _confirmed(text, runs, first, ends)
    # a stretch's smallest period divides the others that it is found with
    keep = np.ones(len(runs), bool)
    keep[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[keep]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    shift = np.searchsorted(ends, runs[:, 0])
    return runs[:, 0] - shift, runs[:, 1] - shift, runs[:, 2]


def _confirmed(text: np.ndarray, runs: np.ndarray, first: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The runs compared word by word; one that hashes made too long is cut to where its words agree."""
    out, cut = [], False
    for start, end, q in runs.tolist():
        differ = np.flatnonzero(text[start: end - q] != text[start + q: end])
        if not len(differ):
            out.append((start, end, q))
            continue
        cut = True
        edges = [start - 1, *(start + differ).tolist(), end - q]
        out += [(a + 1, z + q, q) for a, z in zip(edges, edges[1:]) if z + q - a - 1 >= max(SHORTEST, REPEATS * q)]
    done = np.array(out, np.int64).reshape(-1, 3)
    return np.unique(done, axis=0) if cut else done


def repeated_tail(n: int, h: int) -> np.ndarray | None:
    """Which original word stands at each place, for documents whose tail is made periodic; None for the others."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


def _digest(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def collapsed(df: DataFrame, text: str = "text", key: str = "doc_id", made_periodic: bool = False, with_text: bool = False) -> DataFrame:
    """Per row of ``df``: the key, ``n_runs``, the run with the greatest length / period (ties: smallest start, then
    period), digests of all runs and of the text whose runs are cut to their first period.

    ``start`` and ``length`` count words from 0; a text without a run has nulls there.  ``with_text`` adds ``runs``, an
    array of (start, length, period), and ``text_left``.  With ``made_periodic`` the words of some documents, told by the
    crc32 of their key, first repeat from some place on (a test load; a null key counts as the empty text).

    Null and empty texts have no words, no run and the digest of the empty text.  Repeated rows and keys are rows like
    others, null keys are passed on, other columns are not read.
    """
    key_type = df.schema[key].dataType.simpleString()
    h = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) if made_periodic else F.lit(1)

    def work(batch: pa.RecordBatch):
        texts = Texts(batch.column("text"))
        words = Words(texts)
        ids, bounds = words.hashes.copy(), words.bounds
        sources = [repeated_tail(int(n), c) for n, c in zip(words.counts, batch.column("h").to_pylist())]
        for d, source in enumerate(sources):
            if source is not None:
                ids[bounds[d]: bounds[d + 1]] = ids[bounds[d] + source]
        start, end, period = find_runs(ids, bounds)
        edges = np.searchsorted(start, bounds)
        out = {c.split()[0]: [] for c in COLUMNS.split(", ")} | {"starts": [], "lengths": [], "periods": [], "text_left": []}
        for d in range(texts.n):
            s, e, q = (x[edges[d]: edges[d + 1]] for x in (start, end, period))
            s, e = s - bounds[d], e - bounds[d]
            runs = list(zip(s.tolist(), (e - s).tolist(), q.tolist()))
            best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
            kept = texts.document(d).split()
            n = len(kept)
            source = sources[d] if sources[d] is not None else np.arange(n) if runs else None
            if source is not None:
                drop = np.zeros(n + 1, np.int64)
                np.add.at(drop, s + q, 1)
                np.add.at(drop, e, -1)
                kept = [kept[i] for i in source[np.cumsum(drop)[:n] == 0].tolist()]
            left = b" ".join(kept)
            out["n_runs"].append(len(runs))
            for name, value in zip(("start", "length", "period"), best or (None,) * 3):
                out[name].append(value)
            out["exponent_milli"].append(1000 * best[1] // best[2] if best else None)
            out["runs_sha256"].append(_digest("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()))
            out["collapsed_sha256"].append(_digest(left))
            if with_text:
                for name, values in zip(("starts", "lengths", "periods"), zip(*runs) if runs else ((),) * 3):
                    out[name].append(list(values))
                out["text_left"].append(left.decode())
        yield out | {"key": batch.column("key")}

    rows = named(df, key=key, text=text, h=h)
    more = ", starts array<bigint>, lengths array<bigint>, periods array<bigint>, text_left string" if with_text else ""
    flat = over_batches(rows, work, f"key {key_type}, {COLUMNS}{more}", BLOCK)
    if with_text:
        runs = F.arrays_zip("starts", "lengths", "periods").cast("array<struct<start:bigint,length:bigint,period:bigint>>")
        flat = flat.withColumn("runs", runs).drop("starts", "lengths", "periods")
    return flat.withColumnRenamed("key", key)
