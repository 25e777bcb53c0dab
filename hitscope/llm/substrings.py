"""Removal of word sequences that an earlier document has too, by level-wise doubling.

A long window can only repeat where a shorter one in it repeats.  So short
windows are counted first; windows that repeat at one length alone are
extended to twice that length, up to the length asked for, and most text has
left the race by then.  At every length below the last only one short window
stands for each long one: the one with the smallest hash in it, a choice that
depends on the window's words alone, so equal long windows choose alike.

Counts are least and greatest keys by hash, combined before the shuffle; a
sequence that a third of all documents share is no more work than any other.
Sequences are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import Texts, Words, blocks, forget, fresh, give_back, named, over_batches, signed
from .workspace import stored

LENGTH = 13
#: The first length; doubled until LENGTH is reached.
START = 7


def lengths(start: int, length: int) -> list[int]:
    """start, 2 start, 4 start, ... below ``length``, and then ``length``."""
    out = [min(start, length)]
    while out[-1] < length:
        out.append(min(2 * out[-1], length))
    return out


def _chosen(words: Words, short: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of ``length`` begin, and for each the smallest hash of the windows of ``short`` words in it."""
    at, _ = words.windows(length)
    where, short_hashes = words.windows(short)
    by_word = np.full(len(words.hashes), np.uint64(2**64 - 1))
    by_word[where] = short_hashes
    best = by_word[at]
    for k in range(1, length - short + 1):
        best = np.minimum(best, by_word[at + k])
    return at, best


def _alive(words: Words, at: np.ndarray, values: np.ndarray, survivors: list) -> np.ndarray:
    """Which windows' values are among the survivors of their own document."""
    if not len(at):
        return np.zeros(0, bool)
    spread = np.uint64(0x9E3779B97F4A7C15)
    sets = [np.zeros(0, np.int64) if s is None else np.asarray(s, np.int64) for s in survivors]
    pair_doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets]).astype(np.uint64)
    pairs = np.sort(np.concatenate(sets).view(np.uint64) ^ pair_doc * spread)
    keys = values ^ words.documents()[at].astype(np.uint64) * spread
    # neighbouring windows often share their value: each run of equal ones is looked up once
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    if not len(pairs):
        return np.zeros(len(at), bool)
    some = keys[first]
    hit = pairs[np.minimum(np.searchsorted(pairs, some), len(pairs) - 1)] == some
    return np.repeat(hit, np.diff(np.append(first, len(keys))))


def _repeated(pairs: DataFrame) -> DataFrame:
    """(h, first) of the hashes that two documents or more have; null keys come after all others, and count as one."""
    seen = pairs.groupBy("h").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.max(F.col("key").isNull()).alias("unnamed"))
    return seen.where((F.col("first") < F.col("last")) | F.col("unnamed") & F.col("first").isNotNull()).select("h", "first")


def _pairs(rows: DataFrame, key_type: str, short: int, length: int) -> DataFrame:
    """(h, key): the short windows that stand for each document's long ones."""
    def work(batch):
        words = Words(Texts(batch.column("text")))
        at, best = _chosen(words, short, length)
        docs = words.documents()[at]
        new = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (docs[1:] != docs[:-1])])) if len(at) else at
        yield {"h": signed(best[new]), "key": batch.column("key").take(pa.array(docs[new]))}

    return over_batches(rows, work, f"h bigint, key {key_type}")


def _survivors(pairs: DataFrame) -> DataFrame:
    """(key, later, early): of each document the hashes that repeat, by whether an earlier document has them."""
    found = pairs.join(_repeated(pairs), "h")
    later = (F.col("first") < F.col("key")) | F.col("key").isNull()
    return found.groupBy("key").agg(F.collect_set(F.when(later, F.col("h"))).alias("later"), F.collect_set(F.when(~later, F.col("h"))).alias("early"))


def _kept_words(text: bytes, words: Words, i: int, removed: np.ndarray) -> bytes:
    a, b = words.bounds[i], words.bounds[i + 1]
    if not removed[a:b].any():
        return b" ".join(text.split())
    return b" ".join([w for w, r in zip(text.split(), removed[a:b].tolist()) if not r])


def _judged(df: DataFrame, text: str, key: str, length: int, start: int) -> tuple[DataFrame, DataFrame, str]:
    """(all documents, with the texts of those that still have candidates; hashes to remove by key; the key's type)."""
    key_type = df.schema[key].dataType.simpleString()
    rows = named(df, key=key, text=F.col(text).cast("binary"))
    levels = lengths(start, length)
    with_alive, before = None, None
    for short in levels[:-1]:
        pairs = _pairs(rows, key_type, short, length) if before is None else _extended(with_alive, key_type, before, short, length)
        alive = stored(_survivors(pairs).withColumnRenamed("key", "alive_key"), "repeated")
        with_alive = rows.join(alive, F.col("key").eqNullSafe(F.col("alive_key")), "left").drop("alive_key")
        before = short
    source = rows.withColumns({"later": F.lit(None).cast("array<bigint>"), "early": F.lit(None).cast("array<bigint>")}) if before is None else with_alive

    def candidates(batch):
        """Which windows are left, as one bit for each word, and which of them may have an earlier one."""
        words = Words(Texts(batch.column("text")))
        flags = np.zeros((2, len(words.hashes)), bool)
        if before is None:
            flags[:, words.windows(length)[0]] = True
        else:
            at, best = _chosen(words, before, length)
            for k, name in enumerate(("early", "later")):
                flags[k, at] = _alive(words, at, best, batch.column(name).to_pylist())
            flags[0] |= flags[1]
        spans = list(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()))
        some = [bool(flags[0, a:b].any()) for a, b in spans]
        column = batch.column("text")
        bits = [[np.packbits(flags[k, a:b]).tobytes() if s else None for s, (a, b) in zip(some, spans)] for k in (0, 1)]
        yield {"key": batch.column("key"), "n_words": words.counts, "open": bits[0], "later": bits[1],
               "text": pa.compute.if_else(pa.array(some), column, pa.nulls(len(column), column.type)),
               "clean": [None if s else _digest(words.texts.document(i)) for i, s in enumerate(some)]}

    state = stored(over_batches(source, candidates, f"key {key_type}, n_words bigint, open binary, later binary, text binary, clean string"), "windows")

    def flagged(which: str) -> DataFrame:
        def work(batch):
            words = Words(Texts(batch.column("text")))
            flags = np.zeros(len(words.hashes), bool)
            for i, bits in enumerate(batch.column(which).to_pylist()):
                a, b = words.bounds[i], words.bounds[i + 1]
                flags[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
            at, full = words.windows(length)
            hit = flags[at]
            yield {"h": signed(full[hit]), "key": batch.column("key").take(pa.array(words.documents()[at][hit]))}

        return over_batches(state.where("text is not null").select("key", "text", which), work, f"h bigint, key {key_type}")

    later = flagged("later").join(_repeated(flagged("open")), "h").where((F.col("first") < F.col("key")) | F.col("key").isNull())
    gone = later.groupBy(F.col("key").alias("gone_key")).agg(F.collect_set("h").alias("gone"))
    return state, stored(gone, "removed"), key_type


def _digest(text: bytes) -> str:
    return hashlib.sha256(b" ".join(text.split())).hexdigest()


def _extended(rows: DataFrame, key_type: str, before: int, short: int, length: int) -> DataFrame:
    """As ``_pairs``, for the windows that survived at the length before."""
    def work(batch):
        words = Words(Texts(batch.column("text")))
        at, old = _chosen(words, before, length)
        _, best = _chosen(words, short, length)
        ok = _alive(words, at, old, batch.column("later").to_pylist()) | _alive(words, at, old, batch.column("early").to_pylist())
        docs = words.documents()[at][ok]
        yield {"h": signed(best[ok]), "key": batch.column("key").take(pa.array(docs))}

    return over_batches(rows, work, f"h bigint, key {key_type}").distinct()


def _marked(words: Words, length: int, gone: list) -> np.ndarray:
    """Words covered by a window to be removed."""
    at, full = words.windows(length)
    hit = at[_alive(words, at, full, gone)]
    steps = np.zeros(len(words.hashes) + 1, np.int32)
    np.add.at(steps, hit, 1)
    np.add.at(steps, hit + length, -1)
    return np.cumsum(steps[:-1]) > 0


def digests(df: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, start: int = START) -> DataFrame:
    """Per row: key, n_words, n_removed and kept_sha256 (of the kept words, joined by a space).

    A word goes if a window of ``length`` words over it also begins in a
    document with a smaller key.  Windows are judged on the texts given.  A
    null text has no words.  Rows with the same key don't count as earlier than
    each other; a null key counts as larger than all others.
    """
    state, gone, key_type = _judged(df, text, key, length, start)

    def work(batch):
        words = Words(Texts(batch.column("text")))
        removed = _marked(words, length, batch.column("gone").to_pylist())
        n = np.bincount(words.documents()[removed], minlength=words.texts.n)
        yield {"key": batch.column("key"), "n_words": batch.column("n_words"), "n_removed": n,
               "kept_sha256": [hashlib.sha256(_kept_words(words.texts.document(i), words, i, removed)).hexdigest() for i in range(words.texts.n)]}

    rest = state.where("text is not null").select("key", "n_words", "text")
    rest = rest.join(gone, F.col("key").eqNullSafe(F.col("gone_key")), "left").select("key", "n_words", "text", "gone")
    done = over_batches(rest, work, f"key {key_type}, n_words bigint, n_removed bigint, kept_sha256 string")
    clean = state.where("text is null").select("key", "n_words", F.lit(0).cast("bigint").alias("n_removed"), F.col("clean").alias("kept_sha256"))
    return done.unionByName(clean).withColumnRenamed("key", key)


def dedup_passages(df: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, start: int = START) -> DataFrame:
    """``df`` with those words removed from the text; other columns as they are.

    What stands between the kept words stays, white space around a removed
    passage included.  Same rules as ``digests``; a text without removed words
    is untouched.
    """
    _, gone, _ = _judged(df, text, key, length, start)
    schema = df.schema
    names = schema.fieldNames()
    of, removed_at = fresh("gone_key", names), fresh("gone", names)
    gone = gone.select(F.col("gone_key").alias(of), F.col("gone").alias(removed_at))
    joined = df.join(gone, F.col(key).eqNullSafe(F.col(of)), "left").select(*names, removed_at)

    def run(batches):
        forget()
        for batch in blocks(batches):
            column = batch.column(names.index(text))
            words = Words(Texts(column))
            hits = batch.column(len(names)).to_pylist()
            removed = _marked(words, length, hits)
            out = []
            for i in range(words.texts.n):
                if hits[i] is None:
                    out.append(column[i].as_py())
                    continue
                a, b = words.bounds[i], words.bounds[i + 1]
                base, raw, parts, at = words.texts.bounds[i], words.texts.document(i), [], 0
                for s, e, r in zip(words.starts[a:b] - base, words.ends[a:b] - base, removed[a:b]):
                    if r:
                        parts.append(raw[at:s])
                        at = e
                out.append((b"".join(parts) + raw[at:]).decode())
            arrays = [pa.array(out, column.type) if c == text else batch.column(i) for i, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
            del arrays, out, words, removed, column, batch
        give_back()

    return joined.mapInArrow(run, schema)
