"""Placement of keys on shards by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a table of prime
size.  The shards take turns, and each claims the first slot of its order that
is still free.  A key hashes to a slot, so placing it is one look-up; when the
set of shards changes, most slots keep their shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

#: A prime; a table of this size stays within 1 % of even for up to some 650 shards.
SLOTS = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: Sequence[str], slots: int = SLOTS) -> np.ndarray:
    """The table: at each slot the position of its shard in ``shards``.

    The order of a shard is ``offset, offset + skip, ...`` modulo the prime
    size, which visits every slot.  The names must differ, and there may not
    be more shards than slots.
    """
    if not _is_prime(slots):
        raise ValueError("the number of slots must be a prime")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("needs at least one shard, different names, and no more shards than slots")
    place = [_number(f"offset/{s}") % slots for s in shards]
    skip = [_number(f"skip/{s}") % (slots - 1) + 1 for s in shards]
    table = np.full(slots, -1, np.int32)
    left = slots
    while left:
        for i in range(len(shards)):
            while table[place[i]] >= 0:
                place[i] = (place[i] + skip[i]) % slots
            table[place[i]] = i
            left -= 1
            if not left:
                break
    return table


def slot_of(key, slots: int = SLOTS):
    """The slot of a key column: 60 bits of the md5 of its text, modulo the table's size. A null key is placed as the empty text."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint"), F.lit(slots))


def place(df: DataFrame, key: str, shards: Sequence[str], slots: int = SLOTS, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """``df`` with the slot and the shard of each row; columns of these names are replaced.

    The broadcast table has ``slots`` rows whatever the size of ``df``, so its
    size is fixed by that parameter.  No row of ``df`` is shuffled.  Rows with
    equal keys, repeated rows and null keys each get the place of their key.
    """
    names = list(shards)
    rows = [(int(slot), names[i]) for slot, i in enumerate(fill(names, slots))]
    table = df.sparkSession.createDataFrame(rows, "_place_slot bigint, _place_shard string")
    kept = [c for c in df.columns if c not in (slot_col, shard_col)]
    keyed = df.select(*kept, slot_of(key, slots).alias("_place_key"))
    return (keyed.join(F.broadcast(table), F.col("_place_key") == F.col("_place_slot"), "left")
            .select(*kept, F.col("_place_slot").alias(slot_col), F.col("_place_shard").alias(shard_col)))


def moved_slots(before: Sequence[str], after: Sequence[str], slots: int = SLOTS) -> float:
    """The share of slots, and so of keys, that change their shard between two sets of shards."""
    a, b = fill(before, slots), fill(after, slots)
    return float(np.mean(np.array(before, object)[a] != np.array(after, object)[b]))


def write_shards(df: DataFrame, key: str, shards: Sequence[str], path: str, slots: int = SLOTS, files: int = 1) -> None:
    """One folder of Parquet files for each shard.

    Every shard gets ``files`` tasks; the rows of a shard are dealt over them
    by a hash of the whole row's key and a salt, so one hot key fills no single file.
    """
    placed = place(df, key, shards, slots)
    salt = F.floor(F.rand(17) * files)
    placed.repartition("shard", salt).write.partitionBy("shard").parquet(path)
