"""Addresses in many networks.

Up to a size, networks are an interval index: merged, sorted, disjoint ranges,
sent to all tasks and looked up by bisection.  Beyond it they stay a table: the
different addresses are joined with it by their prefixes, and the rows are then
restricted to the addresses found.
"""

from __future__ import annotations

import ipaddress
import socket
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.addresses import v4_number, v6_hex
from .keys import restrict_counted

#: Bytes of an index that may be sent to every task: two million networks of IPv4 and IPv6 each.
SENT = 96 << 20
_WIDTH = {4: 4, 6: 16}


def _bounds(cidr: str) -> tuple[int, int, int]:
    """(version, first, last) of a network; host bits are ignored."""
    address, _, length = cidr.strip().partition("/")
    version = 6 if ":" in address else 4
    bits = 8 * _WIDTH[version]
    try:
        value = int.from_bytes(socket.inet_pton(socket.AF_INET6 if version == 6 else socket.AF_INET, address), "big")
        host = bits - (int(length) if length else bits)
        if not 0 <= host <= bits:
            raise ValueError(f"no network: {cidr}")
    except (OSError, ValueError):  # other spellings, and what is none
        net = ipaddress.ip_network(cidr.strip(), strict=False)
        return net.version, int(net.network_address), int(net.broadcast_address)
    first = value >> host << host
    return version, first, first | (1 << host) - 1


class NetworkIndex:
    """Disjoint ranges of IPv4 and IPv6 addresses, ascending; as big-endian bytes, which sort like numbers."""

    def __init__(self, cidrs: Iterable[str]):
        found: dict[int, list[tuple[int, int]]] = {4: [], 6: []}
        for cidr in cidrs:
            version, first, last = _bounds(cidr)
            found[version].append((first, last))
        self.ranges = {v: self._merged(sorted(ranges), _WIDTH[v]) for v, ranges in found.items()}

    @staticmethod
    def _merged(ranges: list[tuple[int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
        merged: list[list[int]] = []
        for first, last in ranges:
            if merged and first <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], last)
            else:
                merged.append([first, last])
        return tuple(np.array([r[k].to_bytes(width, "big") for r in merged], f"S{width}") for k in (0, 1))

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for pair in self.ranges.values() for a in pair)

    def __len__(self) -> int:
        return sum(len(low) for low, _ in self.ranges.values())

    def contains(self, addresses: pd.Series) -> np.ndarray:
        """By bisection, once for each different address; what is no address is in no network."""
        codes, different = pd.factorize(addresses)
        hit = np.zeros(len(different) + 1, bool)  # the last one for nulls
        packed: dict[int, list[tuple[int, bytes]]] = {4: [], 6: []}
        for i, text in enumerate(different):
            version = 6 if ":" in text else 4
            try:
                packed[version].append((i, socket.inet_pton(socket.AF_INET6 if version == 6 else socket.AF_INET, text)))
            except OSError:
                continue
        for version, known in packed.items():
            low, high = self.ranges[version]
            if known and len(low):
                values = np.array([v for _, v in known], low.dtype)
                at = np.searchsorted(low, values, "right") - 1
                hit[[i for i, _ in known]] = (at >= 0) & (values <= high[np.maximum(at, 0)])
        return hit[codes]

    def holds(self, spark: SparkSession, address: Column) -> Column:
        """True where the address is in one of the networks.  Only addresses reach Python, in Arrow batches."""
        shared = spark.sparkContext.broadcast(self)

        @F.pandas_udf("boolean")
        def inside(addresses: pd.Series) -> pd.Series:
            return pd.Series(shared.value.contains(addresses))

        return inside(address)


def _prefix(version: int, length: int) -> Column:
    """The first ``length`` bits of the column ``_bits<version>`` as text."""
    return F.concat(F.lit(f"{version}/{length}/"), F.substring(f"_bits{version}", 1, length))


def _with_bits(df: DataFrame, address: Column) -> DataFrame:
    """``df`` with the address in binary digits: 32 in ``_bits4`` or 128 in ``_bits6``."""
    digits = F.filter(F.split(v6_hex(address), ""), lambda d: d != "")
    return df.withColumns({
        "_bits4": F.lpad(F.bin(v4_number(address)), 32, "0"),
        "_bits6": F.when(address.contains(":"), F.array_join(F.transform(digits, lambda d: F.lpad(F.conv(d, 16, 2), 4, "0")), ""))})


def in_network_frame(df: DataFrame, table: DataFrame, network: str = "network", spread: str = "seq") -> DataFrame:
    """Rows of ``df`` whose ``ip`` lies in one of the networks of a table of any size, each row once.

    A network must be written in canonical lower-case form, as ``ip`` is.  Each different address has one prefix for
    every prefix length that occurs in the table (at most 162), and meets the table there.
    """
    text = F.col(network)
    parts = table.where(text.isNotNull()).select(F.substring_index(text, "/", 1).alias("_address"), F.when(text.contains("/"), F.substring_index(text, "/", -1).cast("int")).alias("_length"))
    parts = _with_bits(parts, F.col("_address")).withColumn("_version", F.when(F.col("_bits4").isNotNull(), 4).when(F.col("_bits6").isNotNull(), 6))
    parts = parts.where("_version is not null").withColumn("_length", F.coalesce("_length", F.when(F.col("_version") == 4, 32).otherwise(128)))
    lengths = [(r["_version"], r["_length"]) for r in parts.select("_version", "_length").distinct().collect()]
    if not lengths:
        return df.where("false")
    bits = F.when(F.col("_version") == 4, F.col("_bits4")).otherwise(F.col("_bits6"))
    known = parts.select(F.concat_ws("/", F.col("_version").cast("string"), F.col("_length").cast("string"), bits.substr(F.lit(1), F.col("_length"))).alias("_prefix")).distinct()
    ips = _with_bits(df.select("ip").where("ip is not null").distinct(), F.col("ip"))
    candidates = ips.select("ip", F.explode(F.array_compact(F.array(*[_prefix(v, n) for v, n in lengths]))).alias("_prefix"))
    return restrict_counted(df, candidates.join(known, "_prefix", "left_semi").select("ip"), "ip", spread)
