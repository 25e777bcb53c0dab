"""IPv4 and IPv6 text handling with built-in expressions only.

Addresses stay in the JVM: a scan of raw logs never has to ship rows to Python
just because a few of them carry an IPv6 address.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame, functions as F

from .text import any_of

NO_ADDRESS = "<nil>"
_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"{_OCTET}(\.{_OCTET}){{3}}"
_GROUPS = "[0-9a-f]{1,4}(:[0-9a-f]{1,4})*"
_V6_SHAPE = f"^({_GROUPS}|{_GROUPS}::|::{_GROUPS}|{_GROUPS}::{_GROUPS}|::)$"


def is_v4(text: Column) -> Column:
    return text.rlike(f"^{_V4}$")


def _eight_groups(text: Column) -> Column:
    """Lower-case IPv6 text with ``::`` written out; NULL where it is malformed."""
    known = F.regexp_count(text, F.lit("[0-9a-f]+"))
    short = text.contains("::")
    zeros = F.concat(F.lit(":"), F.repeat(F.lit("0:"), F.lit(8) - known))
    valid = text.rlike(_V6_SHAPE) & F.when(short, known <= 7).otherwise(known == 8)
    return F.when(valid, F.when(short, F.btrim(F.replace(text, F.lit("::"), zeros), F.lit(":"))).otherwise(text))


def _hex_tail(text: Column) -> Column:
    """Lower case; a dotted IPv4 tail becomes two hex groups."""
    low = F.lower(text)
    octets = F.split(F.substring_index(low, ":", -1), r"\.")

    def pair(i: int) -> Column:
        high, low_part = (F.get(octets, F.lit(k)).try_cast("int") for k in (i, i + 1))
        return F.lower(F.hex(high * 256 + low_part))

    dotted = F.concat(F.regexp_extract(low, r"^([0-9a-f:]*:)", 1), pair(0), F.lit(":"), pair(2))
    return F.when(low.rlike(f"^[0-9a-f:]*:{_V4}$"), dotted).otherwise(low)


def _shortest(groups: Column) -> Column:
    """Longest run of zero groups as ``::`` (the first of equals)."""
    text = None
    for run in range(8, 1, -1):
        zeros = rf"(^|:)0(:0){{{run - 1}}}(:|$)"
        hit = groups.rlike(zeros)
        shorter = F.regexp_replace(groups, rf"^(.*?){zeros}(.*)$", "$1::$5")
        text = F.when(hit, shorter) if text is None else text.when(hit, shorter)
    return text.otherwise(groups)


def _mapped_v4(groups: Column) -> Column:
    """Dotted form of an IPv4 address in IPv6 clothing."""
    part = F.split(groups, ":")
    octets = []
    for i in (6, 7):
        value = F.conv(F.get(part, F.lit(i)), 16, 10).try_cast("int")
        octets += [F.floor(value / 256).cast("string"), (value % 256).cast("string")]
    return F.concat_ws(".", *octets)


def with_address(df: DataFrame, source: Column, name: str = "ip") -> DataFrame:
    """``df`` plus the canonical address of a ``remote_addr`` text.

    A comma list (forwarded-for form) stands for its first entry; what is no
    address is ``<nil>``.  The steps are projections of their own, so that each
    is computed once, and all but the first only for texts with a colon.
    """
    first = F.when(source.contains(","), F.trim(F.get(F.split(source, ","), F.lit(0)))).otherwise(source)
    steps = df.withColumn("_text", first)
    steps = steps.withColumn("_v6", F.when(F.col("_text").contains(":"), _hex_tail(F.col("_text"))))
    steps = steps.withColumn("_v6", F.when(F.col("_v6").isNotNull(), _eight_groups(F.col("_v6"))))
    groups = F.col("_v6")
    steps = steps.withColumn("_v6", F.when(groups.isNotNull(), F.regexp_replace(groups, r"(^|:)0{1,3}(?=[0-9a-f])", "$1")))
    v6 = F.when(groups.startswith("0:0:0:0:0:ffff:"), _mapped_v4(groups)).when(groups.isNotNull(), _shortest(groups))
    return steps.withColumn(name, F.coalesce(
        F.when(is_v4(F.col("_text")), F.col("_text")).when(groups.isNotNull(), v6), F.lit(NO_ADDRESS),
    )).drop("_text", "_v6")


def v6_hex(ip: Column) -> Column:
    """The 32 hex digits of a canonical IPv6 address; NULL for anything else."""
    padded = F.when(ip.contains(":"), _eight_groups(ip))
    for width in (1, 2, 3):
        padded = F.regexp_replace(padded, rf"(^|:)([0-9a-f]{{{width}}})(?=:|$)", "$1" + "0" * (4 - width) + "$2")
    return F.replace(padded, F.lit(":"), F.lit(""))


def v4_number(ip: Column) -> Column:
    """An IPv4 address as BIGINT; NULL for anything else."""
    part = F.split(ip, r"\.")
    number = sum((F.try_element_at(part, F.lit(i + 1)).try_cast("bigint") * 256 ** (3 - i) for i in range(4)),
                 F.lit(0).cast("bigint"))
    return F.when(is_v4(ip), number)


def _within(bounds):
    return lambda number: any_of(number.between(*b) for b in bounds)


def in_networks(ip: Column, cidrs) -> Column:
    """True where ``ip`` lies in one of a few networks (IPv4 or IPv6); ``<nil>`` never does.

    The address is converted once per version, however many networks there are.
    """
    nets = [ipaddress.ip_network(c, strict=False) for c in cidrs]
    tests = []
    for version, number in ((4, v4_number(ip)), (6, v6_hex(ip))):
        ranges = [(n.network_address, n.broadcast_address) for n in nets if n.version == version]
        bounds = [(int(a), int(b)) if version == 4 else (a.packed.hex(), b.packed.hex()) for a, b in ranges]
        if len(bounds) == 1:
            tests.append(number.between(*bounds[0]))
        elif bounds:
            tests.append(F.exists(F.array(number), _within(bounds)))
    return any_of(F.coalesce(t, F.lit(False)) for t in tests)
