"""Exact percentiles that never hold a group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

# Value slices are 2 % wide on a logarithmic scale: an order-preserving split of
# any range of doubles into a few thousand parts at most.
_SLICES_PER_E = 50
# Slices that hold a wanted rank are cut again into this many parts.
_PARTS = 1024


def _place(value: Column) -> Column:
    return F.ln(F.greatest(value, F.lit(1e-9))) * _SLICES_PER_E


def slice_of(value: Column) -> Column:
    return F.floor(_place(value))


def part_of(value: Column) -> Column:
    return F.floor((_place(value) - F.floor(_place(value))) * _PARTS)


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], weight: str | None = None) -> DataFrame:
    """Percentiles by linear interpolation, one column per entry of ``probs``.

    ``weight``: a column that says how often each row's value counts.

    ``percentile`` would keep every distinct value of a key in one buffer.
    Here rows are first counted per (key, value), which map-side combining
    shrinks; the counts per slice then tell which slices hold the wanted ranks.
    These are cut into parts, which are counted in the same way, and only the
    parts that hold a wanted rank are sorted: some 0.002 % of the values of an
    even spread, each part on its own.
    """
    counts = (df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v"))
              .agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
              .withColumns({"_slice": slice_of(F.col("_v")), "_part": part_of(F.col("_v"))}))
    slices = counts.groupBy(*keys, "_slice").agg(F.sum("_n").alias("_in_slice"))
    return ranks_in(counts, slices_of_ranks(slices, keys, probs), keys, probs)


def _places(probs: dict[str, float]) -> dict[str, Column]:
    return {name: F.lit(float(p)) * (F.col("_total") - 1) for name, p in probs.items()}


def _holds(rank: Column, start: Column, size: Column) -> Column:
    return (start <= rank) & (rank < start + size)


def _wanted(probs: dict[str, float], size: str) -> Column:
    hits = [_holds(rank, F.col("_before"), F.col(size)) for place in _places(probs).values() for rank in (F.floor(place), F.ceil(place))]
    return reduce(lambda a, b: a | b, hits)


def slices_of_ranks(slices: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """Of counted ``slices`` (keys, ``_slice``, ``_in_slice``) those that hold a wanted rank, with what lies before them."""
    key_rows = Window.partitionBy(*keys)
    ranked = slices.select(
        *keys, "_slice", "_in_slice",
        F.coalesce(F.sum("_in_slice").over(
            key_rows.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_in_slice").over(key_rows).alias("_total"))
    return ranked.where(_wanted(probs, "_in_slice"))


def ranks_in(counts: DataFrame, chosen: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """The percentiles from ``counts`` (keys, ``_v``, ``_n``, ``_slice``, ``_part``; each value once) of at least the ``chosen`` slices."""
    places = _places(probs)
    parts = counts.join(chosen, [*keys, "_slice"]).groupBy(*keys, "_slice", "_part").agg(
        F.sum("_n").alias("_in_part"), F.first("_before").alias("_slice_before"), F.first("_total").alias("_total"))
    slice_rows = Window.partitionBy(*keys, "_slice").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("_before", F.col("_slice_before") + F.coalesce(F.sum("_in_part").over(slice_rows), F.lit(0))).where(_wanted(probs, "_in_part"))
    in_part = Window.partitionBy(*keys, "_slice", "_part").orderBy("_v")
    picked = counts.join(placed.select(*keys, "_slice", "_part", "_before", "_total"), [*keys, "_slice", "_part"]).withColumn(
        "_start", F.col("_before") + F.sum("_n").over(in_part) - F.col("_n"))

    def at(rank: Column) -> Column:
        return F.max(F.when(_holds(rank, F.col("_start"), F.col("_n")), F.col("_v")))

    bounds = [c for name, place in places.items() for c in (
        at(F.floor(place)).alias(f"_lo_{name}"), at(F.ceil(place)).alias(f"_hi_{name}"))]
    found = picked.groupBy(*keys).agg(F.max("_total").alias("_total"), *bounds)

    def between(name: str) -> Column:
        low, high, place = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), places[name]
        return F.when(low == high, low).otherwise(
            low * (F.ceil(place) - place) + high * (place - F.floor(place)))

    return found.select(*keys, *[between(name).alias(name) for name in probs])
