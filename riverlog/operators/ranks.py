"""Exact percentiles of a column of any size, without a task that holds its values.

The rank of each percentile is narrowed by counts: all values between two bounds are counted by ``fan`` equal ranges, the range that holds the rank
becomes the new bounds, and so on until few values are left, or one. Each pass is a scan with partial counts, whatever the values are; only
counts by range reach the driver. The values left are counted and ranked at last.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAN = 1024
FEW = 20_000  # distinct values, at most about, that are ranked at once for each bound


@dataclass
class Bounds:
    """Values from low to high, both included, and the number of values below them."""

    low: float
    high: float
    below: int
    count: int


def _narrowed(rows: DataFrame, ranks: Sequence[int], whole: Bounds, fan: int, few: int) -> dict[int, Bounds]:
    """For each rank (from 0) bounds that hold it, of at most ``few`` values or one distinct value."""
    found = {r: whole for r in ranks}
    while open_ := sorted({(b.low, b.high) for b in found.values() if b.count > few and b.low < b.high}):
        v = F.col("v")

        def part(low: float, high: float, v: Column = v) -> Column:
            """The number of the equal range, from 0 to fan - 1; halves keep the span of the widest bounds finite."""
            if not (span := high / 2 - low / 2):  # next to zero halves vanish
                return F.when(v > low, fan - 1).otherwise(0)
            share = (v / 2 - F.lit(low / 2)) / F.lit(span)
            return F.greatest(F.lit(0), F.least(F.lit(fan - 1), F.floor(share * fan))).cast("int")

        inside = [F.when((v >= low) & (v <= high), F.struct(F.lit(k).alias("k"), part(low, high).alias("part"))) for k, (low, high) in enumerate(open_)]
        counts = rows.select("v", F.explode(F.filter(F.array(*inside), lambda x: x.isNotNull())).alias("x")).groupBy("x.k", "x.part")
        ranges: dict[int, list] = {}
        for r in counts.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("k", "part").collect():  # fan rows a bound
            ranges.setdefault(r["k"], []).append(r)
        at = {bounds: k for k, bounds in enumerate(open_)}
        for rank, b in list(found.items()):
            if (b.low, b.high) in at:
                below = b.below
                for r in ranges[at[b.low, b.high]]:
                    if rank < below + r["n"]:
                        found[rank] = Bounds(r["low"], r["high"], below, r["n"])
                        break
                    below += r["n"]
    return found


def percentiles(rows: DataFrame, value: str, ps: Sequence[float], fan: int = FAN, few: int = FEW) -> DataFrame:
    """One row: n, and q, an array of the percentiles ps (0 to 100) of the values that aren't null, interpolated between the two
    nearest ones; of no values nulls. NaN isn't a value."""
    values = rows.select(F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    n, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    places = [max(0.0, min(1.0, p / 100)) * (n - 1) for p in ps] if n else []
    ranks = sorted({r for x in places for r in (math.floor(x), math.ceil(x))})
    found = _narrowed(values, ranks, Bounds(low, high, 0, n), fan, few) if n else {}
    bounds = sorted({(b.low, b.high, b.below) for b in found.values()})
    empty = F.array().cast("array<struct<k:int,below:bigint>>")
    inside = F.array(*[F.when((F.col("v") >= a) & (F.col("v") <= b), F.struct(F.lit(k).alias("k"), F.lit(below).cast("long").alias("below"))) for k, (a, b, below) in enumerate(bounds)]) if bounds else empty
    kept = values.select("v", F.explode(F.filter(inside, lambda x: x.isNotNull())).alias("x")).groupBy("x.k", "x.below", "v").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")  # few values a bound
    ranked = kept.withColumn("start", F.col("below") + before).withColumn("end", F.col("start") + F.col("c"))
    at = lambda r: F.max(F.when((F.col("start") <= r) & (F.lit(r) < F.col("end")), F.col("v")))
    q = [at(math.floor(x)) + (at(math.ceil(x)) - at(math.floor(x))) * F.lit(x - math.floor(x)) for x in places] or [F.lit(None).cast("double") for _ in ps]
    return ranked.agg(F.lit(n).cast("long").alias("n"), F.array(*q).alias("q"))
