"""Top lists and distinct counts by mergeable sketches.

Top lists: frequent-item sketches, one a dimension and task, name candidates; these alone are counted exactly, in a join with a few thousand keys, so no
shuffle carries all keys. A sketch bounds the count of what it may have missed. If the last of a list is above that bound the list is exact; otherwise all
keys of that dimension are counted. Distinct counts: a sketch a day and dimension, which add up to any span of days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import DIMENSIONS, dimension_counts, top_dimensions

TRACKED = 10_000  # keys of a sketch
CANDIDATES = 1_000  # of a dimension that are counted
REGISTERS = 14  # 2 ** 14 registers: a standard error of 0.65 percent


def candidates(records: DataFrame, dimensions: Sequence[str], tracked: int = TRACKED, most: int = CANDIDATES) -> tuple[dict[str, list[str]], dict[str, int]]:
    """Keys by dimension that may be among the greatest, and the count that no other key exceeds. One pass for all dimensions."""
    key = lambda d: F.when(F.col(DIMENSIONS[d]).isNotNull() & ((F.col(DIMENSIONS[d]) != "") | F.lit(d == "method")), F.col(DIMENSIONS[d]))
    tops = [F.call_function("approx_top_k", key(d), F.lit(most), F.lit(tracked)).alias(d) for d in dimensions]
    row = records.agg(*tops, *[F.count(key(d)).alias(f"{d}_n") for d in dimensions]).first()
    size = 1 << (-(-tracked * 4 // 3) - 1).bit_length()  # places of the sketch's map
    found, missed = {}, {}
    for d in dimensions:
        items = [x for x in row[d] if x["item"] is not None]
        found[d] = [x["item"] for x in items]
        # a sketch's error is at most 3.5 / size of the stream; items of over twice that are named, unless the list was full before
        error = 2 * int(3.5 / size * row[f"{d}_n"])
        missed[d] = max(error, min(x["count"] for x in items)) if len(items) >= most else error
    return found, missed


def top_by_sketch(records: DataFrame, n: int = 10, dimensions: Sequence[str] = tuple(DIMENSIONS), tracked: int = TRACKED, most: int = CANDIDATES) -> DataFrame:
    """dim, rank, key, n, bytes: the same as ``top_dimensions``."""
    found, missed = candidates(records, dimensions, tracked, most)
    keys = records.sparkSession.createDataFrame([(d, k) for d, ks in found.items() for k in ks], "dim string, key string")  # at most ``most`` a dimension
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(DIMENSIONS[d]).alias("key")) for d in dimensions])
    rows = records.select(F.explode(pairs).alias("p"), "bytes").select("p.dim", "p.key", "bytes").join(F.broadcast(keys), ["dim", "key"])
    counts = rows.groupBy("dim", "key").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    lists = counts.withColumn("rank", F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("n"), "key"))).filter(F.col("rank") <= n)
    last = {r["dim"]: (r["least"], r["size"]) for r in lists.groupBy("dim").agg(F.min("n").alias("least"), F.count("*").alias("size")).collect()}
    # a short list is exact if nothing at all can be missed
    unsure = [d for d in dimensions if (last.get(d, (0, 0))[1] < n and missed[d] > 0) or (last.get(d, (0, 0))[1] >= n and last[d][0] <= missed[d])]
    out = lists.select("dim", "rank", "key", "n", "bytes")
    if not unsure:
        return out
    whole = top_dimensions(records, n, unsure).select("dim", "rank", "key", "n", "bytes")
    return out.filter(~F.col("dim").isin(unsure)).unionByName(whole)


def distinct_sketches(records: DataFrame, dimensions: Sequence[str] = ("ip", "url", "ua")) -> DataFrame:
    """day, dim, sketch: what a day adds to distinct counts, in 16 KB at most. Records without a time have a null day."""
    key = lambda d: F.nullif(F.col(DIMENSIONS[d]), F.lit(""))
    rows = records.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(*[F.hll_sketch_agg(key(d), REGISTERS).alias(d) for d in dimensions])
    return rows.select("day", F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("sketch")) for d in dimensions])).alias("x")).select("day", "x.*")


def distinct_estimates(sketches: DataFrame) -> DataFrame:
    """dim, estimate over the days of ``sketches``; off by 0.65 percent as a standard error, 2 percent at three of them."""
    return sketches.groupBy("dim").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def distinct_counts(records: DataFrame, dimensions: Sequence[str] = ("ip", "url", "ua")) -> DataFrame:
    """dim, n: exact, from the counts by key."""
    return dimension_counts(records, dimensions).filter("key != ''").groupBy("dim").agg(F.count("*").alias("n"))
