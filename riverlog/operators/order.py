"""Order without a single task: places of rows, windows over neighbouring rows, and running sums that fade, each by blocks of rows.

Rows are range-partitioned and written once; counts of partitions give every row its place. Windows then run by block of neighbouring places, each
with a halo: the last rows of the block before it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.lines import kept

BLOCK = 4096


def numbered(rows: DataFrame, by: str, place: str = "place") -> DataFrame:
    """``rows`` with their place from 0 in the order of a column of distinct values. The rows are written to the shared folder."""
    dealt = kept(rows.repartitionByRange(by).withColumn("_task", F.spark_partition_id()), "ordered")
    tasks = dealt.groupBy("_task").agg(F.count("*").alias("_rows"))  # one row a partition
    tasks = tasks.select("_task", (F.sum("_rows").over(Window.orderBy("_task")) - F.col("_rows")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_task").orderBy(by)) - 1
    return dealt.withColumn("_within", within).join(F.broadcast(tasks), "_task").withColumn(place, F.col("_before") + F.col("_within")).drop("_task", "_before", "_within")


def with_neighbours(rows: DataFrame, reach: int, made, place: str = "place", block: int = BLOCK) -> DataFrame:
    """``rows`` with the columns of ``made(window)``, a dict: the window is ordered by place and holds ``reach`` rows before each row, at least."""
    size = max(block, reach)
    own = F.expr(f"{place} div {size}")
    halo = F.when(F.col(place) % size >= size - reach, F.array(own, own + 1)).otherwise(F.array(own))
    copies = rows.withColumn("_block", F.explode(halo))
    seen = copies.withColumns(made(Window.partitionBy("_block").orderBy(place)))
    return seen.filter(F.col("_block") == own).drop("_block")


def fading_sum(rows: DataFrame, x: Column, keep: float, first: Column, name: str, place: str = "place", longest: int = 100_000) -> DataFrame:
    """``rows`` with y[0] = first (as it is in the first row) and y[k + 1] = keep * y[k] + x[k], 0 <= keep < 1.

    A scan in two steps: within blocks, and over their sums. A block is so long that weights neither over- nor underflow, so only a few blocks
    before a row still count in doubles; ``reach`` of them are added up, all that are above zero.
    """
    if keep == 0:
        return with_neighbours(rows.withColumn("_x", x).withColumn("_first", first), 1, lambda w: {name: F.coalesce(F.lag("_x").over(w), "_first")}, place).drop("_x", "_first")
    digits = -math.log10(keep)
    size = max(1, min(longest, int(200 / digits)))
    reach = min(1_000_000, math.ceil(330 / (size * digits)))
    power = lambda n: F.pow(F.lit(keep), n)
    k = (F.col(place) % size).cast("double")
    rows = rows.withColumns({"_block": F.expr(f"{place} div {size}"), "_x": x, "_first": F.when(F.col(place) == 0, first)})
    sums = rows.groupBy("_block").agg(F.sum(F.col("_x") * power(size - 1 - k)).alias("_sum"), F.max("_first").alias("_first"))  # one row a block
    near = Window.orderBy("_block").rowsBetween(-reach, -1)
    before = F.aggregate(F.collect_list("_sum").over(near), F.lit(0.0), lambda y, s: y * F.lit(keep**size) + s)
    start = F.max("_first").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.select("_block", (before + start * power(F.col("_block").cast("double") * size)).alias("_before"))
    earlier = Window.partitionBy("_block").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum(F.col("_x") * power(-k - 1)).over(earlier), F.lit(0.0)) * power(k)
    return rows.withColumn("_within", within).join(F.broadcast(sums), "_block").withColumn(name, F.col("_before") * power(k) + F.col("_within")).drop("_block", "_x", "_first", "_before", "_within")
