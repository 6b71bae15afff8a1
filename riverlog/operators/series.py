"""Time buckets: counts, bytes and errors by interval, dense if wanted, with resampling and small charts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import human_num, human_size, is_error, num_text, size_text
from ..functions.times import bucket_label
from ..schema import UNIT_SECONDS
from .order import numbered
from .stats import epoch_of

MAX_BUCKETS = 200_000
VALUES = ("count", "bytes", "errors")
BLOCKS = " ▁▂▃▄▅▆▇█"


def unit_seconds(unit: str | int) -> int:
    text = str(unit)
    if text in UNIT_SECONDS:
        return UNIT_SECONDS[text]
    if re.fullmatch(r"[1-9]\d*", text):
        return int(text)
    raise ValueError(f"unknown unit '{unit}'")


def bucketize(records: DataFrame, unit: str | int = "minute", value: str = "count", fill: bool = True, since: int | None = None, until: int | None = None) -> DataFrame:
    """epoch, label, value, count, bytes, errors by bucket. ``since`` and ``until`` widen a filled grid and filter nothing.

    The grid runs between the least and greatest aggregated bucket, so records are read once; one of over MAX_BUCKETS buckets fails.
    """
    width = unit_seconds(unit)
    if value not in VALUES:
        raise ValueError(f"unknown value '{value}'")
    at = epoch_of(F.col("ts"))
    error = F.count_if(is_error(F.col("status"), F.col("level"))).alias("errors")
    rows = records.filter("ts is not null").groupBy((F.call_function("div", at, F.lit(width)) * width).alias("epoch")).agg(F.count("*").alias("count"), F.sum("bytes").alias("bytes"), error)
    if fill:
        whole = lambda x: F.lit(None if x is None else int(x / width) * width).cast("long")
        ends = rows.agg(F.min("epoch").alias("lo"), F.max("epoch").alias("hi")).filter("lo is not null")
        ends = ends.select(F.least("lo", whole(since)).alias("lo"), F.greatest("hi", whole(until)).alias("hi"))
        too_many = F.raise_error(F.lit(f"over {MAX_BUCKETS} buckets; take a wider unit")).cast("array<bigint>")
        grid = ends.select(F.explode(F.when((F.col("hi") - F.col("lo")) / width < MAX_BUCKETS, F.sequence("lo", "hi", F.lit(width).cast("long"))).otherwise(too_many)).alias("epoch"))
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        rows = grid.join(rows, "epoch", "left").select("epoch", zero("count"), zero("bytes"), zero("errors"))
    return rows.select("epoch", bucket_label(F.col("epoch"), str(unit)).alias("label"), F.col(value).alias("value"), "count", "bytes", "errors")


def series_stats(buckets: DataFrame) -> DataFrame:
    """One row: total records, buckets, min, max, mean, stddev, peak and its label (the first positive maximum)."""
    best = F.max_by(F.struct("epoch", "label", "value"), F.struct("value", -F.col("epoch")))
    zero = lambda c, n: F.coalesce(c, F.lit(0)).alias(n)
    rows = buckets.agg(zero(F.sum("count"), "total"), F.count("*").alias("buckets"), zero(F.min("value"), "min"), zero(F.max("value"), "max"), F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("stddev"), best.alias("best"))
    up = F.coalesce(F.col("best.value") > 0, F.lit(False))
    return rows.select("total", "buckets", "min", "max", "mean", "stddev", F.when(up, F.col("best.value")).otherwise(0).alias("peak"), F.when(up, F.col("best.label")).alias("peak_label"))


def resample(buckets: DataFrame, seconds: int) -> DataFrame:
    """Sums over wider buckets; they have no label."""
    if seconds <= 0:
        raise ValueError("width must be positive")
    wide = F.call_function("div", F.col("epoch"), F.lit(seconds)) * seconds
    return buckets.groupBy(wide.alias("epoch")).agg(*[F.sum(c).alias(c) for c in ("value", "count", "bytes", "errors")])


def _strides(n: int, width: int) -> list[tuple[int, int]]:
    step = n / width
    return [(int(i * step), min(int((i + 1) * step) - 1, n - 1)) for i in range(width)]


def sparkline(values: list[float], width: int | None = None) -> str:
    if not values:
        return ""
    if width and width < len(values):
        values = [max([values[a], *values[a : b + 1]]) for a, b in _strides(len(values), width)]
    low, span = min(values), (max(values) or 1) - min(values)
    return "".join(BLOCKS[int(((v - low) / span if span > 0 else 0) * 8 + 0.5)] for v in values)


def bar(value: float, most: float, width: int) -> str:
    if most <= 0:
        return ""
    return "#" * max(int(value / most * width + 0.5), 1 if value > 0 else 0)


def ascii_chart(buckets: list[dict], rows: int = 48, bar_width: int = 42, value: str = "count") -> str:
    """Bars of collected buckets; more of them than rows are summed by stride."""
    if not buckets:
        return ""
    if len(buckets) > rows:
        buckets = [{"label": buckets[a]["label"], "value": sum(x["value"] for x in buckets[a : b + 1])} for a, b in _strides(len(buckets), rows)]
    most = max(x["value"] for x in buckets) or 1
    wide = max(len(x["label"]) for x in buckets)
    show = size_text if value == "bytes" else num_text
    return "\n".join(f"{x['label']:<{wide}}  {bar(x['value'], most, bar_width):<{bar_width}}  {show(x['value']):>8}" for x in buckets)


def _strided(buckets: DataFrame, width: int, made: Column) -> DataFrame:
    """at, label, value of ``width`` runs of neighbouring buckets as even as whole numbers allow, or of the buckets if they are no more. A run's
    bounds are those of ``_strides``; the buckets are numbered by range partitions."""
    rows = numbered(buckets.select("epoch", "label", "value"), "epoch")
    if (count := rows.count()) <= width:
        return rows.select(F.col("place").alias("at"), "label", "value")
    step = count / width
    guess = F.floor(F.col("place") / step)  # may be off by one, as a run starts at a whole number
    start = lambda k: F.floor(k * step)
    at = F.when(F.col("place") < start(guess), guess - 1).when(F.col("place") >= start(guess + 1), guess + 1).otherwise(guess)
    return rows.groupBy(at.alias("at")).agg(F.min_by("label", "place").alias("label"), made.alias("value"))


def chart_rows(buckets: DataFrame, rows: int = 48, bar_width: int = 42, value: str = "count") -> DataFrame:
    """row, label, value, line: the lines of ``ascii_chart`` as rows, for any number of buckets."""
    drawn = _strided(buckets, rows, F.sum("value"))
    most, wide = (F.max(c).over(Window.partitionBy()) for c in ("value", F.length("label")))  # at most ``rows`` of them
    drawn = drawn.withColumns({"_most": F.coalesce(F.nullif(most, F.lit(0)), F.lit(1)), "_wide": wide})
    size = F.greatest(F.floor(F.col("value") / F.col("_most") * bar_width + 0.5), F.when(F.col("value") > 0, 1).otherwise(0)).cast("int")
    bars = F.when(F.col("_most") > 0, F.repeat(F.lit("#"), size)).otherwise("")
    shown = (human_size if value == "bytes" else human_num)(F.col("value"))
    line = F.concat(F.rpad("label", F.col("_wide"), F.lit(" ")), F.lit("  "), F.rpad(bars, F.lit(bar_width), F.lit(" ")), F.lit("  "), F.when(F.length(shown) >= 8, shown).otherwise(F.lpad(shown, 8, " ")))
    return drawn.select(F.col("at").cast("int").alias("row"), "label", "value", line.alias("line"))


def spark_marks(buckets: DataFrame, width: int) -> DataFrame:
    """at, value, mark: the characters of ``sparkline`` as rows, for any number of buckets."""
    drawn = _strided(buckets, width, F.max("value"))
    low, high = (f("value").over(Window.partitionBy()) for f in (F.min, F.max))  # at most ``width`` of them
    drawn = drawn.withColumns({"_low": low, "_span": F.coalesce(F.nullif(high, F.lit(0)), F.lit(1)) - low})
    level = F.when(F.col("_span") > 0, (F.col("value") - F.col("_low")) / F.col("_span")).otherwise(0.0)
    return drawn.select(F.col("at").cast("int").alias("at"), "value", F.substring(F.lit(BLOCKS), F.floor(level * 8 + 0.5).cast("int") + 1, F.lit(1)).alias("mark"))
