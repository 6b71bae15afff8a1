"""Summaries of records: totals, top lists by dimension, days, durations, latency by path, slowest requests.

One pass gives all totals; one long-form pass (dimension, key) gives all top lists, with partial sums before the shuffle. User
agents are counted first and only distinct ones are classified.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.agents import classify
from ..functions.text import is_error, num_text, size_text, status_class
from ..functions.times import iso_text
from .ranks import percentiles

DIMENSIONS = {"ip": "ip", "url": "path", "referer": "referer", "ua": "ua", "method": "method", "level": "level", "host": "host", "user": "user", "program": "program", "facility": "facility"}
AGENT_DIMENSIONS = ("browser", "os", "device", "kind")
LATENCY_WINDOW = 512


def epoch_of(ts: Column) -> Column:
    """Whole seconds, cut toward zero."""
    return F.call_function("div", F.unix_micros(ts), F.lit(1_000_000))


def percentile(c: Column, p: float) -> Column:
    """The p-th percentile of a group, interpolated between the two nearest values; the least up to 0, the greatest from 100 on."""
    return F.min(c).cast("double") if p <= 0 else F.max(c).cast("double") if p >= 100 else F.percentile(c, p / 100)


def median(c: Column) -> Column:
    return percentile(c, 50)


def clamp(c: Column, least: float, most: float) -> Column:
    return F.least(F.greatest(c, F.lit(least)), F.lit(most))


def peak(records: DataFrame, seconds: int) -> DataFrame:
    """epoch, n of the busiest minute (60) or hour (3600); of equal ones the first by its number as text."""
    at = epoch_of(F.col("ts"))
    rows = records.filter("ts is not null").groupBy((at - at % seconds).alias("epoch")).agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), F.col("epoch").cast("string")).limit(1)


def overview(records: DataFrame) -> DataFrame:
    """One row of totals. Distinct addresses, paths and agents are the numbers of their counts by key, so the totals need no copies of the rows."""
    rows = records.agg(
        F.count("*").alias("total"), F.count_if(is_error(F.col("status"), F.col("level"))).alias("errors"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes_total"), F.coalesce(F.max("bytes"), F.lit(0)).alias("bytes_max"),
        F.min(epoch_of(F.col("ts"))).alias("first_ts"), F.max(epoch_of(F.col("ts"))).alias("last_ts"),
    )
    names = {"ip": "uniq_ips", "url": "uniq_urls", "ua": "uniq_uas"}
    keys = dimension_counts(records, tuple(names)).filter("key != ''").agg(*[F.count_if(F.col("dim") == d).alias(name) for d, name in names.items()])
    both = rows.unionByName(keys, allowMissingColumns=True)  # two rows as one
    rows = both.agg(*[F.max(c).alias(c) for c in both.columns])
    span = F.coalesce(F.col("last_ts") - F.col("first_ts"), F.lit(0))
    rows = rows.withColumns({"span_seconds": span, "bytes_avg": F.when(F.col("total") > 0, F.floor(F.col("bytes_total") / F.col("total"))).otherwise(0), "error_rate": F.when(F.col("total") > 0, F.col("errors") * 100.0 / F.col("total")).otherwise(0.0)})
    return rows.withColumn("rps_avg", F.when(F.col("span_seconds") > 0, F.col("total") / F.col("span_seconds")).otherwise(0.0))


def type_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("type").agg(F.count("*").alias("n"))


def status_classes(records: DataFrame) -> DataFrame:
    """class, n for 1xx to 5xx."""
    return records.groupBy(status_class(F.col("status")).alias("class")).agg(F.count("*").alias("n")).filter("class != 'unknown'")


def status_codes(records: DataFrame) -> DataFrame:
    return records.filter("status is not null").groupBy("status").agg(F.count("*").alias("n"))


def top(counts: DataFrame, n: int, minimum: int | None = None, key: str = "key", count: str = "n") -> DataFrame:
    """The n largest counts, ties by key in byte order."""
    rows = counts if minimum is None else counts.filter(F.col(count) >= minimum)
    return rows.orderBy(F.desc(count), F.asc(key)).limit(max(0, n))


def dimension_counts(records: DataFrame, dimensions: Sequence[str] = tuple(DIMENSIONS)) -> DataFrame:
    """dim, key, n, bytes over several dimensions at once; empty keys don't count (but for methods, where only null doesn't)."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(DIMENSIONS[d]).alias("key")) for d in dimensions])
    rows = records.select(F.explode(pairs).alias("p"), "bytes").select("p.dim", "p.key", "bytes").filter("key is not null and (key != '' or dim = 'method')")
    return rows.groupBy("dim", "key").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def agent_counts(records: DataFrame) -> DataFrame:
    """dim, key, n for browsers, systems, devices and kinds. The agent of a record without one isn't counted."""
    agents = records.filter("ua is not null and ua != ''").groupBy("ua").agg(F.count("*").alias("n"))
    rows = agents.withColumn("c", classify(F.col("ua")))
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(f"c.{d}").alias("key")) for d in AGENT_DIMENSIONS])
    return rows.select(F.explode(pairs).alias("p"), "n").groupBy("p.dim", "p.key").agg(F.sum("n").alias("n"))


def top_dimensions(records: DataFrame, n: int = 10, dimensions: Sequence[str] = tuple(DIMENSIONS)) -> DataFrame:
    """dim, rank, key, n, bytes: the top lists of all dimensions."""
    order = Window.partitionBy("dim").orderBy(F.desc("n"), "key")
    return dimension_counts(records, dimensions).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def top_agents(records: DataFrame, n: int = 10) -> DataFrame:
    order = Window.partitionBy("dim").orderBy(F.desc("n"), "key")
    return agent_counts(records).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def days(records: DataFrame) -> DataFrame:
    return records.filter("ts is not null").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def durations(records: DataFrame) -> DataFrame:
    """count, avg, p50, p95, p99 (rounded half up) and max over all durations; the percentiles are narrowed by counts (see ``ranks``)."""
    rows = records.filter("duration_ms is not null").select("duration_ms")
    n, avg, most = rows.agg(F.count("*"), F.avg("duration_ms"), F.max("duration_ms")).first()
    half_up = lambda c: F.floor(c + 0.5)
    q = percentiles(rows, "duration_ms", (50, 95, 99))
    return q.select(F.col("n").alias("count"), F.lit(avg).cast("double").alias("avg"), *[half_up(F.col("q")[i]).alias(p) for i, p in enumerate(("p50", "p95", "p99"))], F.lit(most).cast("long").alias("max"))


def latency_by_path(records: DataFrame, n: int = 10, window: int = LATENCY_WINDOW) -> DataFrame:
    """path, count of all timed records, and avg, p50, p95, max of the newest ``window`` ones. Row numbers stop at the window on the map side."""
    rows = records.filter("duration_ms is not null").select(F.coalesce(F.nullif("path", F.lit("")), F.lit("-")).alias("path"), "duration_ms", "line_no")
    counts = rows.groupBy("path").agg(F.count("*").alias("count"))
    newest = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("line_no")))
    recent = rows.withColumn("r", newest).filter(F.col("r") <= window)
    q = F.percentile("duration_ms", F.array(F.lit(0.5), F.lit(0.95)))
    some = recent.groupBy("path").agg(F.avg("duration_ms").alias("avg"), q.alias("q"), F.max("duration_ms").alias("max"))
    half_up = lambda c: F.floor(c + 0.5)
    out = some.join(counts, "path").select("path", "count", "avg", half_up(F.col("q")[0]).alias("p50"), half_up(F.col("q")[1]).alias("p95"), "max")
    return out.orderBy(F.desc("p95"), F.desc("avg"), "path").limit(n)


def slowest(records: DataFrame, n: int = 10) -> DataFrame:
    rows = records.filter("duration_ms is not null")
    return rows.orderBy(F.desc("duration_ms"), "line_no").limit(n).select("duration_ms", "path", "ip", "line_no")


def summary(records: DataFrame, n: int = 10) -> dict:
    """All of the above as plain values for reports: each part is bounded by its top-n or by the number of types, codes and days.
    The columns that they need are kept after one pass over the records."""
    needed = sorted({"type", "ts", "line_no", "ip", "path", "status", "level", "bytes", "ua", "duration_ms", *DIMENSIONS.values()})
    records = records.select(*needed).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _summary(records, n)
    finally:
        records.unpersist()


def _summary(records: DataFrame, n: int) -> dict:
    rows = lambda df: [r.asDict() for r in df.collect()]
    total = overview(records).withColumns({"first_iso": iso_text(F.timestamp_seconds("first_ts")), "last_iso": iso_text(F.timestamp_seconds("last_ts"))}).first().asDict()
    total |= {"types": {r["type"]: r["n"] for r in type_counts(records).collect()}, "bytes_human": size_text(total["bytes_total"]), "error_rate": f"{total['error_rate']:.1f}", "rps_avg": f"{total['rps_avg']:.3f}", "total_human": num_text(total["total"])}
    for name, seconds in (("peak_minute", 60), ("peak_hour", 3600)):
        found = peak(records, seconds).withColumn("label", F.date_format(F.timestamp_seconds("epoch"), "yyyy-MM-dd HH:mm" if seconds == 60 else "yyyy-MM-dd HH:00")).first()
        total[name] = found.asDict() if found else None
    tops: dict[str, list] = {d: [] for d in (*DIMENSIONS, *AGENT_DIMENSIONS)}
    for r in sorted(rows(top_dimensions(records, n)) + rows(top_agents(records, n)), key=lambda r: r["rank"]):
        tops[r["dim"]].append(r)
    tops["referer"] = tops["referer"][:5]
    found = durations(records).first()
    return {
        "overview": total, "status_classes": {r["class"]: r["n"] for r in status_classes(records).orderBy("class").collect()},
        "status_codes": {r["status"]: r["n"] for r in status_codes(records).orderBy("status").collect()}, "top": tops, "days": rows(days(records).orderBy("day")),
        "durations": found.asDict() if found["count"] else None, "latency": rows(latency_by_path(records, n)), "slowest": rows(slowest(records)),
    }
