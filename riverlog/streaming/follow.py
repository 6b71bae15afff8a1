"""Live following: minute counts, under a watermark or corrected by late rows, counters and hooks, and alerts."""

from __future__ import annotations

import ast
import json
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators.anomaly import Detector
from ..operators.parse import parse
from ..sources.lines import shared_path
from .alerts import alerts
from .tail import TailSource

NO_BOUND = 1 << 62

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of (ts)."""
    rows = spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/event[s].parquet")  # a pattern, as the table may be one file or a folder
    return rows.select(F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"))


def line_stream(spark: SparkSession, paths: str | Sequence[str], from_start: bool = False, **options: int) -> DataFrame:
    """(value, path): lines of growing files. ``max_bytes`` and ``task_bytes`` bound what a batch takes of a file, and a task. A query with the
    trigger availableNow asks a source once, so it takes one batch: give it a ``max_bytes`` beyond all files (NO_BOUND)."""
    spark.dataSource.register(TailSource)
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.readStream.format("tail").option("path", json.dumps(paths)).option("from_start", str(from_start).lower()).options(**options).load()


def record_stream(lines: DataFrame, **options) -> DataFrame:
    """Records of a stream of lines. A record without a time keeps none: the time of its arrival would move the watermark of an older log to now."""
    return parse(lines.withColumn("line_no", F.lit(None).cast("long")), **options)


def minute_counts(records: DataFrame, delay: str = "2 minutes") -> DataFrame:
    """epoch, n of minutes that the watermark has closed; the open one waits. Rows that come later than ``delay`` aren't counted any
    more, and neither are records without a time; ``Follower`` hands both on."""
    rows = records.filter("ts is not null").withWatermark("ts", delay).groupBy(F.window("ts", "1 minute")).agg(F.count("*").alias("n"))
    return rows.select(F.unix_timestamp("window.start").alias("epoch"), "n")


def minute_totals(records: DataFrame) -> DataFrame:
    """epoch, n of every minute, for outputMode update: a batch brings the new totals of the minutes that it changed, however late its rows come.
    The state is a row a minute and stays, so that no row is dropped."""
    return records.filter("ts is not null").groupBy((F.floor(F.unix_timestamp("ts") / 60) * 60).alias("epoch")).agg(F.count("*").alias("n"))


def write_totals(totals: DataFrame, path: str, **trigger) -> StreamingQuery:
    """Starts a query that keeps ``minute_totals`` as files by batch; a batch that runs again replaces its files."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/batch_{number}")

    return totals.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(**trigger).start()


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    """The newest total of each minute that ``write_totals`` has kept; later totals of a minute are greater."""
    rows = spark.read.schema("epoch long, n long, batch int").parquet(f"{path}/rows/*")
    return rows.groupBy("epoch").agg(F.max_by("n", "batch").alias("n"), F.count("*").alias("versions"))


def run_minute_counts(spark: SparkSession, records: DataFrame, flush: bool = False) -> DataFrame:
    """Counts of what the stream holds now, as files under spark.checkpoint.dir. With ``flush`` the minutes that are still open come, too, and late rows count."""
    path = shared_path(spark, "minutes")
    if flush:
        write_totals(minute_totals(records), path, availableNow=True).awaitTermination()
        return read_totals(spark, path).select("epoch", "n")
    counts = minute_counts(records, "0 seconds")
    counts.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).outputMode("append").format("parquet").option("path", f"{path}/rows").start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{path}/rows")


class Follower:
    """Counts what a stream of lines brings, batch by batch, and hands it on: ``on_record`` and ``on_error`` get DataFrames of records and of
    unparsed lines (blank ones, too), ``on_late`` the records older than the newest time seen before by more than ``delay_seconds``, ``on_rotate`` and
    ``on_truncate`` the source's counts of these. Times are compared in epoch seconds."""

    def __init__(self, delay_seconds: int = 120, options: dict | None = None, **hooks: Callable):
        unknown = set(hooks) - {"on_record", "on_error", "on_late", "on_rotate", "on_truncate"}
        if unknown:
            raise ValueError(f"unknown hooks: {', '.join(sorted(unknown))}")
        self.delay, self.options, self.hooks, self.newest = delay_seconds, options or {}, hooks, None
        self.started, self.name = time.monotonic(), f"records-{uuid.uuid4().hex}"
        self.counts = {"lines": 0, "records": 0, "skipped": 0, "late": 0, "rotations": 0, "truncates": 0}

    @property
    def stats(self) -> dict:
        return {**self.counts, "runtime": time.monotonic() - self.started}

    def __call__(self, batch: DataFrame, _: int) -> None:
        parsed = parse(batch.withColumn("line_no", F.lit(None).cast("long")), keep_unparsed=True, **self.options).persist()
        good, epoch = F.col("parse_status") == "parsed", F.unix_timestamp("ts")
        is_late = good & (epoch < (self.newest or 0) - self.delay)
        found = parsed.agg(F.count("*").alias("lines"), F.count_if(good).alias("records"), F.count_if(is_late).alias("late"), F.max(F.when(good, epoch)).alias("newest")).first()
        for name in ("lines", "records", "late"):
            self.counts[name] += found[name]
        self.counts["skipped"] += found["lines"] - found["records"]
        for hook, rows, n in (("on_record", good, found["records"]), ("on_error", ~good, found["lines"] - found["records"]), ("on_late", is_late, found["late"])):
            if hook in self.hooks and n:
                self.hooks[hook](parsed.filter(rows))
        self.newest = max(x for x in (self.newest, found["newest"], 0) if x is not None)
        parsed.unpersist()

    def moved(self, end: dict) -> None:
        """Takes over what a source's offset has counted, and calls the hooks once for each rotation and truncation."""
        for name, hook in (("rotations", "on_rotate"), ("truncates", "on_truncate")):
            while self.counts[name] < end.get(name, 0):
                self.counts[name] += 1
                if hook in self.hooks:
                    self.hooks[hook](self.counts[name])


class Progress(StreamingQueryListener):
    """Hears of every batch of a follower's query, at any trigger."""

    def __init__(self, follower: Follower):
        self.follower = follower

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if event.progress.name == self.follower.name:
            for source in event.progress.sources:
                end = source.endOffset
                self.follower.moved((ast.literal_eval(end) if isinstance(end, str) else end) or {})  # Spark shows the source's offset as Python does

    def onQueryTerminated(self, event) -> None:
        pass


def follow(lines: DataFrame, on_spike: Callable[[dict], None] | None, checkpoint: str, follower: Follower, detector: Detector = Detector(), interval: str = "1 second", available_now: bool = False) -> list[StreamingQuery]:
    """Starts the query that hands batches of lines to ``follower``, and a listener that tells it of rotations, and the alert query if there is a callback for
    spikes. Alerts go on from ``checkpoint`` after a restart."""
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    lines.sparkSession.streams.addListener(Progress(follower))
    out = [lines.select("value").writeStream.queryName(follower.name).foreachBatch(follower).option("checkpointLocation", f"{checkpoint}/records").trigger(**trigger).start()]
    if on_spike:
        found = alerts(record_stream(lines, **follower.options), detector, follower.delay)

        def call(batch: DataFrame, _: int) -> None:
            for point in batch.orderBy("epoch").collect():  # alerts are few
                on_spike(point.asDict())

        out.append(found.writeStream.outputMode("append").foreachBatch(call).option("checkpointLocation", f"{checkpoint}/alerts").trigger(**trigger).start())
    return out
