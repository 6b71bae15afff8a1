"""Raw lines: files with line numbers over all of them, or lines given in memory."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterable, Sequence
from itertools import islice

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, paths: str | Sequence[str], numbered: bool = True) -> DataFrame:
    """(line_no, value): lines of the files in the order given, split at line feeds only.

    Numbers come from counts by input split, so nothing is sorted and no file passes through one task; the counts are joined by split, broadcast
    only where Spark finds them small. ``numbered=False`` leaves numbers null and saves the count.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    rows = None
    for at, path in enumerate(paths):
        one = spark.read.option("lineSep", "\n").text(path).select(F.lit(at).alias("file"), F.col("_metadata.file_path").alias("name"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), "value")
        rows = one if rows is None else rows.unionByName(one)
    value = F.regexp_replace("value", "\r$", "")
    if not numbered:
        return rows.select(F.lit(None).cast("long").alias("line_no"), value.alias("value"))
    return numbered_by_split(rows).select("line_no", value.alias("value"))


def numbered_by_split(rows: DataFrame) -> DataFrame:
    """Rows of input splits (file, name, block), numbered from 1 as ``line_no`` in the order of files and blocks, by their ``i`` within a split."""
    part = ["file", "name", "block"]
    counts = rows.groupBy(*part).agg(F.count("*").alias("n"), F.min("i").alias("first"))  # one row a split
    # splits within a file first, then the files
    within = F.sum("n").over(Window.partitionBy("file", "name").orderBy("block")) - F.col("n")
    files = counts.groupBy("file", "name").agg(F.sum("n").alias("lines"))  # one row a file
    earlier = files.select("file", "name", (F.sum("lines").over(Window.orderBy("file", "name")) - F.col("lines")).alias("earlier"))
    starts = counts.withColumn("within", within).join(earlier, ["file", "name"]).select(*part, "first", (F.col("within") + F.col("earlier")).alias("before"))
    return rows.join(starts, part).withColumn("line_no", F.col("before") + F.col("i") - F.col("first") + 1)


def from_lines(spark: SparkSession, lines: Iterable[str]) -> DataFrame:
    """(line_no, value) of lines in memory."""
    return spark.createDataFrame([(i, line.rstrip("\n").removesuffix("\r")) for i, line in enumerate(lines, 1)], "line_no long, value string")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or a local one in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder shared by driver and executors")
        root = "file:///tmp/checkpoints"
    return f"{root.rstrip('/')}/riverlog/{name}-{uuid.uuid4().hex}"


_KEPT: list[tuple[SparkSession, str]] = []


def kept(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a table in the shared folder, so that a lost executor costs a reread. The table goes when the driver ends."""
    spark, path = rows.sparkSession, shared_path(rows.sparkSession, name)
    if not _KEPT:
        atexit.register(_forget)
    _KEPT.append((spark, path))
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _forget() -> None:
    for spark, path in _KEPT:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended before: its folder is then the cluster's to clean
            return


def spool(spark: SparkSession, lines: Iterable[str], step: int = 100_000) -> DataFrame:
    """(line_no, value) of lines that come from anywhere, such as standard input: ``step`` at a time go to a table in the shared
    folder, so the driver never holds more."""
    path, count, lines = shared_path(spark, "lines"), 0, iter(lines)
    from_lines(spark, []).write.parquet(path)
    while some := list(islice(lines, step)):
        from_lines(spark, some).select((F.col("line_no") + count).alias("line_no"), "value").write.mode("append").parquet(path)
        count += len(some)
    return spark.read.schema("line_no long, value string").parquet(path)
