"""Helpers shared by the training-data operators: words, scratch tables and row wrapping."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BATCH = 4 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased, in order; an empty array for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, r"[\x20\x09-\x0D]+"), "")


def unit_hash(seed: int, *cols: Column) -> Column:
    """A uniform double in [0, 1) that depends on the seed and the columns only."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 53)) / F.lit(float(1 << 53))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder shared by driver and executors")
        root = "file:///tmp/checkpoints"
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def with_row_key(docs: DataFrame) -> DataFrame:
    """(has_id, doc_id, print, text): a key of rows. Rows that share an id are told apart by 64 bits of hash of their text,
    those without id by 128, half of which stand in for the id; equal rows have equal keys."""
    number, has_id = F.col("doc_id").cast("long"), F.col("doc_id").isNotNull()
    return docs.select(has_id.alias("has_id"), F.coalesce(number, F.xxhash64(F.lit(1), "text")).alias("doc_id"), F.xxhash64("text", has_id).alias("print"), "text")


def slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Borders of slices whose texts have about ``limit`` bytes, so that only few are held as objects at once."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    first = 0
    while first < len(texts):
        done = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, done + limit, "right")))
        yield first, last
        first = last


def parts(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``limit`` bytes of text in that column."""
    for batch in batches:
        for first, last in slices(batch.column(column), limit):
            yield batch.slice(first, last - first)


def bound_batches(spark: SparkSession) -> None:
    """Lets the session hand rows to Python in batches of about BATCH bytes. Spark's own bound of 64 MB, which each task holds several
    times, stays only where the session has set another one itself."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, f"{BATCH}b")


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs a reread and not a recomputation.

    ``drop`` removes a table that no returned frame reads; the rest goes when the driver ends. The shuffles that made a table go as soon as
    it is written, not when the driver next collects its garbage.
    """

    def __init__(self, spark: SparkSession, name: str):
        bound_batches(spark)
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/riverlog/{name}-{uuid.uuid4().hex}", 0
        atexit.register(self._end)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n}-{name}"

    def table(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        path, was = self.path(name), self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path, compression=compression)
        finally:
            self.spark.conf.set(CLEANUP, was)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
                _delete(self.spark, folder)

    def _end(self) -> None:
        try:
            _delete(self.spark, self.root)
        except Exception:  # the session has ended before: its folder is then the cluster's to clean
            pass


#: CRC-32 in SQL: the table of its 256 remainders, and the fold of a blob or text of bytes. DuckDB has no function for it.
CRC_TABLE_SQL = """crc_table AS (SELECT list(r ORDER BY i) AS r FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS r FROM range(256) AS x(i)))"""


def crc_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes; ``r`` of crc_table is to be in scope."""
    digit = lambda at: f"(strpos('0123456789ABCDEF', substr(hex(encode({text})), {at}, 1)) - 1)"
    size = f"(octet_length(encode({text})))"
    of_bytes = f"list_transform(range(1, {size} + 1), lambda j: ({digit('2 * j - 1')} * 16 + {digit('2 * j')})::BIGINT)"
    return f"xor(4294967295, list_reduce({of_bytes}, lambda c, b: xor(c // 256, r[xor(c % 256, b) + 1]), 4294967295::BIGINT))"
