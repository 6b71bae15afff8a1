"""Operator 12: importance resampling towards a target distribution.

Every document is weighed by how much likelier its features (runs of words, hashed to buckets) are in a target corpus than in the raw one,
and a share of the documents that are long enough is drawn without replacement: the greatest scores of weight plus Gumbel noise.
Two passes in Arrow. The first turns each partition into a vector of bucket counts (``np.bincount``), and ``treeReduce`` merges these; the
second sums the gains of each document's buckets (``np.bincount`` with weights). Only vectors of ``buckets`` long reach the driver or are
broadcast. The ranks of the drawn documents come from counts by range partition, so no task orders all of them.

Defined results: a null or empty text has no features, weight 0 and is never drawn; without target texts every feature's target count is 0;
a null doc_id hashes like an empty text and comes last among ties; repeated rows have a result each and neighbouring ranks; an empty table gives an
empty result; further columns don't matter, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CRC_TABLE_SQL, LOWER, UPPER, Scratch, bound_batches, crc_sql, parts, read_table
from .mixing import running_total

#: A-Z become a-z; every other ASCII character that is neither letter nor digit becomes a blank.
TABLE = bytes(ord(chr(b).lower()) if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
ADDED = ("n_words", "n_features", "weight", "score", "rank")


@dataclass(frozen=True)
class ResamplingSettings:
    n: int = 1  # features are runs of 1 to n words
    buckets: int = 10_000
    scale: int = 1000  # of logarithms, which are floored to whole numbers
    min_words: int = 20
    percent: int = 10  # of the documents with at least min_words
    seed: int = 2024
    chunk_bytes: int = 1_000_000


def _features(texts: list[bytes], s: ResamplingSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; then the text and the bucket of every feature."""
    split = [t.translate(TABLE).split() for t in texts]
    n_words = np.fromiter(map(len, split), np.int64, len(split))
    owner = np.repeat(np.arange(len(texts)), n_words)
    code, distinct = pd.factorize(np.array([w for x in split for w in x], dtype=object))
    owners, buckets, run = [], [], code
    names = list(distinct)
    for k in range(1, s.n + 1):
        if k > 1:  # the runs of k words: those of k - 1 and the word after them, within a text
            inside = np.flatnonzero(owner[k - 1 :] == owner[: len(owner) - k + 1]) if len(owner) >= k else np.empty(0, np.int64)
            pair, first = np.unique(run[inside] * len(distinct) + code[inside + k - 1], return_index=True) if len(inside) else (np.empty(0, np.int64), inside)
            names = [b" ".join(split_at) for split_at in ([distinct[code[inside[i] + j]] for j in range(k)] for i in first)]
            fresh = np.full(len(run), -1, np.int64)
            fresh[inside] = np.searchsorted(pair, run[inside] * len(distinct) + code[inside + k - 1])
            run = fresh
        else:
            inside = np.arange(len(owner))
        of_name = np.fromiter((zlib.crc32(w) % s.buckets for w in names), np.int64, len(names))
        owners.append(owner[inside])
        buckets.append(of_name[run[inside]] if len(inside) else inside)
    return n_words, np.concatenate(owners), np.concatenate(buckets)


def _encoded(texts: pa.Array) -> list[bytes]:
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


def bucket_counts(rows: DataFrame, text_col: str = "text", settings: ResamplingSettings = ResamplingSettings()) -> np.ndarray:
    """Features of all texts by bucket. Vectors of partitions merge in a tree, so the driver gets few of them."""
    s = settings
    bound_batches(rows.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(s.buckets, np.int64)
        for part in parts(batches, 0, s.chunk_bytes):
            total += np.bincount(_features(_encoded(part.column(0)), s)[2], minlength=s.buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["counts"])

    vectors = rows.select(F.col(text_col).alias("text")).mapInArrow(counted, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    vectors = vectors.union(rows.sparkSession.sparkContext.parallelize([np.zeros(s.buckets, np.int64)], 1))  # there may be no partition
    return vectors.treeReduce(np.add, depth=max(2, math.ceil(math.log(vectors.getNumPartitions(), 64))))  # at most some 64 vectors meet in one place


def gains(raw: np.ndarray, target: np.ndarray, settings: ResamplingSettings = ResamplingSettings()) -> np.ndarray:
    """What one feature of each bucket adds to a weight: the scaled log ratio of both smoothed distributions, floored."""
    s, all_raw, all_target = settings, float(raw.sum()), float(target.sum())
    ratio = ((target + 1.0) * (all_raw + s.buckets)) / ((raw + 1.0) * (all_target + s.buckets))
    return np.array([math.floor(s.scale * math.log(x)) for x in ratio], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, text_col: str = "text", settings: ResamplingSettings = ResamplingSettings(), keep: list[str] | None = None) -> DataFrame:
    """The columns of ``docs``, or those to ``keep``, with n_words, n_features and weight."""
    s, shared = settings, docs.sparkSession.sparkContext.broadcast(gain)
    bound_batches(docs.sparkSession)

    rest = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    schema = T.StructType([*docs.select(*rest).schema.fields, *(T.StructField(c, T.LongType()) for c in ADDED[:3])])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 0, s.chunk_bytes):
            n_words, owner, bucket = _features(_encoded(part.column(0)), s)
            whole, low = np.divmod(shared.value[bucket], 1 << 20)  # both halves add up exactly in doubles
            weight = np.bincount(owner, whole, len(part)).astype(np.int64) * (1 << 20) + np.bincount(owner, low, len(part)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(n_words), pa.array(np.bincount(owner, minlength=len(part))), pa.array(weight)], schema.names)

    return docs.select(F.col(text_col).alias("_features_of"), *rest).mapInArrow(of, schema)


def noise(doc_id: Column, s: ResamplingSettings) -> Column:
    """Scaled Gumbel noise of a document's id, floored."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{s.seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-float(s.scale) * F.log(-F.log(uniform)))


def ranked(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", settings: ResamplingSettings = ResamplingSettings()) -> DataFrame:
    """The id, n_words, n_features, weight, score and rank of every row of ``docs``; rank is null for the documents that aren't drawn.

    The ranks need the number of documents above each: those that are long enough are range-partitioned by score, id and features
    (without their texts) and numbered by counts of partitions.
    """
    s, scratch = settings, Scratch(docs.sparkSession, "resample")
    gain = gains(bucket_counts(docs, text_col, s), bucket_counts(target, target_col, s), s)
    rows = weighed(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), gain, "_text", s, ["_id"])
    rows = rows.withColumnRenamed("_id", id_col).withColumn("score", F.col("weight") + noise(F.col(id_col), s))
    key = [id_col, "n_words", "n_features", "weight", "score"]
    # equal rows are one row of the order with the number of its copies, so that a row repeated any number of times goes to no single task
    found = rows.groupBy(*key).agg(F.count("*").alias("_copies"))
    found = scratch.table(found, "scores")
    total = found.filter(F.col("n_words") >= s.min_words).agg(F.coalesce(F.sum("_copies"), F.lit(0))).first()[0]
    drawn = total * s.percent // 100
    enough = found.filter(F.col("n_words") >= s.min_words).withColumn("_all", F.lit(0))
    order = [F.col("score").desc(), F.col(id_col).asc_nulls_last(), F.col("n_features"), F.col("n_words")]
    placed = running_total(enough, "_all", order, "_copies", "_before", scratch).drop("_all")
    short = found.filter(F.col("n_words") < s.min_words).withColumn("_before", F.lit(None).cast("long"))
    both = placed.unionByName(short)
    rank = F.col("_before") + F.col("_copy")
    out = both.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
    return out.select(*key, F.when(rank <= drawn, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", settings: ResamplingSettings = ResamplingSettings()) -> DataFrame:
    """The drawn rows of ``docs``, as they are. Ids are to be unique: of rows that share one, all are drawn if one is."""
    drawn = ranked(docs, target, id_col, text_col, target_col, settings).filter("rank is not null").select(F.col(id_col).alias("_id")).distinct()
    return docs.join(drawn, F.col(id_col).eqNullSafe(F.col("_id")), "left_semi")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark").select("text")
    return ranked(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = f"""
WITH {CRC_TABLE_SQL},
said AS (SELECT doc_id, row_number() OVER () AS n, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
wanted AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
words AS (SELECT n, unnest(w) AS word FROM said),
goal_words AS (SELECT unnest(w) AS word FROM wanted),
known AS (SELECT word, {crc_sql('word')} % 10000 AS b FROM (SELECT word FROM words UNION SELECT word FROM goal_words), crc_table),
raw AS (SELECT b, count(*) AS s FROM words JOIN known USING (word) GROUP BY b),
goal AS (SELECT b, count(*) AS t FROM goal_words JOIN known USING (word) GROUP BY b),
sizes AS (SELECT (SELECT count(*) FROM words)::DOUBLE AS all_s, (SELECT count(*) FROM goal_words)::DOUBLE AS all_t),
gain AS (SELECT b, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000)) / ((coalesce(s, 0) + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS g FROM raw FULL JOIN goal USING (b), sizes),
sums AS (SELECT n, sum(g)::BIGINT AS weight FROM words JOIN known USING (word) JOIN gain USING (b) GROUP BY n),
weighed AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM said LEFT JOIN sums USING (n)),
scored AS (SELECT doc_id, n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score FROM weighed),
ranks AS (SELECT *, n_features >= 20 AS enough, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS all_n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN enough AND place <= all_n * 10 // 100 THEN place END AS rank FROM ranks
"""
