"""Operator 10: quality rules.

A log-likelihood ratio between two multinomials over hashed n-grams, one of a trusted target and one of
the raw corpus, divided by the number of n-grams. The n-grams are three bytes within a word and its borders. Corpus
counts cover every document; the trusted target is a bounded sample of labelled documents (``max_labelled``), and so
is the set of scores that fixes the threshold. Every second trusted document makes the target and the others fix the threshold, as a
document that made the target scores better than an equally good one that did not. Every document is then kept or not
by rule: the counting rules first, the ratio against the threshold after them.

Defined results: a null text has no words; such a document fails the rules; without trusted labels the ratio
is 0 and the rules alone decide; repeated rows have a result each; an empty table gives an empty result;
an existing column named like the added one gives way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, parts, read_table, slices

SYMBOLS = "#*$%&|<>"
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"


@dataclass(frozen=True)
class QualitySettings:
    bits: int = 16  # of the n-gram table
    smoothing: float = 1.0
    max_labelled: int = 20_000  # trusted documents, and labelled ones of either class for the threshold
    keep: float = 0.995  # of the trusted ones, at least
    chunk_bytes: int = 1_000_000


def _vocabulary(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts as codes, the text of each word, and the distinct words."""
    split = [t.split() for t in texts]  # bytes split at exactly the blanks of the word pattern
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in split])
    codes, distinct = pd.factorize(np.array([w for x in split for w in x], dtype=object))
    return codes, owner, distinct


def _grams(distinct: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every n-gram of the distinct words."""
    sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))
    data = np.frombuffer(b" ".join([b"", *distinct, b""]), np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(len(distinct)), sizes)  # n-gram i is centred on the i-th byte of the words
    centre = np.arange(len(word)) + word + 1
    key = (data[centre - 1] << np.uint64(16)) | (data[centre] << np.uint64(8)) | data[centre + 1]
    return word, ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def gram_counts(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts by bucket over all texts."""
    codes, _, distinct = _vocabulary(texts)
    word, bucket = _grams(distinct, bits)
    return np.bincount(bucket, np.bincount(codes, minlength=len(distinct))[word], minlength=1 << bits).astype(np.int64)


def features(texts: list[bytes], ratios: np.ndarray, bits: int) -> np.ndarray:
    """The columns of FEATURES, a row a text."""
    codes, owner, distinct = _vocabulary(texts)
    n = len(texts)
    n_words = np.bincount(owner, minlength=n)
    chars = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in distinct), np.int64, len(distinct))
    word, bucket = _grams(distinct, bits)
    score = np.bincount(word, ratios[bucket], minlength=len(distinct))
    total = np.bincount(owner, score[codes], minlength=n)
    grams = np.bincount(owner, np.bincount(word, minlength=len(distinct))[codes], minlength=n)
    inside = np.flatnonzero(owner[2:] == owner[:-2]) if len(owner) > 2 else np.empty(0, np.int64)
    pair = pd.factorize(codes[inside] * len(distinct) + codes[inside + 1])[0].astype(np.int64)
    window = pd.factorize(pair * len(distinct) + codes[inside + 2])[0].astype(np.int64)
    own = pd.factorize(owner[inside] * (len(inside) + 1) + window)[0]
    again = inside[np.bincount(own)[own] > 1] if len(own) else inside
    covered = np.zeros(len(owner), bool)
    for k in range(3):
        covered[again + k] = True
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    return np.column_stack([n_words, np.bincount(owner, chars[codes], minlength=n), [sum(map(t.count, SYMBOLS.encode())) for t in texts], [len(x) - len(set(x)) for x in lines], np.bincount(owner[covered], minlength=n), total / np.maximum(grams, 1)])


def _encoded(texts: pa.Array) -> list[bytes]:
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


def _labelled(labels: DataFrame, quality: int, s: QualitySettings) -> list[int]:
    """At most ``max_labelled`` ids of a class, those of least hash; toxic ones are not trusted."""
    rows = labels.filter((F.col("quality") == quality) & F.col("doc_id").isNotNull())
    if quality:
        rows = rows.filter(F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    rows = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.max_labelled)
    return [r["doc_id"] for r in rows.collect()]


@dataclass(frozen=True)
class QualityModel:
    ratios: np.ndarray
    threshold: float
    settings: QualitySettings


def fit(docs: DataFrame, labels: DataFrame, settings: QualitySettings = QualitySettings()) -> QualityModel:
    """Counts over all of ``docs`` and the threshold from labelled scores."""
    bound_batches(docs.sparkSession)
    s = settings
    known_good, rejected = _labelled(labels, 1, s), _labelled(labels, 0, s)
    trusted, held = (known_good[::2], known_good[1::2]) if len(known_good) > 1 else (known_good, known_good)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, raw, good = pa.array(trusted, pa.int64()), np.zeros(1 << s.bits, np.int64), np.zeros(1 << s.bits, np.int64)
        for part in parts(batches, 1, s.chunk_bytes):
            texts, is_good = _encoded(part.column(1)), pc.is_in(part.column(0), known).to_pylist()
            raw += gram_counts(texts, s.bits)
            if any(is_good):
                good += gram_counts([t for t, g in zip(texts, is_good, strict=True) if g], s.bits)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(good[at])], ["bucket", "raw", "good"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(counted, "bucket int, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect()
    raw, good = np.full(1 << s.bits, s.smoothing), np.full(1 << s.bits, s.smoothing)
    for r in rows:  # at most 2 ** bits
        raw[r["bucket"]] += r["raw"]
        good[r["bucket"]] += r["good"]
    ratios = np.log(good / good.sum()) - np.log(raw / raw.sum()) if trusted else np.zeros(1 << s.bits)
    known = docs.sparkSession.createDataFrame([(i, 1) for i in held] + [(i, 0) for i in rejected], "doc_id long, quality int")
    some = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    scores = some.select("quality", scored(F.col("text"), QualityModel(ratios, 0.0, s))["score"].alias("score"), F.col("doc_id")).collect()
    return QualityModel(ratios, _threshold(*(np.array([r["score"] for r in scores if r["quality"] == k]) for k in (1, 0)), s.keep), s)


def _threshold(trusted: np.ndarray, rejected: np.ndarray, keep: float) -> float:
    """The cut of best balanced accuracy among those that keep enough trusted documents."""
    if not len(trusted):
        return -np.inf
    most = float(np.sort(trusted)[int((1 - keep) * len(trusted))])
    if not len(rejected):
        return most
    values = np.unique(np.concatenate([trusted, rejected]))
    cuts = np.concatenate([(values[1:] + values[:-1]) / 2, [most]])
    cuts = np.sort(cuts[cuts <= most])
    good = 1 - np.searchsorted(np.sort(trusted), cuts) / len(trusted)
    bad = np.searchsorted(np.sort(rejected), cuts) / len(rejected)
    return float(cuts[np.argmax(good + bad)])


def scored(text, model: QualityModel):
    """A column of struct FEATURES."""
    s, ratios = model.settings, model.ratios

    @F.arrow_udf(FEATURES)
    def of(texts: pa.Array) -> pa.Array:
        rows = [features(_encoded(texts[a:b]), ratios, s.bits) for a, b in slices(texts, s.chunk_bytes)]
        columns = np.concatenate(rows).T if rows else np.empty((6, 0))
        names = [x.split()[0] for x in FEATURES.split(", ")]
        return pa.StructArray.from_arrays([*(pa.array(c.astype(np.int64)) for c in columns[:-1]), pa.array(columns[-1])], names)

    return of(text)


def judge(docs: DataFrame, model: QualityModel, text_col: str = "text", out_col: str = "quality") -> DataFrame:
    """``docs`` with a column ``out_col``: struct of FEATURES, base_failed and kept."""
    rows = docs.withColumn(out_col, scored(F.col(text_col), model))
    q = lambda name: F.col(f"`{out_col}`.{name}")
    failed = (q("n_words") < 50) | (100 * q("n_repeat_words") > 50 * q("n_words"))
    return rows.withColumn(out_col, F.struct(f"`{out_col}`.*", failed.alias("base_failed"), (~failed & (q("score") >= F.lit(model.threshold))).alias("kept")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels")
    return judge(docs, fit(docs, labels)).select("doc_id", "quality.*")
