"""A training corpus in five stages: quality rules, near-dedup, secret scan, mixing and packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
``documents``; the last returns the packed pieces. Every stage takes an empty table and gives one. Further columns go through
all stages but the last as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverlog.llm import mixing, neardup, packing, quality, secrets
from riverlog.llm.common import Scratch, read_table

#: SQL can't express hashing models, sketches and tokenizers; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` in the order of ``columns``, with n_chars of the text as it is now."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))
    return docs.select(*columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null, empty and blank texts have no words and go; each of repeated rows is judged by itself, so they
    go or stay alike; rows without id are judged like others."""
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    verdict = "_verdict_"
    while verdict.lower() in {c.lower() for c in docs.columns}:
        verdict += "_"
    return quality.judge(docs, model, out_col=verdict).filter(f"{verdict}.kept").select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each near-duplicate group. Documents without id, and those without words, stay; rows that share an id are one
    document: all of them stay if it does."""
    found = neardup.near_components(docs.select("doc_id", "text"))
    return docs.join(found.filter("not kept").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; null and empty texts stay as they are."""
    return _measured(secrets.redact_secrets(docs), docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as it takes them. Those without words are never taken; repeated rows are taken each by itself; a null source is
    a source of its own."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "source")]  # out of the way of the columns that the mix adds
    mixed = mixing.mix(docs.select("doc_id", "text", "source", *([F.struct(*rest).alias("_rest_")] if rest else [])))
    return _measured(mixed.select("doc_id", "text", "source", *(["_rest_.*"] if rest else [])), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place. A null or empty text is its end token alone; repeated rows have pieces each."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_good),
    ("near_dedup", keep_one_of_each_group),
    ("secret_scan", redact),
    ("mix_sources", mix),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again."""
    scratch, docs = Scratch(spark, "pipeline"), read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
