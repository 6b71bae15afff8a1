import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    """The small table as (doc_id, text, source) rows."""
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]


@pytest.fixture(scope="session")
def odd_documents():
    """Nulls, empty and long texts, ties, repeated rows."""
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(n))
    base = words(300)
    return [
        (1, None, "a"), (2, "", None), (3, " \t\n ", "b"), (4, "one", "a"), (5, "One", ""), (6, base, "a"), (7, base, "b"), (7, base, "b"),
        (8, base + " tail", None), (9, words(30_000), "c"), (10, "x" * 50_000, "c"), (None, base, "a"), (11, "é" * 700, "b"), (12, "ab " * 400, "d"),
        (13, "password = hunter22x AKIA" + "Q" * 20 + " " + "0af" * 10, "a"), (14, "mail a.b@c.example.org or +1 (555) 123-4567 or 10.0.0.1", "a"),
    ]


DOC_SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="session")
def odd(spark, odd_documents):
    """The odd documents with extra columns, one of which clashes with names that operators use."""
    return spark.createDataFrame(odd_documents, DOC_SCHEMA).selectExpr("*", "1 AS rank", "'x' AS lang")


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
