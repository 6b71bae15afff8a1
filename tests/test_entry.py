"""The driver's entry points, with and without the training-data part."""

import sys

import pytest

import __spark_entry__
from riverlog.plans import queries


def test_log_queries_do_not_need_the_training_data_part(monkeypatch):
    for name in ("riverlog.llm.queries", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, name, None)  # an import of it fails
    assert set(__spark_entry__.queries()) == set(queries.queries()) and set(__spark_entry__.oracle_sql()) == set(queries.oracle_sql())


def test_a_missing_library_leaves_out_that_part_alone(monkeypatch):
    pytest.importorskip("riverlog.llm.queries")
    for name in [n for n in sys.modules if n.startswith("riverlog.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    assert set(__spark_entry__.queries()) == set(queries.queries())


def test_other_errors_are_not_hidden(monkeypatch):
    def fail(name):
        raise ValueError(name)

    monkeypatch.setattr(__spark_entry__.importlib, "import_module", fail)
    with pytest.raises(ValueError):
        __spark_entry__.queries()


def test_flagship_query(spark):
    assert __spark_entry__.entry(spark).columns == ["epoch", "label", "value", "mean", "sd", "z", "direction"]
