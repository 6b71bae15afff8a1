"""A session with the settings this library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(name: str = "riverlog", master: str | None = None, **config: str) -> SparkSession:
    """UTC and adaptive execution; anything else is the cluster's to set."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in config.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
