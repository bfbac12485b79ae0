"""A session with the settings the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "brindle", **conf: str) -> SparkSession:
    """UTC, adaptive execution and Arrow; conf adds settings (dots as double underscores)."""
    builder = SparkSession.builder.appName(app)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
