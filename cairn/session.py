"""A session with the settings that this package expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "cairn", master: str | None = None, **conf: object) -> SparkSession:
    """The running session, or a new one: UTC, AQE with skew-join splitting, Arrow transfer."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
