"""A Spark session with the settings that this package's semantics rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "ordina", **settings: str) -> SparkSession:
    """The active session, or a new one: UTC, ANSI arithmetic, adaptive plans."""
    builder = SparkSession.builder.appName(name)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true"}
    for key, value in {**fixed, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
