"""Sessions with the settings that the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "sievewright", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; conf adds or replaces settings, with _ for the dots of their names."""
    builder = SparkSession.builder.appName(name)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (settings | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
