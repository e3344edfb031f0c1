"""Sessions with the settings the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "beaconlake", **conf: str) -> SparkSession:
    """UTC, adaptive execution and Arrow; shuffle partitions and memory stay the cluster's own unless given."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    builder = SparkSession.builder.appName(name)
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
