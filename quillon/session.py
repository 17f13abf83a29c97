"""Spark sessions with the settings that the plans are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", partitions: int | None = None, **conf: str) -> SparkSession:
    """A session: adaptive execution with skew handling, UTC, Arrow.

    ``partitions`` is the number of shuffle partitions before adaptive
    coalescing; on a cluster leave it to the cluster's own configuration.
    """
    b = SparkSession.builder.master(master).appName("quillon")
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {}) | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
