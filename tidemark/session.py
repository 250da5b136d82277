"""Session settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC and ANSI make parsing strict; adaptive execution sizes shuffles and splits skewed joins.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "tidemark", **more: str) -> SparkSession:
    """A session with SETTINGS; more: further settings, with _ for . in their names."""
    builder = SparkSession.builder.appName(app)
    for k, v in {**SETTINGS, **{k.replace("_", "."): v for k, v in more.items()}}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
