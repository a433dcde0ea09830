"""Session settings for a run of the engine; scale-dependent ones are left to the cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "placegrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with ANSI SQL, UTC, adaptive execution (coalescing, skew joins) and Arrow."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return builder.config(map=base | conf).getOrCreate()
