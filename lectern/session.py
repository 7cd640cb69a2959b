"""Session settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "lectern", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution on; keyword settings override."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    return builder.config(map=settings).getOrCreate()
