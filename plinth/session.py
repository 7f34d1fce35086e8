"""The Spark session that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", app: str = "plinth", **conf: str) -> SparkSession:
    """ANSI arithmetic (overflow raises), UTC, adaptive execution; conf overrides.

    Key names in conf use underscores for dots.
    """
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()
