"""Spark sessions with the settings the engine is tested under."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(name: str = "tessera", cores: int = 8, **conf: str) -> SparkSession:
    """A local session; on a cluster, bring your own session and its partition settings."""
    settings = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    session = SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=settings).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
