"""A Spark session with the settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "strandline", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf
    return builder.config(map=settings).getOrCreate()
