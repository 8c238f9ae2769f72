"""The Spark session that the library expects: UTC, adaptive plans, and no SQL over bare files."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "lumenta", **conf: str) -> SparkSession:
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.runSQLOnFiles": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return SparkSession.builder.appName(app).config(map=settings | conf).getOrCreate()
