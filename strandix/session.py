"""Session settings that every plan of the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Time zone and ANSI mode are semantics, the rest is adaptive execution.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.caseSensitive": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, app: str = "strandix", **extra: str) -> SparkSession:
    """A session with the engine's settings; `master` defaults to what spark-submit chose, else local[*]."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | extra)
    if master or "SPARK_MASTER" not in os.environ:
        builder = builder.master(master or "local[*]")
    return builder.getOrCreate()
