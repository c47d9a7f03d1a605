"""Session construction: one place for the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that results depend on (time zone) or that every plan wants (AQE).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, app: str = "threadloom", **conf: str) -> SparkSession:
    """A session with SETTINGS; conf keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
