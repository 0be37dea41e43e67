"""Session construction with the settings the operators are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "lodetrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on.

    `master` is only for local use; on a cluster leave it to spark-submit. Extra
    keyword arguments are Spark settings with `__` in place of dots.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", os.environ.get("LODETRACE_DRIVER_MEMORY", "8g"))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
