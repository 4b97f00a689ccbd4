"""Session builder used by the tests, the bench and stand-alone scripts."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build(app: str = "larkspan", cpus: str | None = None, **extra: str) -> SparkSession:
    """A local session with the settings the operators expect; a cluster brings its own."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | extra
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
