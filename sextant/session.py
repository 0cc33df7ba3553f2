"""Session construction shared by tests, the bench and interactive use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "sextant", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings every query assumes (UTC, AQE).

    On a cluster the session comes from the launcher; nothing in the library
    depends on the local master or on the number of shuffle partitions.
    """
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("SEXTANT_DRIVER_MEMORY", "8g"),
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in {**base, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
