"""Session construction for tests, benchmarks and the command line."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "hapforge", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session with adaptive execution on; a cluster passes its own master through spark-submit."""
    n = cpus or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
