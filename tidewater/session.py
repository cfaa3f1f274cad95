"""Session construction for scripts, tests and the benchmark; on a cluster the caller's session is used as it is."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | None = None, app: str = "tidewater", **conf: str) -> SparkSession:
    """A ``local[n]`` session with adaptive execution, UTC and as many shuffle partitions as cores."""
    n = cores or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    settings = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    spark = SparkSession.builder.master(f"local[{n}]").appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
