"""Session factory used by tests, the benchmark and interactive work."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(cpus: int | str = "*", app: str = "skimmer", **conf: str) -> SparkSession:
    """A local session with the settings that every query here assumes: UTC and AQE.

    On a cluster the session comes from spark-submit; the only required setting is the UTC
    time zone, and a shared ``spark.checkpoint.dir`` for the iterative operators.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", os.environ.get("SHUFFLE_PARTITIONS", "8"))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
