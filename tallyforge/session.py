"""Session defaults shared by the tests, the benchmark and ad-hoc use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def spark_session(app: str = "tallyforge", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session with UTC timestamps and adaptive execution.

    On a cluster the session is made by the launcher; nothing here is required by the operators.
    """
    cores = cores or min(8, os.cpu_count() or 1)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
