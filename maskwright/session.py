"""Sessions for local runs; on a cluster the submitter's configuration is used as it is."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(name: str = "maskwright", cpus: str | int = "8", partitions: int = 8) -> SparkSession:
    """A local session with UTC, AQE and Arrow; the driver's memory holds the executor threads too."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
