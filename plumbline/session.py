"""Session settings that the library is written for; a cluster's own settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = 8, memory: str = "12g", partitions: int = 8) -> SparkSession:
    """A session on one machine, for tests and bench runs."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("plumbline")
    for key, value in (SETTINGS | {"spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(partitions), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
