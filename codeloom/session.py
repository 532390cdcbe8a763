"""A Spark session with the settings that the engine is tested with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(master: str = "local[8]", app: str = "codeloom", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
