"""A Spark session with the settings that the engine counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tidewater", cores: int | str = "*", shuffle_partitions: int | None = None, memory: str = "8g", **conf: str) -> SparkSession:
    """Local session; on a cluster, take the cluster's own and pass it to the operators instead."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
