"""Session helpers: the SQL settings the operators count on, and a local builder."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Joins on hub nodes are split at run time by AQE.  The force flag lets Spark split
# a skewed join even when a later grouping on the same key then needs a shuffle.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Plans know tables by their Parquet files, which unfold to many times that size in the driver.
    # Only small files are broadcast by it; sides measured after a shuffle may be larger.
    "spark.sql.autoBroadcastJoinThreshold": "512KB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "4MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.requireAllClusterKeysForCoPartition": "true",
    "spark.sql.unionOutputPartitioning": "true",
}


def apply_runtime_settings(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def keep_buckets(spark: SparkSession) -> None:
    """Lets joins use the buckets of both sides though they cover only one of several keys; for
    tables that no value of the bucket column dominates.  Lasts until the settings are applied again."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    # Plans that change at run time may lose what a union promised when they were made.
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("graphloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return apply_runtime_settings(spark)
