"""Session settings the jobs rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Adaptive execution sizes broadcasts and splits skewed join partitions from measured shuffle sizes.
SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# What `tune_size` sets, and the rows of input to a first shuffle partition.
SIZE_SETTINGS = ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
PARTITION_ROWS = 200_000


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time SQL settings to an existing session; what a query before had set for its size ends."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    context = spark.sparkContext.getConf()
    for key in SIZE_SETTINGS:
        given = context.get(key)
        if given is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, given)
    return spark


def tune_size(spark: SparkSession, rows: int) -> SparkSession:
    """Let the number of shuffle partitions follow ``rows``, so that the memory of one task does not.

    Adaptive execution merges only small ones: well compressed columns take up to a hundred times their shuffled bytes in a sort.
    """
    fewest = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for key, value in zip(SIZE_SETTINGS, (str(max(fewest, -(-rows // PARTITION_ROWS))), "8m")):
        spark.conf.set(key, value)
    return spark


def local_session(name: str = "corpusloom", cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        # Recording the call site of every column expression takes longer than building the readers' large expressions.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
