"""Tables and files written once in the shared folder, and partition counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans.lineage import checkpoint_folder
from corpusloom.session import tune


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the library's settings, and Python workers that read some thousand texts at a time."""
    tune(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder; nothing is created."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: the lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
