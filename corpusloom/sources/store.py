"""The project store: one Parquet table per kind of record, partitioned by project, published as a whole.

Every write goes to a version folder of its own.  Only when all its tables are complete, one row in the list of published
versions makes them visible, so that a reader sees all tables of one version or all of another, and a write that fails, or is
tried again, leaves nothing that a reader meets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LIST = "version string, seq bigint, tables array<string>"


def write_store(tables: dict[str, DataFrame], path: str, version: str | None = None, keep: bool = False) -> str:
    """Write the tables below ``path`` as one version and publish it; ``keep`` takes over tables of the last version that are not given.

    Rows are not gathered per project first: a project with a third of all rows keeps its many writers, and small projects
    only add small files where they have rows.  Returns the name of the version.
    """
    spark = next(iter(tables.values())).sparkSession
    # A second try under the same name writes to a folder of its own as well.
    version = f"{version or 'version'}-{uuid.uuid4().hex}"
    held = {name: version for name in tables}
    last = published(spark, path)
    for name, table in tables.items():
        writer = table.write.mode("errorifexists")
        if "project_id" in table.columns:
            writer = writer.partitionBy("project_id")
        writer.parquet(f"{path}/{version}/{name}")
    if keep and last:
        held = {**last[1], **held}
    listed = spark.createDataFrame([(version, (last[0] if last else 0) + 1, [f"{where}/{name}" for name, where in sorted(held.items())])], _LIST)
    # One row in one file: the commit of this write is what publishes the version.
    listed.coalesce(1).write.mode("append").parquet(f"{path}/published")
    return version


def published(spark: SparkSession, path: str) -> tuple[int, dict[str, str]] | None:
    """Number of the last published version and the folder of each of its tables; None for an empty store.

    Of versions published at the same time under one number, the one with the largest name counts for every reader.
    """
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/published")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    row = spark.read.schema(_LIST).parquet(f"{path}/published").agg(F.max(F.struct("seq", "version", "tables")).alias("last")).first()
    if row is None or row.last is None:
        return None
    return row.last.seq, {item.split("/", 1)[1]: item.split("/", 1)[0] for item in row.last.tables}


def read_store(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    """Tables of the last published version."""
    last = published(spark, path)
    if last is None:
        raise FileNotFoundError(f"nothing is published in {path}")
    return {name: spark.read.parquet(f"{path}/{last[1][name]}/{name}") for name in names}
