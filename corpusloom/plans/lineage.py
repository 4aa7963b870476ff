"""Lineage control for iterative jobs.

Iterations are cut with reliable checkpoints in the shared folder the cluster names in
``spark.checkpoint.dir``; a lost executor then only re-reads the last round.
"""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """Make sure a checkpoint folder is set and return it.

    The cluster's own setting always wins.  A temporary folder is only created on a local master
    (tests, laptops), where one machine holds everything anyway.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="corpusloom-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once, reliably, and drop its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def rewritten(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    For loops that join a table with itself: a checkpoint keeps the size the planner has estimated, which such a join squares
    every round; a written table has its real size.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def store_partitioned(df: DataFrame, keys: Sequence[str], cut: bool = True) -> DataFrame:
    """Materialise ``df`` hash-partitioned and sorted by ``keys``, so that later joins on them move only the other side.

    The stored layout is known to the planner only when the storing plan itself is not adaptive, so adaptive execution
    is switched off for this one write.  ``cut`` stores ``df`` before, so that what leads to it still runs adaptively; a table
    that has just been written needs none.
    """
    spark = df.sparkSession
    checkpoint_folder(spark)
    setting = "spark.sql.adaptive.enabled"
    before = spark.conf.get(setting)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = cut_lineage(df) if cut else df
    spark.conf.set(setting, "false")
    try:
        return source.repartition(parts, *keys).sortWithinPartitions(*keys).checkpoint(eager=True)
    finally:
        spark.conf.set(setting, before)


class Grown:
    """Rows that the rounds of a loop add.  A round's rows are stored once; rounds are merged when there are ``limit`` of them,
    so the plan of all rows stays as short in the hundredth round as in the first."""

    def __init__(self, limit: int = 8):
        self.limit, self.parts, self.fresh = limit, [], []

    def add(self, df: DataFrame) -> None:
        self.fresh.append(df)

    def close_round(self) -> None:
        if self.fresh:
            self.parts.append(cut_lineage(_union(self.fresh).distinct()))
            self.fresh = []
        if len(self.parts) >= self.limit:
            self.parts = [cut_lineage(_union(self.parts).distinct())]

    def rows(self) -> DataFrame:
        return _union([*self.parts, *self.fresh])


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
