"""Duplicate suppression and parent links on span streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import checkpoint_folder


def dedupe_stream(spans: DataFrame, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """First arrival of each (trace, span) within the watermark; state is dropped as the watermark passes."""
    return spans.withWatermark(time, delay).dropDuplicatesWithinWatermark(["trace_id", "span_id"])


def link_stream(children: DataFrame, parents: DataFrame, time: str = "ts", delay: str = "1 hour", distance: str = "1 hour") -> DataFrame:
    """Explicit parent links as a stream-stream left join.

    A parent may arrive before or after its child within ``distance`` of event time.  A child whose parent has not come
    when the watermark passes is emitted unlinked and counts as missing its parent.
    """
    left = children.withWatermark(time, delay).alias("c")
    right = parents.select("trace_id", "span_id", time).withWatermark(time, delay).alias("p")
    near = F.expr(f"p.{time} >= c.{time} - interval {distance} and p.{time} <= c.{time} + interval {distance}")
    on = (F.col("c.trace_id") == F.col("p.trace_id")) & (F.col("c.parent_span_id") == F.col("p.span_id")) & near
    link = F.when(F.col("c.parent_span_id").isNull(), None).when(F.col("p.span_id").isNotNull(), "linked").otherwise("missing")
    return left.join(right, on, "leftOuter").select("c.*", link.alias("link"))


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process everything available now into a Parquet table in the shared checkpoint folder and read it back."""
    spark = stream.sparkSession
    base = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/state").option("path", f"{base}/rows")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
