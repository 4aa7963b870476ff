"""Streaming forms of the trace operators, driven by the events table as a file stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.plans import checkpoint_folder
from corpusloom.streaming import bracket_rows, dedupe_stream, link_stream, run_available, start_brackets

from .records import BRACKETS
from .registry import query

c = F.col


# Events come in four parts by time; some of the first part come behind all others, far beyond the watermark.
DELIVERED = """b AS (SELECT min(epoch_us(ts)) AS lo, (max(epoch_us(ts)) - min(epoch_us(ts))) // 4 + 1 AS step FROM events),
  ontime AS (SELECT events.*, event_id - CAST(json_extract_string(props, '$.k') AS BIGINT) AS parent FROM events, b WHERE event_id % 97 <> 0 OR epoch_us(ts) >= lo + step)"""


def _delivered(t, again: bool = False, late: bool = True):
    """A stream that delivers every part of the events in a trigger of its own, and in the end what is late and a row two days on.

    ``again`` delivers each part a second time with the next one; without ``late`` nothing is held back.
    """
    events = t.events.withColumn("ts", c("ts").cast("timestamp"))
    at = F.unix_micros("ts")
    low, high = events.agg(F.min(at), F.max(at)).first()  # one row
    step = (high - low) // 4 + 1
    part, n = F.floor((at - low) / step), int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    held = (part == 0) & (c("event_id") % 97 == 0) & F.lit(late)
    folder = f"{checkpoint_folder(t.spark).rstrip('/')}/delivered-{uuid.uuid4().hex}"
    for i in range(4):
        rows = events.filter(~held & ((part == i) | (part == i - 1) if again else (part == i)))
        rows.repartition(n).write.mode("append").parquet(folder)
    end = t.spark.range(1).select(F.lit(-1).cast("bigint").alias("event_id"), F.timestamp_micros(F.lit(high + 2 * 86_400_000_000)).alias("ts"), F.lit("end").alias("event_type"))
    events.filter(held | (part == 3 if again else F.lit(False))).unionByName(end, allowMissingColumns=True).repartition(n).write.mode("append").parquet(folder)
    # Files are taken in the order they were written, as many at a time as a part has.
    return t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", n).parquet(folder)


@query("stream_dedupe", f"WITH {DELIVERED} SELECT event_type AS trace_id, event_id::VARCHAR AS span_id FROM ontime")
def stream_dedupe(t):
    """Every event is delivered twice, some too late; state lasts an hour of event time."""
    spans = _delivered(t, again=True).select(c("event_type").alias("trace_id"), c("event_id").cast("string").alias("span_id"), "ts")
    return run_available(dedupe_stream(spans, delay="1 hour")).filter("span_id <> '-1'").select("trace_id", "span_id")


@query(
    "stream_links",
    f"""WITH {DELIVERED} SELECT e.event_id::VARCHAR AS span_id, CASE WHEN p.event_id IS NULL THEN 'missing' ELSE 'linked' END AS link
  FROM ontime e LEFT JOIN ontime p ON p.event_id = e.parent AND p.ts BETWEEN e.ts - INTERVAL 1 HOUR AND e.ts + INTERVAL 1 HOUR""",
)
def stream_links(t):
    """Linked children, and those whose parent has not come when the watermark passes."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    spans = _delivered(t).select(F.lit("t").alias("trace_id"), c("event_id").cast("string").alias("span_id"), (c("event_id") - k).cast("string").alias("parent_span_id"), "ts")
    return run_available(link_stream(spans, spans, delay="1 hour", distance="1 hour")).filter("span_id <> '-1'").select("span_id", "link")


@query(
    "stream_brackets",
    f"""WITH {BRACKETS}, x AS (SELECT *, lead(phase) OVER w AS np, lead(event_id) OVER w AS ne FROM q WHERE NOT orphan AND phase IN ('B', 'E') WINDOW w AS (PARTITION BY user_id, depth ORDER BY ts, event_id))
  SELECT event_id AS begin_item, ne AS end_item, depth, 'closed' AS status FROM x WHERE phase = 'B' AND np = 'E' UNION ALL SELECT NULL, event_id, NULL, 'orphan' FROM q WHERE orphan""",
)
def stream_brackets(t):
    """Events in four triggers by time; brackets that stay open wait in the state."""
    phase = F.when(c("event_type") == "signup", "B").when(c("event_type") == "purchase", "E")
    events = _delivered(t, late=False).select(c("user_id").cast("string").alias("thread"), F.unix_micros("ts").alias("position"), c("event_id").alias("item"), phase.alias("phase")).filter("phase is not null")
    folder = f"{checkpoint_folder(t.spark).rstrip('/')}/brackets-{uuid.uuid4().hex}"
    start_brackets(events, folder).awaitTermination()
    return bracket_rows(t.spark, folder).select("begin_item", "end_item", "depth", "status")
