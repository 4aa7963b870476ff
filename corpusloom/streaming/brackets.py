"""Begin/end pairing on event streams: every trigger is paired by the batch operator, with the brackets that are still open.

What is kept between triggers are two tables in the query's folder: open brackets, and the last position of each thread.  They are
rows like any others, so a thread that holds most of the events or open brackets is split over blocks.  A trigger writes its rows
and the tables it leaves under its own number and reads those of the one before; a trigger that is tried again writes the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.spans import bracket_pairs, complete_brackets
from ..plans import cut_lineage, lookup_join

PAIRS = "thread string, begin_item bigint, end_item bigint, depth bigint, parent_item bigint, status string"
_OPEN = "thread string, position bigint, item bigint"
_SEEN = "thread string, last bigint"


def pair_trigger(events: DataFrame, open_: DataFrame, seen: DataFrame, patience: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of one trigger, the brackets it leaves open, and the last position of every live thread.

    Rows have the status ``closed``, ``orphan`` (an end without a begin), ``late`` (behind the last position of its thread), or, given
    ``patience``, ``unclosed``: open brackets of threads that are silent for so many positions, which are given up.
    """
    known = lookup_join(events, seen, ["thread"])
    late = F.col("last").isNotNull() & (F.col("position") <= F.col("last"))
    marked = cut_lineage(known.withColumn("late", late).drop("last"))
    fresh = marked.filter("not late and phase in ('B', 'E')").drop("late")
    rows = open_.withColumn("phase", F.lit("B")).unionByName(fresh)
    order = ["position", "item"]
    paired = cut_lineage(bracket_pairs(rows, ["thread"], order))
    whole = cut_lineage(complete_brackets(paired, ["thread"], order, item="item"))
    none = F.lit(None).cast("bigint")

    def row(frame: DataFrame, status: str, begin=none, end=none, depth=none, parent=none) -> DataFrame:
        return frame.select("thread", begin.alias("begin_item"), end.alias("end_item"), depth.cast("bigint").alias("depth"), parent.alias("parent_item"), F.lit(status).alias("status"))

    left = whole.filter("end_item is null").select("thread", "position", "item", "depth", "parent_item")
    last = seen.unionByName(marked.groupBy("thread").agg(F.max("position").alias("last"))).groupBy("thread").agg(F.max("last").alias("last"))
    out = row(whole.filter("end_item is not null"), "closed", F.col("item"), F.col("end_item"), F.col("depth"), F.col("parent_item"))
    out = out.unionByName(row(paired.filter("orphan"), "orphan", end=F.col("item")))
    out = out.unionByName(row(marked.filter("late"), "late", F.when(F.col("phase") == "B", F.col("item")), F.when(F.col("phase") == "E", F.col("item"))))
    if patience is not None:
        now = last.agg(F.max("last").alias("_now")).first()[0]  # one row
        ended = last.filter(F.col("last") < F.lit((now or 0) - patience)).select("thread")
        given_up = left.join(ended, "thread", "left_semi")
        out = out.unionByName(row(given_up, "unclosed", F.col("item"), none, F.col("depth"), F.col("parent_item")))
        left, last = left.join(ended, "thread", "left_anti"), last.join(ended, "thread", "left_anti")
    return out, left.select("thread", "position", "item"), last


def start_brackets(events: DataFrame, folder: str, patience: int | None = None, **trigger) -> StreamingQuery:
    """Start pairing ``events`` (``thread``, ``position``, ``item``, ``phase``) below a shared ``folder``; started again there, it goes on
    where it stopped.  ``trigger`` is that of Spark, by default all that is available now."""

    def table(spark: SparkSession, name: str, number: int, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{folder}/{name}/{number}") if number >= 0 else spark.createDataFrame([], schema)

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        out, open_, seen = pair_trigger(batch, table(spark, "open", number - 1, _OPEN), table(spark, "seen", number - 1, _SEEN), patience)
        # The rows come last: a trigger counts as done only behind them.
        for name, frame in (("open", open_), ("seen", seen), ("rows", out)):
            frame.write.mode("overwrite").parquet(f"{folder}/{name}/{number}")

    chosen = events.select("thread", F.col("position").cast("bigint").alias("position"), F.col("item").cast("bigint").alias("item"), "phase")
    writer = chosen.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def bracket_rows(spark: SparkSession, folder: str) -> DataFrame:
    """All rows written below ``folder`` so far."""
    return spark.read.schema(PAIRS).option("recursiveFileLookup", "true").parquet(f"{folder}/rows")


def open_brackets(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """Brackets that trigger ``number`` left open."""
    return spark.read.schema(_OPEN).parquet(f"{folder}/open/{number}")
