"""Collapse serial helper nodes of a call graph into single relations with provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import cut_lineage, lookup_join
from .filters import with_both_ends
from .traverse import adjacency, reach

# Kinds that are always shown, and relations that may be collapsed.
KEPT_KINDS = ("entry", "request", "resource")
CALL_KINDS = ("calls", "callback")


def runtime_kept(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes a runtime view always keeps: entries, requests, resources, and ends of anything but a call."""
    shown = nodes.filter(F.col("kind").isin(*KEPT_KINDS) | F.coalesce("entry", F.lit(False))).select("id")
    ends = edges.filter(~F.col("kind").isin(*CALL_KINDS)).select(F.explode(F.array("src", "dst")).alias("id"))
    return shown.unionByName(ends).distinct()


def compress_paths(edges: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Relations between kept nodes, with serial helpers folded away.

    Returns ``(junctions, relations, provenance)``: helpers kept because paths branch or merge there; one row per
    relation or folded path (named by its first edge); and every original edge with its path and position.

    Only nodes on a way from a kept node to a kept node matter.  A helper with one way in and one way out has a unique
    predecessor edge, so paths are found by pointer doubling over edges instead of enumerating node sequences.
    """
    edges = cut_lineage(edges)
    kept = cut_lineage(kept.select("id").distinct())
    ahead = reach(adjacency(edges, "outgoing"), kept).select("id")
    behind = reach(adjacency(edges, "incoming"), kept).select("id")
    relevant = cut_lineage(ahead.join(behind, "id", "left_semi"))
    inner = cut_lineage(with_both_ends(edges, relevant))
    helpers = relevant.join(kept, "id", "left_anti")
    ways_in = inner.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("ways_in"))
    ways_out = inner.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("ways_out"))
    counted = lookup_join(lookup_join(helpers, ways_in, ["id"]), ways_out, ["id"]).fillna(0)
    merging, branching = F.col("ways_in") > 1, F.col("ways_out") > 1
    kind = F.when(merging & branching, "branch and merge").when(merging, "merge").when(branching, "branch")
    counted = cut_lineage(counted.withColumn("junction", kind))
    junctions = counted.filter(F.col("junction").isNotNull())
    serial = counted.filter(F.col("junction").isNull()).select("id")

    # The edge before each edge, where its start is a serial helper.
    entering = inner.select(F.col("id").alias("_before"), F.col("dst").alias("src"))
    entering = entering.join(serial.select(F.col("id").alias("src")), "src", "left_semi")
    state = lookup_join(inner.select("id", "src"), entering, ["src"])
    state = cut_lineage(state.select("id", F.coalesce("_before", "id").alias("head"), F.when(F.col("_before").isNotNull(), 1).otherwise(0).alias("position")))
    while True:
        hop = state.select(F.col("id").alias("head"), F.col("head").alias("_head"), F.col("position").alias("_position"))
        joined = lookup_join(state, hop, ["head"])
        moved = F.col("_position") > 0
        state = cut_lineage(joined.select("id", F.col("_head").alias("head"), (F.col("position") + F.col("_position")).alias("position"), moved.alias("_moved")))
        if state.filter("_moved").isEmpty():
            break
        state = state.drop("_moved")
    provenance = state.select("id", F.col("head").alias("path_id"), "position")
    full = lookup_join(inner, provenance, ["id"], "inner")
    paths = full.groupBy("path_id").agg(
        F.min_by("src", "position").alias("src"),
        F.max_by("dst", "position").alias("dst"),
        F.count(F.lit(1)).alias("hops"),
        F.min("kind").alias("_kind"),
        F.max(F.col("kind") == "callback").alias("has_callback"),
        F.max(F.col("confidence") == "unresolved").alias("_lost"),
        F.max(F.col("confidence") != "source").alias("_weak"),
        F.min("confidence").alias("_own"),
    )
    folded = F.col("hops") > 1
    confidence = F.when(~folded, F.col("_own")).when(F.col("_lost"), "unresolved").when(F.col("_weak"), "inferred").otherwise("source")
    relations = paths.select("path_id", "src", "dst", "hops", F.when(folded, "processing-path").otherwise(F.col("_kind")).alias("kind"), confidence.alias("confidence"), "has_callback")
    return junctions, relations, provenance
