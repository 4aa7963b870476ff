"""Breadth-first traversal as frontier joins.

The adjacency is stored once, partitioned and sorted by its start, and stays in place: each round moves only the new
frontier to it and drops nodes seen before.  The edges of a hub are spread over as many parts as its measured degree asks,
so it does not sit in one partition; only frontier rows of hubs are copied, one to each part.  Frontiers are checkpointed, so plans stay flat and a lost executor
re-reads one round.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import cut_lineage, rewritten, store_partitioned
from .filters import edge_direction

DIRECTIONS = ("both", "outgoing", "incoming")
# Steps of one start that stay in one partition.
PART_STEPS = 100_000


class Steps(NamedTuple):
    """A stored adjacency: ``from``, ``to``, ``part``, and the starts that are spread over several parts."""

    rows: DataFrame
    hubs: DataFrame


def store_steps(steps: DataFrame, by: Sequence[str] = ()) -> Steps:
    """Store distinct (``from``, ``to``) steps for repeated frontier joins; a start has a part for every ``PART_STEPS`` of its steps."""
    listed = rewritten(steps.select(*by, "from", "to").distinct())
    degrees = listed.groupBy(*by, "from").agg(F.ceil(F.count(F.lit(1)) / PART_STEPS).cast("bigint").alias("parts"))
    hubs = rewritten(degrees.filter("parts > 1"))
    spread = listed.join(hubs, [*by, "from"], "left").withColumn("part", F.pmod(F.xxhash64("to"), F.coalesce("parts", F.lit(1))))
    return Steps(store_partitioned(spread.select(*by, "from", "to", "part"), [*by, "from", "part"], cut=False), hubs)


def met(frontier: DataFrame, steps: Steps, by: Sequence[str] = ()) -> DataFrame:
    """Frontier rows (``id`` and more) with the ``to`` of every step from them; only rows of hubs are copied, one to each part."""
    starts = frontier.withColumnRenamed("id", "from").join(steps.hubs, [*by, "from"], "left")
    parts = F.sequence(F.lit(0).cast("bigint"), F.coalesce("parts", F.lit(1)) - 1)
    return starts.withColumn("part", F.explode(parts)).drop("parts").join(steps.rows, [*by, "from", "part"])


def adjacency(edges: DataFrame, direction: str = "both", by: Sequence[str] = ()) -> Steps:
    """Stored steps allowed by a direction."""
    forward = edges.select(*by, F.col("src").alias("from"), F.col("dst").alias("to"))
    backward = edges.select(*by, F.col("dst").alias("from"), F.col("src").alias("to"))
    steps = {"outgoing": forward, "incoming": backward, "both": forward.unionByName(backward)}[direction]
    return store_steps(steps.filter(F.col("from") != F.col("to")), by)


def reach(
    steps: Steps, seeds: DataFrame, labels: Sequence[str] = (), by: Sequence[str] = (), max_hops: int | None = None, symmetric: bool = False
) -> DataFrame:
    """Hop distance from the seeds along stored ``steps``.

    ``seeds`` has ``id`` and optional label columns; every label is traversed on its own in the same rounds.
    ``symmetric`` steps lead from one distance only to the distances next to it, so only the last two frontiers are
    checked for nodes seen before; otherwise all of them are.
    """
    keys = [*by, *labels, "id"]
    frontier = cut_lineage(seeds.select(*keys).distinct().withColumn("depth", F.lit(0)))
    seen, before, hop = frontier, None, 0
    while (max_hops is None or hop < max_hops) and not frontier.isEmpty():
        hop += 1
        touched = met(frontier, steps, by).select(*by, *labels, F.col("to").alias("id")).distinct()
        known = seen
        if symmetric:
            known = frontier if before is None else frontier.unionByName(before)
        fresh = cut_lineage(touched.join(known.select(*keys), keys, "left_anti").withColumn("depth", F.lit(hop)))
        before, frontier = frontier, fresh
        seen = seen.unionByName(frontier)
        if hop % 16 == 0:  # keep the plan of the union short on very deep graphs
            seen = cut_lineage(seen)
    return seen


def bfs_depths(nodes: DataFrame, edges: DataFrame, seed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Undirected distance of every reachable node from the seed; empty when the seed is not a node."""
    known = seed.join(nodes.select(*by, "id"), [*by, "id"], "left_semi")
    return reach(adjacency(edges, "both", by), known, by=by, symmetric=True)


def neighbours(edges: DataFrame, seed: DataFrame, hops: int, direction: str = "both", by: Sequence[str] = ()) -> DataFrame:
    """Nodes within ``hops`` of the seed, itself included."""
    return reach(adjacency(edges, direction, by), seed, by=by, max_hops=hops, symmetric=direction == "both")


def khop_relations(edges: DataFrame, seed: DataFrame, hops: int = 1, direction: str = "both", structural: str | None = None) -> DataFrame:
    """Relations met while expanding ``hops`` (at least 1) from the seed; structural edges do not count.

    An edge is met when the end it is followed from lies strictly inside the range.
    """
    hops = max(1, hops)
    real = edges.filter(~F.coalesce(F.col(structural), F.lit(False))) if structural else edges
    inside = reach(adjacency(real, direction), seed, max_hops=hops - 1, symmetric=direction == "both").select("id")
    directed = edge_direction(real, inside, "_met").filter(F.col("_met").isNotNull())
    if direction != "both":
        directed = directed.filter(F.col("_met").isin(direction, "internal"))
    return directed.drop("_met")


def signed_hops(edges: DataFrame, center: DataFrame, structural: str | None = None) -> DataFrame:
    """Column of each node around a centre: minus the incoming distance when it is not longer than the outgoing one,
    else plus the outgoing distance."""
    real = edges.filter(~F.coalesce(F.col(structural), F.lit(False))) if structural else edges
    before = reach(adjacency(real, "incoming"), center).withColumnRenamed("depth", "_in")
    after = reach(adjacency(real, "outgoing"), center).withColumnRenamed("depth", "_out")
    joined = before.join(after, "id", "full")
    hop = F.when(F.col("_in").isNotNull() & (F.col("_out").isNull() | (F.col("_in") <= F.col("_out"))), -F.col("_in")).otherwise(F.col("_out"))
    return joined.select("id", hop.alias("hop"))


def edge_emphasis(nodes: DataFrame, edges: DataFrame, node: DataFrame, minimum_degree: int = 4) -> DataFrame:
    """primary / secondary / deep by the larger distance of an edge's ends, for a focus node with enough neighbours;
    null (the caller's default) otherwise."""
    near = edges.join(node.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("n"))
    near = near.unionByName(edges.join(node.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("n")))
    dense = near.agg((F.count_distinct("n") >= minimum_degree).alias("_dense")).first()[0]
    if not dense:
        return edges.withColumn("emphasis", F.lit(None).cast("string"))
    depths = bfs_depths(nodes, edges, node)
    joined = edges.join(depths.select(F.col("id").alias("src"), F.col("depth").alias("_a")), "src", "left").join(
        depths.select(F.col("id").alias("dst"), F.col("depth").alias("_b")), "dst", "left"
    )
    far = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.greatest("_a", "_b"))
    return joined.withColumn("emphasis", F.when(far <= 1, "primary").when(far == 2, "secondary").when(far > 2, "deep")).drop("_a", "_b")
