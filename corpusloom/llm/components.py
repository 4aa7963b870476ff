"""Connected components of a table of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored


def _stars(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step over links (a, b) with a > b."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    # Every larger neighbour points to the smallest node around.
    large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.filter("a > b").distinct()
    smallest = large.groupBy("a").agg(F.min("b").alias("m"))
    # Every smaller neighbour, and the node itself, points to the smallest of them.
    small = large.join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b")
    return small.unionByName(smallest.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of ``links`` (a, b): the smallest node it is connected with.  Ids are of any ordered type."""
    links = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        # Done when every node points to a root and no root points anywhere.
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if tuple(now) == state or not now[0]:
            break
        state = tuple(now)
        links = stored(_stars(links), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
