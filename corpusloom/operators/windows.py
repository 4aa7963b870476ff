"""Ordered and ranked columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import path_suffixes
from ..plans import lookup_join, positions


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], flags: Sequence[str] = ()) -> DataFrame:
    """First row of each key under ``order`` (ascending), with boolean ``flags`` OR-ed over the whole key.

    A ``min_by`` over a struct combines map-side; a ranking window would sort whole groups.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_best")
    grouped = df.groupBy(*keys).agg(picked, *[F.max(flag).alias(f"_any_{flag}") for flag in flags])
    return grouped.select(*keys, *[F.col(f"_any_{c}").alias(c) if c in flags else F.col(f"_best.{c}").alias(c) for c in rest])


def edge_slots(edges: DataFrame, order: Sequence[Column | str] = ("id",), by: Sequence[str] = ()) -> DataFrame:
    """Index (from 0) and count of each edge among the edges between the same two nodes, whatever their direction."""
    paired = edges.withColumn("_low", F.least("src", "dst")).withColumn("_high", F.greatest("src", "dst"))
    placed = positions(paired, [*by, "_low", "_high"], order, index="slot", count="slots")
    return placed.withColumn("slot", F.col("slot") - 1).drop("_low", "_high")


def short_labels(paths: DataFrame, path: str = "path", by: Sequence[str] = ()) -> DataFrame:
    """Shortest trailing part that no other distinct path shares, whole, so that labels stay distinct."""
    suffixes = paths.select(*by, path).distinct().select(*by, path, F.posexplode(path_suffixes(path)).alias("_n", "_suffix"))
    # A suffix is unique when all paths ending in it are the same path.
    shared = suffixes.groupBy(*by, "_suffix").agg(F.min(path).alias(path), (F.min(path) == F.max(path)).alias("_one"))
    own = shared.filter("_one").select(*by, path, "_suffix").withColumn("_n", F.size(F.split("_suffix", "/")))
    best = own.groupBy(*by, path).agg(F.min_by("_suffix", "_n").alias("label"))
    return lookup_join(paths, best, [*by, path]).withColumn("label", F.coalesce("label", F.col(path)))


def distinct_titles(items: DataFrame, title: str, where: Sequence[str], context: Column) -> DataFrame:
    """Append ``context`` to titles that occur more than once at the same place."""
    repeated = items.groupBy(title, *where).agg((F.count(F.lit(1)) > 1).alias("_repeated"))
    joined = lookup_join(items, repeated, [title, *where])
    return joined.withColumn("display", F.when(F.col("_repeated"), F.concat_ws(" · ", title, context)).otherwise(F.col(title))).drop("_repeated")


def lanes(steps: DataFrame, lane: Sequence[str], rank: str = "rank") -> DataFrame:
    """Execution lanes: first rank and number of steps."""
    return steps.groupBy(*lane).agg(F.min(rank).alias("lane_rank"), F.count(F.lit(1)).alias("steps"))


def first_and_last(items: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """First and last value of each key in source order."""
    at = F.struct(*order)
    return items.groupBy(*keys).agg(F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"), F.count(F.lit(1)).alias("n"))


def preview(items: DataFrame, keys: Sequence[str], order: Sequence[Column | str], limit: int = 6) -> DataFrame:
    """First ``limit`` items of each list, with the number left out (the shortened list is the feature)."""
    placed = positions(items, keys, order, index="position", count="total")
    return placed.filter(F.col("position") <= limit).withColumn("remaining", F.greatest(F.col("total") - limit, F.lit(0)))
