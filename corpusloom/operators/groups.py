"""Display grouping of many points: membership, density, ownership."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import cut_lineage, lookup_join

# Density rules of automatic grouping.
RADIUS = 12.0
MIN_EXTENT = 8.0
DEFAULT_MINIMUM = 8
DENSE = {"spacing": 14.0, "crowded": 0.65, "span": 1.0}
STILL_DENSE = {"spacing": 22.0, "crowded": 0.4, "span": 1.2}


def build_groups(memberships: DataFrame, points: DataFrame) -> DataFrame:
    """Size and centroid of each group: ``memberships`` (``group_id``, ``id``, ``level``), ``points`` (``id``, ``x``, ``y``)."""
    placed = lookup_join(memberships, points.select("id", "x", "y"), ["id"], "inner")
    return placed.groupBy("group_id").agg(
        F.max("level").alias("level"), F.count(F.lit(1)).alias("members"), F.avg("x").alias("x"), F.avg("y").alias("y"),
        F.min("id").alias("first_member"), F.max("id").alias("last_member"),
    )


def crowded_points(points: DataFrame, radius: float = RADIUS) -> DataFrame:
    """Points with another point strictly closer than ``radius``.

    A point needs only one near neighbour, so pairs are never listed.  The plane is cut into small squares whose
    diagonal is under the radius: two points in one square settle all of them by a count.  A square with a single
    point looks at the squares around it, and each of those is searched only if it too holds one point or is not
    already decided; at most one representative pair per square and neighbour is left to test against the points of
    the neighbouring square, which is bounded because every point meets a fixed number of squares.
    """
    side = radius / 2.0  # diagonal 0.71 r: any two points of a square are near
    cell = points.select("id", "x", "y", F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy"))
    sizes = cell.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))
    counted = lookup_join(cell, sizes, ["cx", "cy"])
    sure = counted.filter("n > 1").select("id")
    lone = counted.filter("n = 1").drop("n")
    reach = F.array(*[F.lit(i) for i in range(-2, 3)])
    around = lone.select("id", "x", "y", F.explode(reach).alias("dx"), "cx", "cy").select("id", "x", "y", (F.col("cx") + F.col("dx")).alias("cx"), "cy", "dx")
    around = around.select("id", "x", "y", "cx", F.explode(reach).alias("dy"), "cy", "dx").select("id", "x", "y", "cx", (F.col("cy") + F.col("dy")).alias("cy"), "dx", "dy")
    around = around.filter((F.col("dx") != 0) | (F.col("dy") != 0)).drop("dx", "dy")
    # A square holds few lone askers (one point per square, 24 squares around), so the join cannot multiply a hot square
    # by a hot square; the hot side is only read once per asker.
    near = around.join(cell.select(F.col("x").alias("_x"), F.col("y").alias("_y"), "cx", "cy"), ["cx", "cy"]).filter(
        F.pow(F.col("_x") - F.col("x"), 2) + F.pow(F.col("_y") - F.col("y"), 2) < radius * radius
    )
    return sure.unionByName(near.select("id")).distinct()


def density(points: DataFrame, memberships: DataFrame, groups: DataFrame, radius: float = RADIUS) -> DataFrame:
    """Bounding box, mean spacing and crowded share of every group with enough members.

    ``groups`` (``group_id``, ``minimum_members``).
    """
    flagged = lookup_join(points, crowded_points(points, radius).withColumn("_near", F.lit(1)), ["id"])
    placed = lookup_join(memberships.select("group_id", "id"), flagged.select("id", "x", "y", F.coalesce("_near", F.lit(0)).alias("_near")), ["id"], "inner")
    width = F.greatest(F.lit(MIN_EXTENT), F.max("x") - F.min("x"))
    height = F.greatest(F.lit(MIN_EXTENT), F.max("y") - F.min("y"))
    measured = placed.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("members"), width.alias("width"), height.alias("height"), (F.sum("_near") / F.count(F.lit(1))).alias("crowded")
    )
    measured = measured.withColumn("spacing", F.sqrt(F.col("width") * F.col("height") / F.col("members")))
    limits = groups.select("group_id", F.coalesce("minimum_members", F.lit(DEFAULT_MINIMUM)).alias("_minimum"))
    return lookup_join(measured, limits, ["group_id"], "inner").filter(F.col("members") >= F.col("_minimum")).drop("_minimum")


def eligible_groups(metrics: DataFrame, groups: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """Groups that may own points: ``pass`` 1 in order of level (coarse first), ``pass`` 2 for the crowded remainder of
    groups too wide to show whole (fine first).  Groups active before keep looser limits.

    ``groups``: ``group_id``, ``level``, ``maximum_span``, optional ``seq`` as tie order.
    """
    order = [c for c in ("seq",) if c in groups.columns]
    joined = lookup_join(metrics, groups.select("group_id", "level", "maximum_span", *order), ["group_id"], "inner")
    if active is not None:
        joined = lookup_join(joined, active.select("group_id").distinct().withColumn("_was", F.lit(True)), ["group_id"])
    else:
        joined = joined.withColumn("_was", F.lit(None).cast("boolean"))
    was = F.coalesce("_was", F.lit(False))

    def limit(name: str) -> Column:
        return F.when(was, F.lit(STILL_DENSE[name])).otherwise(F.lit(DENSE[name]))

    wide = F.greatest("width", "height") > F.coalesce("maximum_span", F.lit(float("inf"))) * limit("span")
    crowded = F.col("crowded") >= limit("crowded")
    dense = (F.col("spacing") <= limit("spacing")) | crowded
    turn = F.when(wide & crowded, 2).when(~wide & dense, 1)
    return joined.withColumn("pass", turn).filter(F.col("pass").isNotNull()).select("group_id", "level", "pass", *order)


def assign_owners(
    points: DataFrame,
    memberships: DataFrame,
    eligible: DataFrame,
    protected: DataFrame | None = None,
    expanded: DataFrame | None = None,
    manual: DataFrame | None = None,
    minimum_free: int = 2,
) -> DataFrame:
    """Exactly one owner per point: itself, a manual group, or an automatic group with at least two free members.

    ``memberships`` (``group_id``, ``id``); ``protected`` (``id``) stay individual; ``expanded`` (``group_id``) never
    own and keep their members out of automatic groups; ``manual`` (``group_id``, ``id``, ``seq``) come first.

    Automatic groups take turns: pass 1 from the coarsest level, pass 2 from the finest, within a level by ``seq``
    (backwards in pass 2), then by id.  A group that would get fewer than ``minimum_free`` points takes none, so they
    stay free for the groups behind it, of any level and also where groups of one level overlap.
    """
    free = points.select("id").distinct()
    if protected is not None:
        free = free.join(protected.select("id").distinct(), "id", "left_anti")
    owned = None
    if manual is not None:
        taken = manual.join(free, "id", "left_semi").groupBy("id").agg(F.min_by("group_id", "seq").alias("group_id"))
        owned = cut_lineage(taken.select("id", F.concat(F.lit("manual:"), F.col("group_id").cast("string")).alias("owner"), F.lit("manual").alias("mode")))
        free = free.join(owned, "id", "left_anti")
    if expanded is not None:
        opened = memberships.join(expanded.select("group_id").distinct(), "group_id", "left_semi").select("id").distinct()
        free = free.join(opened, "id", "left_anti")
        eligible = eligible.join(expanded.select("group_id").distinct(), "group_id", "left_anti")
    seq = F.coalesce(F.col("seq").cast("bigint"), F.lit(0)) if "seq" in eligible.columns else F.lit(0).cast("bigint")
    level = F.coalesce(F.col("level").cast("double"), F.lit(float("-inf")))
    onward = F.when(F.col("pass") == 1, -1).otherwise(1)
    turns = eligible.select("group_id", F.struct(F.col("pass"), (level * onward).alias("level"), (seq * -onward).alias("seq"), F.col("group_id")).alias("_turn"))
    members = memberships.select("group_id", "id").distinct().join(free, "id", "left_semi")
    won = _serve(lookup_join(members, turns, ["group_id"], "inner"), minimum_free)
    won = won.select("id", F.concat(F.lit("automatic:"), F.col("group_id").cast("string")).alias("owner"), F.lit("automatic").alias("mode"))
    owned = won if owned is None else owned.unionByName(won)
    everyone = points.select("id").distinct()
    return lookup_join(everyone, owned, ["id"]).select("id", F.coalesce("owner", F.col("id").cast("string")).alias("owner"), F.coalesce("mode", F.lit("individual")).alias("mode"))


def _serve(candidates: DataFrame, minimum: int) -> DataFrame:
    """``group_id`` of each ``id`` when groups take their free members in order of ``_turn`` and need ``minimum`` of them.

    A group wins for certain when enough points have no other open group before it, and loses for certain when too few
    points are without a winner before it.  The first open group is always one of the two, so every round decides some.
    """
    state = cut_lineage(candidates.withColumn("_won", F.lit(False)))
    turn = Window.partitionBy("id").orderBy("_turn")
    earlier = turn.rowsBetween(Window.unboundedPreceding, -1)
    while not state.filter(~F.col("_won")).isEmpty():
        beaten = F.coalesce(F.max("_won").over(earlier), F.lit(False))
        state = state.withColumn("_first", F.row_number().over(turn) == 1).withColumn("_beaten", beaten).filter(~F.col("_beaten")).drop("_beaten")
        state = cut_lineage(state)
        counts = state.groupBy("group_id").agg(F.count_if("_first").alias("_sure"), F.count(F.lit(1)).alias("_most"))
        verdict = counts.filter(F.col("_most") >= minimum).select("group_id", (F.col("_sure") >= minimum).alias("_wins"))
        state = lookup_join(state.drop("_first"), verdict, ["group_id"], "inner")
        state = cut_lineage(state.withColumn("_won", F.col("_won") | F.col("_wins")).drop("_wins"))
    return state.groupBy("id").agg(F.min_by("group_id", "_turn").alias("group_id"))


def owner_breakdown(owners: DataFrame, points: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """Members of each group by category, and how many of them match a search."""
    joined = lookup_join(owners.filter("mode <> 'individual'"), points.select("id", "category"), ["id"])
    if matches is not None:
        joined = lookup_join(joined, matches.select("id").distinct().withColumn("_hit", F.lit(1)), ["id"])
    else:
        joined = joined.withColumn("_hit", F.lit(0))
    return joined.groupBy("owner", "category").agg(F.count(F.lit(1)).alias("members"), F.sum(F.coalesce("_hit", F.lit(0))).alias("matching"))


def aggregation_counts(owners: DataFrame) -> DataFrame:
    """Totals of an ownership table (one row)."""
    mode = F.col("mode")
    groups = lambda name: F.count_distinct(F.when(mode == name, F.col("owner")))
    return owners.agg(
        F.count(F.lit(1)).alias("scope"),
        F.count_if(mode == "individual").alias("individual"),
        F.count_if(mode == "automatic").alias("automatic_members"),
        groups("automatic").alias("automatic_groups"),
        F.count_if(mode == "manual").alias("manual_members"),
        groups("manual").alias("manual_groups"),
        F.count_distinct("owner").alias("representations"),
    )


def closed_groups(modules: DataFrame, expanded: Sequence[str], path: str = "region_path") -> DataFrame:
    """First closed region on each module's region path (outermost first); null when all of them are open."""
    opened = F.array(*[F.lit(item) for item in expanded]) if expanded else F.array().cast("array<string>")
    return modules.withColumn("closed_group", F.get(F.filter(path, lambda region: ~F.array_contains(opened, region)), F.lit(0)))
