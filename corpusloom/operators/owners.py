"""Longest-prefix ownership: which directory owner a path belongs to.

A prefix condition would plan as a nested loop.  Instead each distinct directory is expanded to its ancestors and
joined by equality; the longest hit wins.  Directories near the root are ancestors of almost everything, so the
join is salted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestor_dirs, dir_name, glob_to_regex
from ..plans import lookup_join, only_value
from .filters import path_keys, pattern_keys

ROOT_SALT = 8


def nearest_owner(
    items: DataFrame,
    owners: DataFrame,
    by: Sequence[str] = (),
    path: str = "path",
    owner_path: str = "owner_path",
    owner: str = "owner",
    prefer: Column | None = None,
    is_directory: bool = False,
    exclude_self: bool = False,
    salt: int = ROOT_SALT,
) -> DataFrame:
    """Attach the deepest owner whose directory contains each path (null when none does).

    ``prefer`` orders several owners of one directory (largest wins, then the smallest owner).  ``is_directory``
    treats the item paths themselves as directories; ``exclude_self`` then requires a strictly containing owner.
    """
    rank = (F.lit(0) if prefer is None else prefer).alias("_rank")
    best = owners.select(*by, F.col(owner_path).alias("_dir"), F.col(owner).alias("_owner"), rank).groupBy(*by, "_dir").agg(
        F.min_by("_owner", F.struct(-F.col("_rank"), F.col("_owner"))).alias("_owner")
    )
    place = F.col(path) if is_directory else dir_name(path)
    keyed = items.withColumn("_place", place)
    own = F.array(F.col("_place")) if is_directory and not exclude_self else F.array().cast("array<string>")
    chain = F.array_distinct(F.concat(ancestor_dirs(F.col("_place") if is_directory else F.concat_ws("/", "_place", F.lit("x"))), own))
    if exclude_self:
        chain = F.filter(chain, lambda item: item != F.col("_place"))
    places = keyed.select(*by, "_place").distinct().withColumn("_dir", F.explode(chain))
    hits = lookup_join(places, best, [*by, "_dir"], "inner", salt)
    depth = F.when(F.col("_dir") == ".", 0).otherwise(F.length("_dir"))
    nearest = hits.groupBy(*by, "_place").agg(F.max_by(F.struct("_dir", "_owner"), depth).alias("_hit"))
    joined = lookup_join(keyed, nearest, [*by, "_place"])
    return joined.select(*items.columns, F.col("_hit._owner").alias(owner), F.col("_hit._dir").alias(owner_path))


def region_nesting(regions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Parent of each region (``id``, ``path``): the deepest region that strictly contains its path (never the root ``.``)."""
    candidates = regions.filter(F.col("path") != ".").select(*by, F.col("path").alias("owner_path"), F.col("id").alias("owner"))
    nested = nearest_owner(regions, candidates, by, is_directory=True, exclude_self=True)
    return nested.withColumnsRenamed({"owner": "parent_id", "owner_path": "parent_path"})


def pattern_root(dirs: DataFrame, patterns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """For each directory, the ancestor (or itself) that best fits a workspace pattern.

    An ancestor fits when a positive pattern matches it and no negative one does; the best is the one whose depth is
    closest to the pattern's own depth, then the longest.
    """
    plain = F.regexp_replace("pattern", "^!", "")
    rules = patterns.select(
        *by,
        F.col("pattern").startswith("!").alias("_negative"),
        plain.alias("_glob"),
        F.size(F.split(F.regexp_replace(plain, r"^\./|/$", ""), "/")).alias("_expected"),
    ).distinct()
    rules = pattern_keys(rules, F.col("_glob")).withColumn("_regex", glob_to_regex("_glob")).drop("_glob")
    ancestors = dirs.select(*by, "path").distinct().withColumn(
        "ancestor", F.explode(F.array_distinct(F.concat(F.filter(ancestor_dirs("path"), lambda d: d != "."), F.array("path"))))
    )
    # A rule meets each distinct ancestor once; the directories below it are joined to its verdict.
    keyed = path_keys(ancestors.select(*by, "ancestor").distinct(), F.col("ancestor"))
    hits = keyed.join(rules, [*by, "_key", "_part"]).filter(F.rlike(F.col("ancestor"), F.col("_regex")))
    gap = F.abs(F.size(F.split("ancestor", "/")) - F.col("_expected"))
    per = hits.groupBy(*by, "ancestor").agg(F.max("_negative").alias("_rejected"), F.min(F.when(~F.col("_negative"), gap)).alias("_gap"))
    fit = lookup_join(ancestors, per.filter(~F.col("_rejected") & F.col("_gap").isNotNull()), [*by, "ancestor"], "inner")
    best = fit.groupBy(*by, "path").agg(F.min_by("ancestor", F.struct("_gap", -F.length("ancestor"))).alias("root"))
    return lookup_join(dirs, best, [*by, "path"])


def inherit_definition(entities: DataFrame, ancestors: DataFrame, definitions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Definition owner of each entity (``id``, ``path``): nearest recorded definition (``id``, ``path``) up its parent
    chain (itself included), else the longest path prefix, else undetermined."""
    recorded = definitions.select(*by, F.col("id").alias("ancestor"), F.col("id").alias("_definition"))
    chain = lookup_join(ancestors, recorded, [*by, "ancestor"], "inner")
    near = chain.groupBy(*by, "id").agg(F.min_by("_definition", "distance").alias("_by_chain"))
    places = definitions.select(*by, F.col("path").alias("owner_path"), F.col("id").alias("owner"))
    placed = nearest_owner(lookup_join(entities, near, [*by, "id"]), places, by, is_directory=True)
    basis = F.when(F.col("_by_chain").isNotNull(), "parent").when(F.col("owner").isNotNull(), "path").otherwise("undetermined")
    return placed.withColumn("definition_basis", basis).withColumn("definition_id", F.coalesce("_by_chain", "owner")).drop("_by_chain", "owner", "owner_path")


def common_ancestor(members: DataFrame, group: Sequence[str] = ("group",), path: str = "path") -> DataFrame:
    """Deepest directory shared by all paths of a group.

    The shared prefix of a set of strings is the shared prefix of its smallest and largest element, so two mergeable
    aggregates are enough whatever the group size.
    """
    parts = F.split(path, "/")
    ends = members.groupBy(*group).agg(F.min(parts).alias("_low"), F.max(parts).alias("_high"))
    width = F.least(F.size("_low"), F.size("_high"))
    same = F.transform(F.sequence(F.lit(1), width), lambda n: F.slice("_low", F.lit(1), n) == F.slice("_high", F.lit(1), n))
    shared = F.size(F.filter(same, lambda item: item))
    prefix = F.array_join(F.when(shared > 0, F.slice("_low", F.lit(1), shared)).otherwise(F.array().cast("array<string>")), "/")
    return ends.select(*group, F.when(prefix == "", F.lit(".")).otherwise(prefix).alias("ancestor"))
