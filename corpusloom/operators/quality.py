"""Integrity report of a dictionary: one row per broken rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import lookup_key
from .tree import roots

# Fixed value: ids must be usable in addresses.
ID_PATTERN = r"^[a-z0-9]+(?:-[a-z0-9]+)*$"


def _row(rule: str, id_: Column, detail: Column) -> list[Column]:
    return [F.lit(rule).alias("rule"), id_.cast("string").alias("id"), detail.cast("string").alias("detail")]


def duplicates(entries: DataFrame, rule: str, key: str = "id") -> DataFrame:
    counted = entries.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return counted.select(*_row(rule, F.col(key), F.col("_n")))


def missing(entries: DataFrame, column: str, known: DataFrame, rule: str, id_column: str = "id") -> DataFrame:
    """References (``column``) without a target in ``known`` (``id``)."""
    named = entries.filter(F.col(column).isNotNull()).select(F.col(id_column).alias("_from"), F.col(column).alias("_to"))
    lost = named.join(known.select(F.col("id").alias("_to")), "_to", "left_anti")
    return lost.select(*_row(rule, F.col("_from"), F.col("_to"))).distinct()


def shared_values(entries: DataFrame, column: str, rule: str) -> DataFrame:
    """Values of an array column that belong to several entries."""
    listed = entries.select("id", F.explode(column).alias("_raw")).select("id", lookup_key("_raw").alias("_value")).distinct()
    per = listed.groupBy("_value").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_first")).filter("_n > 1")
    return per.select(*_row(rule, F.col("_value"), F.col("_n")))


def validate_dictionary(categories: DataFrame, stacks: DataFrame, map_nodes: DataFrame | None = None, id_pattern: str = ID_PATTERN) -> DataFrame:
    """(``rule``, ``id``, ``detail``) rows of everything wrong with a dictionary and its map.

    ``categories``: ``id``, ``parent_id``, ``related_ids``; ``stacks``: ``id``, ``category_id``, ``aliases``, ``package_names``,
    ``related_ids``, ``relationships``; ``map_nodes``: ``kind``, ``ref``, ``parent_ref``.
    """
    parts = [duplicates(categories, "duplicate-category"), duplicates(stacks, "duplicate-stack")]
    for entries, rule in ((categories, "bad-category-id"), (stacks, "bad-stack-id")):
        parts.append(entries.filter(~F.col("id").rlike(id_pattern)).select(*_row(rule, F.col("id"), F.lit(None))))
    parts.append(missing(categories, "parent_id", categories, "missing-parent"))
    parts.append(missing(categories.select("id", F.explode("related_ids").alias("_r")), "_r", categories, "missing-related-category"))
    parts.append(missing(stacks, "category_id", categories, "missing-category"))
    parts.append(missing(stacks.select("id", F.explode("related_ids").alias("_r")), "_r", stacks, "missing-related-stack"))
    if "relationships" in stacks.columns:
        parts.append(missing(stacks.select("id", F.explode("relationships").alias("_x")).select("id", F.col("_x.target_id").alias("_r")), "_r", stacks, "missing-relationship-target"))
    parts.append(shared_values(stacks, "package_names", "package-owned-twice"))
    parts.append(shared_values(stacks, "aliases", "alias-owned-twice"))
    looping = roots(categories.select("id", "parent_id").dropDuplicates(["id"])).filter("cyclic")
    parts.append(looping.select(*_row("parent-cycle", F.col("id"), F.lit(None))))
    if map_nodes is not None:
        for kind, entries, parent in (("category", categories, "parent_id"), ("stack", stacks, "category_id")):
            placed = map_nodes.filter(F.col("kind") == kind)
            parts.append(duplicates(placed, f"duplicate-map-{kind}", "ref"))
            parts.append(missing(placed, "ref", entries, f"unknown-map-{kind}", "ref"))
            absent = entries.select("id").distinct().join(placed.select(F.col("ref").alias("id")), "id", "left_anti")
            parts.append(absent.select(*_row(f"{kind}-not-in-map", F.col("id"), F.lit(None))))
            joined = placed.join(entries.select(F.col("id").alias("ref"), F.col(parent).alias("_expected")), "ref")
            wrong = joined.filter(~F.col("parent_ref").eqNullSafe(F.col("_expected")))
            parts.append(wrong.select(*_row(f"map-{kind}-parent", F.col("ref"), F.col("parent_ref"))).distinct())
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def validate_visual_groups(groups: DataFrame, categories: DataFrame) -> DataFrame:
    """Rules of the visual groups: ``groups`` has ``id``, ``side``, ``order`` and ``root_ids`` (array)."""
    top = categories.filter(F.col("parent_id").isNull()).select("id")
    listed = groups.select(F.col("id").alias("_group"), F.explode("root_ids").alias("id"))
    parts = [
        duplicates(groups, "duplicate-visual-group"),
        groups.filter(~F.col("side").isin("left", "right")).select(*_row("bad-side", F.col("id"), F.col("side"))),
        groups.filter(F.col("order") < 1).select(*_row("bad-order", F.col("id"), F.col("order"))),
        groups.groupBy("side", "order").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*_row("duplicate-order", F.col("side"), F.col("order"))),
        groups.filter(F.size("root_ids") == 0).select(*_row("empty-visual-group", F.col("id"), F.lit(None))),
        listed.join(categories.select("id"), "id", "left_anti").select(*_row("unknown-root", F.col("_group"), F.col("id"))),
        listed.join(categories.select("id"), "id", "left_semi").join(top, "id", "left_anti").select(*_row("not-a-root", F.col("_group"), F.col("id"))),
        duplicates(listed, "root-in-several-groups"),
        top.join(listed.select("id"), "id", "left_anti").select(*_row("root-without-group", F.col("id"), F.lit(None))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
