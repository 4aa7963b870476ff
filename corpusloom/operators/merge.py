"""Keyed merges of facts, relations, evidence and warnings.

Sets stay as rows (one per key and element) and metadata as (key, name, value) rows; both merge with map-side
combination.  ``as_maps`` folds metadata back per fact, which is safe because names come from a fixed vocabulary.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_facts(facts: DataFrame, by: Sequence[str] = (), seq: str = "seq", flags: Sequence[str] = ()) -> DataFrame:
    """One row per fact id: columns of the first occurrence, boolean ``flags`` OR-ed over all of them."""
    keys = [*by, "id"]
    rest = [name for name in facts.columns if name not in (*keys, *flags, "evidence_ids", "metadata")]
    first = F.min_by(F.struct(*rest), seq).alias("_first")
    merged = facts.groupBy(*keys).agg(first, F.count(F.lit(1)).alias("occurrences"), *[F.max(flag).alias(flag) for flag in flags])
    return merged.select(*keys, "_first.*", "occurrences", *flags)


def merged_set(facts: DataFrame, column: str, by: Sequence[str] = (), item: str = "item") -> DataFrame:
    """Union of an array column over all occurrences of a fact, as distinct rows."""
    return facts.select(*by, "id", F.explode(column).alias(item)).distinct()


def merged_metadata(facts: DataFrame, by: Sequence[str] = (), seq: str = "seq", column: str = "metadata") -> DataFrame:
    """Last value of every metadata name per fact, as (id, name, value) rows."""
    entries = facts.select(*by, "id", seq, F.explode(column).alias("name", "value"))
    return entries.groupBy(*by, "id", "name").agg(F.max_by("value", seq).alias("value"))


def as_maps(metadata: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return metadata.groupBy(*by, "id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("metadata"))


def merge_relations(relations: DataFrame, by: Sequence[str] = (), seq: str = "seq") -> DataFrame:
    """One row per relation id with its first ends and kind; evidence and metadata merge like those of facts."""
    return merge_facts(relations, by, seq)


def upsert(rows: DataFrame, by: Sequence[str] = (), seq: str = "seq") -> DataFrame:
    """Last row per id (evidence, warnings)."""
    keys = [*by, "id"]
    rest = [name for name in rows.columns if name not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_last")).select(*keys, "_last.*")


def stack_usage(attributions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Usage of a technology in a scope: distinct evidence and source facts, and whether it is used or only declared."""
    return attributions.groupBy(*by, "scope", "stack_id").agg(
        F.count_distinct("evidence_id").alias("evidence"),
        F.count_distinct("fact_id").alias("facts"),
        F.count_distinct("kind").alias("kinds"),
        F.max(F.col("role") == "usage").alias("used"),
        F.max(F.col("role") == "declaration").alias("declared"),
    )


def stack_usage_evidence(attributions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The evidence set behind each usage, as rows."""
    return attributions.select(*by, "scope", "stack_id", "evidence_id", "role").distinct()
