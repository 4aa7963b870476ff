"""Set operations on id, evidence and graph tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

EVIDENCE_KEY = ("path", "start", "end", "description")


def union_distinct(*tables: DataFrame, keys: Sequence[str] = EVIDENCE_KEY) -> DataFrame:
    """Rows of all tables, one per key."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out.dropDuplicates(list(keys))


def intersection(first: DataFrame, second: DataFrame, on: Sequence[str] = ("id",)) -> DataFrame:
    return first.select(*on).intersect(second.select(*on))


def difference(known: DataFrame, owned: DataFrame, on: Sequence[str] = ("id",)) -> DataFrame:
    return known.join(owned.select(*on).distinct(), list(on), "left_anti")


def overlay(source: DataFrame, observed: DataFrame) -> DataFrame:
    """Source and observed records side by side; neither replaces the other."""
    return source.unionByName(observed, allowMissingColumns=True)
