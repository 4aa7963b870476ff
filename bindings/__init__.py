"""Bindings of the operators to the driver tables: one Spark query and, where SQL can say it, one oracle per entry."""

from .registry import ORACLES, QUERIES
from . import code, graphs, grouping, model, readers, records, relations, resolution, search_and_sets, streams  # noqa: F401  (registers the queries)

__all__ = ["ORACLES", "QUERIES"]
