"""Headline queries, timed.  Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from bindings import QUERIES
from corpusloom.session import local_session

HEADLINE = [
    "bundle_relations", "bundle_with_environment", "summarize_graph", "boundary_stats", "partner_summary", "node_roles", "site_counts", "lift_edges", "edge_slots",
    "nearest_owner", "unique_lookup", "resolve_dependencies", "match_routes", "span_parents", "span_binding", "reaching_defs", "reaching_definitions", "begin_end_pairs", "merge_facts", "stack_usage",
    "external_groups", "dictionary_search", "entity_search", "scope_members", "tree_closure", "bfs_depths", "khop_relations", "scc_depths", "compress_paths", "density", "assign_owners", "resolve_links", "short_labels",
    "mask_secrets", "otlp_spans", "package_dependencies", "manifest_rows", "imports_relative", "call_resolution", "attribute_usage", "package_usage", "module_view", "validate_dictionary",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cores, shuffle_partitions=int(cores), memory="16g")
    QUERIES["bundle_relations"](spark, folder).count()  # start the JVM and the file caches
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_wall_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(folder).name}))
    spark.stop()


if __name__ == "__main__":
    main()
