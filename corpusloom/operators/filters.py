"""Filters and graph projections.  Graphs are a node table (``id``, …) and an edge table (``id``, ``src``, ``dst``, …)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import is_auxiliary, is_generated
from ..functions.paths import glob_regex, glob_root, glob_to_regex, path_prefixes
from ..plans import only_value


def glob_match(path: Column, patterns: Sequence[str]) -> Column:
    """True when any positive glob and no ``!`` glob matches.  Patterns are literals, compiled into two regular
    expressions, so the filter stays in the scan stage."""
    positive = [glob_regex(item) for item in patterns if not item.strip().startswith("!")]
    negative = [glob_regex(item.strip()[1:]) for item in patterns if item.strip().startswith("!")]
    clean = F.regexp_replace(path, r"^\./", "")
    hit = clean.rlike("|".join(positive)) if positive else F.lit(False)
    return hit & ~clean.rlike("|".join(negative)) if negative else hit


SPREAD = 8


def pattern_keys(patterns: DataFrame, pattern: Column) -> DataFrame:
    """Add ``_key`` (what every matching path must share) and ``_part`` to a table of globs, for an equality join with
    :func:`path_keys`.

    The key is the fixed directory before the first wildcard; where there is none, the last segment if it is fixed, its
    fixed extension, or the number of segments; only globs with none of these share one key.  Each glob is copied to
    ``SPREAD`` parts, over which the paths of one key are hashed.
    """
    body = F.regexp_replace(pattern, r"^\./|/$", "")
    root, leaf = glob_root(pattern), F.substring_index(body, "/", -1)
    extension = F.regexp_extract(leaf, r"(\.[^.*?/]+)$", 1)
    deep = F.contains(body, F.lit("**"))
    key = (
        F.when(root != ".", F.concat(F.lit("in:"), root))
        .when(~leaf.rlike(r"[*?]"), F.concat(F.lit("leaf:"), leaf))
        .when(extension != "", F.concat(F.lit("ext:"), extension))
        .when(~deep, F.concat(F.lit("depth:"), F.size(F.split(body, "/")).cast("string")))
        .otherwise(F.lit("any"))
    )
    return patterns.withColumn("_key", key).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))


def path_keys(paths: DataFrame, path: Column) -> DataFrame:
    """Add every ``_key`` under which a glob of :func:`pattern_keys` can match ``path``, and its ``_part``."""
    leaf = F.substring_index(path, "/", -1)
    keys = F.concat(
        F.transform(path_prefixes(path), lambda prefix: F.concat(F.lit("in:"), prefix)),
        F.array(
            F.concat(F.lit("leaf:"), leaf),
            F.concat(F.lit("ext:"), F.regexp_extract(leaf, r"(\.[^.]+)$", 1)),
            F.concat(F.lit("depth:"), F.size(F.split(path, "/")).cast("string")),
            F.lit("any"),
        ),
    )
    return paths.withColumn("_part", F.pmod(F.hash(path), F.lit(SPREAD))).withColumn("_key", F.explode(F.array_distinct(keys)))


def glob_join(paths: DataFrame, patterns: DataFrame, by: Sequence[str] = (), path: str = "path") -> DataFrame:
    """Rows of ``paths`` selected by a pattern table (``pattern``, a leading ``!`` negates).

    A path meets only patterns with which it shares a fixed piece (see :func:`pattern_keys`).
    """
    glob = F.regexp_replace("pattern", "^!", "")
    keyed = patterns.select(*by, F.col("pattern").startswith("!").alias("_negative"), glob.alias("_glob")).distinct()
    keyed = pattern_keys(keyed, F.col("_glob")).withColumn("_regex", glob_to_regex("_glob")).drop("_glob")
    own = F.regexp_replace(F.col(path), r"^\./", "")
    candidates = path_keys(paths.select(*by, path).distinct().withColumn("_own", own), F.col("_own"))
    hits = candidates.join(keyed, [*by, "_key", "_part"]).filter(F.rlike(F.col("_own"), F.col("_regex")))
    flags = hits.groupBy(*by, path).agg(F.max("_negative").alias("_rejected"), F.min("_negative").alias("_only_negative"))
    chosen = flags.filter(~F.col("_rejected") & ~F.col("_only_negative")).select(*by, path)
    return paths.join(chosen, [*by, path], "left_semi")


def route_match(path: Column, routes: Sequence[str]) -> Column:
    """As :func:`glob_match` with a single kind of wildcard, on the path without query and fragment."""

    def regex(route: str) -> str:
        return "^" + ".*".join(glob_regex(part)[1:-1] if part else "" for part in route.split("*")) + "$"

    positive = [regex(item) for item in routes if not item.startswith("!")]
    negative = [regex(item[1:]) for item in routes if item.startswith("!")]
    name = F.regexp_extract(path, r"^([^?#]*)", 1)
    hit = name.rlike("|".join(positive)) if positive else F.lit(False)
    return hit & ~name.rlike("|".join(negative)) if negative else hit


def with_both_ends(edges: DataFrame, nodes: DataFrame, by: Sequence[str] = (), node: str = "id") -> DataFrame:
    """Edges whose two ends are both in ``nodes``."""
    ids = nodes.select(*by, F.col(node).alias("_node"))
    for end in ("src", "dst"):
        edges = edges.join(ids.withColumnRenamed("_node", end), [*by, end], "left_semi")
    return edges


def edges_for(
    nodes: DataFrame,
    relations: DataFrame,
    keep: Column | None = None,
    kind: Callable[[Column], Column] | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Relations that satisfy ``keep`` between given nodes, with an optional change of kind."""
    chosen = with_both_ends(relations if keep is None else relations.filter(keep), nodes, by)
    return chosen if kind is None else chosen.withColumn("kind", kind(F.col("kind")))


def semantic_filter(
    nodes: DataFrame,
    edges: DataFrame,
    scope: str | None = None,
    kinds: Sequence[str] = (),
    confidences: Sequence[str] = (),
    hide_auxiliary: bool = False,
    members: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Nodes of a scope (group name or path prefix), kinds and confidences, and the edges left between them."""
    keep = F.lit(True)
    if scope:
        keep = keep & ((F.col("group") == scope) | F.coalesce((F.col("path") == scope) | F.col("path").startswith(scope + "/"), F.lit(False)))
    if kinds:
        keep = keep & F.col("kind").isin(*kinds)
    if confidences:
        keep = keep & F.col("confidence").isin(*confidences)
    if hide_auxiliary:
        keep = keep & ~F.coalesce(is_auxiliary("path"), F.lit(False)) & (F.col("group") != "Tests")
    chosen = nodes.filter(keep)
    if members is not None:
        chosen = chosen.join(members.select("id"), "id", "left_semi")
    return chosen, with_both_ends(edges, chosen)


# Node kinds a view shows even without edges.
INTRINSIC_KIND = {"function-call-flow": "function", "data-model": "model", "data-flow": "value"}


def project_view(nodes: DataFrame, edges: DataFrame, view: str, excluded: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes used by an edge of ``view`` or of the kind it always shows (unless ``excluded``)."""
    shown = edges.filter(F.array_contains("views", view))
    used = shown.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("_used", F.lit(True))
    intrinsic = F.col("kind") == INTRINSIC_KIND[view] if view in INTRINSIC_KIND else F.lit(False)
    if excluded is not None:
        intrinsic = intrinsic & ~F.coalesce(excluded, F.lit(False))
    chosen = nodes.join(used, "id", "left").filter(F.coalesce("_used", F.lit(False)) | intrinsic).drop("_used")
    return chosen, with_both_ends(shown, chosen)


def apply_layer(
    source: tuple[DataFrame, DataFrame],
    observed: tuple[DataFrame, DataFrame] | None,
    layer: str,
    view: str,
) -> tuple[DataFrame, DataFrame]:
    """Source, observed or combined layer of one view.

    The observed layer hides links to source positions; a data-flow view keeps only values at an observed boundary.
    """
    nodes, edges = source
    if observed is None or layer == "source" or view == "data-model":
        return (nodes, edges) if layer != "observed" else (nodes.limit(0), edges.limit(0))
    seen_nodes, seen_edges = observed
    seen_edges = seen_edges.filter(F.array_contains("views", view))
    if layer == "observed":
        seen_edges = seen_edges.filter(F.col("kind") != "observed-at")
    if view == "data-flow":
        ends = seen_edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        seen_nodes = seen_nodes.join(ends, "id", "left_semi")
    else:
        seen_nodes = seen_nodes.filter(F.col("kind") != "value")
    if layer == "combined":
        seen_nodes = nodes.unionByName(seen_nodes, allowMissingColumns=True)
        seen_edges = edges.unionByName(seen_edges, allowMissingColumns=True)
    return seen_nodes, with_both_ends(seen_edges, seen_nodes)


# Attributes of an observed record that do not depend on the current source.
TRACE_ATTRIBUTES = (
    r"^(?:recordFormat|traceId|spanId|sourceFile|recordedSourcePath|recordedSourceLine|durationMs|durationRaw|durationUnit"
    r"|timeUnit|timeOrigin|startTimeUnixNano|endTimeUnixNano|timeUnixNano|observedTimeUnixNano|startTime|endTime|timestamp"
    r"|time|ts|endTs|code\.(?:file\.path|filepath|line\.number|lineno|function\.name|function|source\.sha256)"
    r"|data\.(?:input|output)\.name|owner|direction)$"
)


def adapt_data_trace(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Observed input/output boundaries only: span↔value edges, allowed attributes, no source location."""
    kinds = nodes.select("id", "kind")
    ends = edges.filter(F.array_contains("views", "data-flow") & (F.col("kind") == "observed-data"))
    ends = ends.join(kinds.withColumnsRenamed({"id": "src", "kind": "_from"}), "src").join(
        kinds.withColumnsRenamed({"id": "dst", "kind": "_to"}), "dst"
    )
    kept = ends.filter(((F.col("_from") == "value") & (F.col("_to") == "span")) | ((F.col("_from") == "span") & (F.col("_to") == "value")))
    kept = kept.drop("_from", "_to").withColumn("views", F.array(F.lit("data-flow"))).withColumn("confidence", F.lit("observed"))
    used = kept.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    recorded = F.map_filter("attributes", lambda key, _: key.rlike(TRACE_ATTRIBUTES))
    moved = F.filter(
        F.array(
            F.struct(F.lit("recordedSourcePath").alias("key"), F.col("path").alias("value")),
            F.struct(F.lit("recordedSourceLine").alias("key"), F.col("line").cast("string").alias("value")),
        ),
        lambda item: item["value"].isNotNull(),
    )
    recorded = F.map_filter(recorded, lambda key, _: ~F.exists(moved, lambda item: item["key"] == key))
    kept_nodes = nodes.join(used, "id", "left_semi").withColumn("attributes", F.map_concat(recorded, F.map_from_entries(moved)))
    return kept_nodes.withColumn("path", F.lit(None).cast("string")).withColumn("line", F.lit(None).cast("int")), kept


def edge_direction(edges: DataFrame, selected: DataFrame, column: str = "direction") -> DataFrame:
    """outgoing / incoming / internal relative to a selected node set (``id``), null when untouched."""
    chosen = selected.select("id").distinct()
    flagged = edges.join(chosen.select(F.col("id").alias("src"), F.lit(True).alias("_from")), "src", "left").join(
        chosen.select(F.col("id").alias("dst"), F.lit(True).alias("_to")), "dst", "left"
    )
    leaving, arriving = F.col("_from").isNotNull(), F.col("_to").isNotNull()
    direction = F.when(leaving & arriving, "internal").when(arriving, "incoming").when(leaving, "outgoing")
    return flagged.withColumn(column, direction).drop("_from", "_to")


def visible_by_direction(edges: DataFrame, selected: DataFrame, direction: str, selected_edge: str | None = None) -> DataFrame:
    """Edges shown for a direction choice: untouched and internal edges always, and the selected edge itself."""
    directed = edge_direction(edges, selected, "_direction")
    if direction == "both":
        return directed.drop("_direction")
    shown = F.coalesce(F.col("_direction").isin("internal", direction), F.lit(True))
    if selected_edge is not None:
        shown = shown | (F.col("id") == selected_edge)
    return directed.filter(shown).drop("_direction")


def filter_with_context(nodes: DataFrame, edges: DataFrame, type_: str, selected: str | None = None, context: DataFrame | None = None) -> DataFrame:
    """Nodes of one type plus the selection, its direct neighbours and further context ids (ancestors, region members)."""
    kept = nodes.filter(F.col("type") == type_).select("id")
    if selected is not None:
        near = edges.filter((F.col("src") == selected) | (F.col("dst") == selected))
        kept = kept.unionByName(near.select(F.explode(F.array("src", "dst")).alias("id"))).unionByName(
            nodes.filter(F.col("id") == selected).select("id")
        )
    if context is not None:
        kept = kept.unionByName(context.select("id"))
    return nodes.join(kept.distinct(), "id", "left_semi")


def classify_auxiliary(files: DataFrame) -> DataFrame:
    """Flags ``auxiliary`` and ``generated`` from the path and the first characters of the text."""
    return files.withColumn("auxiliary", is_auxiliary("path")).withColumn("generated", is_generated("path", "text"))


def foreground_edges(edges: DataFrame, edge: str | None = None, node: str | None = None, region: str | None = None) -> DataFrame:
    """Edges related to the selection; ``layer`` 1 marks the selected edge, which is drawn after all others (0)."""
    touched = F.lit(False)
    if edge is not None:
        touched = touched | (F.col("id") == edge)
    for end in (node, region):
        if end is not None:
            touched = touched | (F.col("src") == end) | (F.col("dst") == end)
    layer = F.when(F.col("id") == edge, 1).otherwise(0) if edge is not None else F.lit(0)
    return edges.filter(touched).withColumn("layer", layer)


def selection_context(
    edges: DataFrame,
    node: str | None = None,
    region: str | None = None,
    summary_members: DataFrame | None = None,
    memberships: DataFrame | None = None,
    region_parents: DataFrame | None = None,
    keep_internal: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Context ids of a selection and the edges with any direction to them.

    A node brings its summary members (``summary_id``, ``id``) and the regions containing it (``region_id``, ``id``);
    a region brings its members and its ancestor regions (``id``, ``ancestor``).
    """
    spark = edges.sparkSession
    parts = []
    if node is not None:
        parts.append(spark.createDataFrame([(node,)], "id string"))
        if summary_members is not None:
            parts.append(summary_members.filter(F.col("summary_id") == node).select("id"))
        if memberships is not None:
            parts.append(memberships.filter(F.col("id") == node).select(F.col("region_id").alias("id")))
    if region is not None:
        parts.append(spark.createDataFrame([(region,)], "id string"))
        if memberships is not None:
            parts.append(memberships.filter(F.col("region_id") == region).select("id"))
        if region_parents is not None:
            parts.append(region_parents.filter(F.col("id") == region).select(F.col("ancestor").alias("id")))
    ids = parts[0]
    for part in parts[1:]:
        ids = ids.unionByName(part)
    ids = ids.distinct()
    related = edge_direction(edges, ids).filter(F.col("direction").isNotNull())
    if not keep_internal:
        related = related.filter(F.col("direction") != "internal")
    return ids, related
