"""Relation bundling and relation statistics.

Bundles keep their originals as a separate long table (edge → bundle), never as an array: one bundle may hold a
third of all relations, and a row per original needs no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import lookup_join
from .filters import edge_direction


def _with_owners(edges: DataFrame, owners: DataFrame, by: Sequence[str] = (), salt: int = 0) -> DataFrame:
    """Attach ``src_owner``/``dst_owner``; edges with an unowned end are dropped."""
    for end in ("src", "dst"):
        side = owners.select(*by, F.col("id").alias(end), F.col("owner").alias(f"{end}_owner"))
        edges = lookup_join(edges, side, [*by, end], "inner", salt)
    return edges


def _untouched() -> Column:
    return (F.col("src_owner") == F.col("src")) & (F.col("dst_owner") == F.col("dst"))


def bundle_key(keys: Sequence[str]) -> Column:
    """Id of a bundle, built from its key columns; an untouched edge keeps its own id."""
    key = F.to_json(F.array(F.col("src_owner").cast("string"), F.col("dst_owner").cast("string"), *[F.col(k).cast("string") for k in keys]))
    return F.when(_untouched(), F.col("id").cast("string")).otherwise(F.concat(F.lit("bundle:"), key))


def bundle_relations(
    edges: DataFrame,
    owners: DataFrame,
    keys: Sequence[str] = ("kind", "confidence"),
    by: Sequence[str] = (),
    salt: int = 0,
) -> DataFrame:
    """Group edges by the owners of their ends and by ``keys``.

    ``owners`` maps each ``id`` to one ``owner``.  Edges whose ends own themselves pass through one by one;
    ``internal`` marks bundles inside one owner.
    """
    owned = _with_owners(edges, owners, by, salt).withColumn("_own", F.when(_untouched(), F.col("id").cast("string")))
    grouped = owned.groupBy(*by, "src_owner", "dst_owner", *keys, "_own").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(
        *by,
        "src_owner",
        "dst_owner",
        *keys,
        "n",
        F.col("_own").isNull().alias("aggregated"),
        (F.col("_own").isNull() & (F.col("src_owner") == F.col("dst_owner"))).alias("internal"),
    )


def bundle_members(edges: DataFrame, owners: DataFrame, keys: Sequence[str] = ("kind", "confidence"), by: Sequence[str] = ()) -> DataFrame:
    """Originals of each bundle as rows (``bundle_id``, ``id``): the way back from a bundle to its edges."""
    return _with_owners(edges, owners, by).select(*by, bundle_key(keys).alias("bundle_id"), "id")


def relation_class(src: Column, dst: Column, origin: Column | None = None) -> Column:
    """connection / internal / self for a bundled relation: equal owners are a real self relation only when the
    original ends were already that owner."""
    changed = (F.col("src") != src) | (F.col("dst") != dst)
    if origin is not None:
        changed = changed | F.coalesce(origin == "source", F.lit(False))
    return F.when(src != dst, "connection").when(changed, "internal").otherwise("self")


def bundle_arch(edges: DataFrame, owners: DataFrame, environment: str = "environment", by: Sequence[str] = (), origin: str | None = None) -> DataFrame:
    """Bundling that keeps environments and relation classes apart."""
    owned = _with_owners(edges, owners, by).withColumn(
        "relation", relation_class(F.col("src_owner"), F.col("dst_owner"), F.col(origin) if origin else None)
    )
    keys = [*by, "src_owner", "dst_owner", "kind", "confidence", environment, "relation"]
    return owned.withColumn(environment, F.coalesce(environment, F.lit(""))).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def overview_owner(group: Column, path: Column, depth: int = 2) -> Column:
    """Overview key of a node: its group and the first path segments, or ``runtime`` without a path."""
    head = F.array_join(F.slice(F.split(path, "/"), 1, depth), "/")
    return F.concat(group, F.lit(" / "), F.coalesce(head, F.lit("runtime")))


def summarize_graph(nodes: DataFrame, edges: DataFrame, expanded: Sequence[str] = (), minimum: int = 1) -> tuple[DataFrame, DataFrame]:
    """Overview of a graph: groups with member and file counts, and edges re-keyed between them.

    Groups named in ``expanded`` (or smaller than ``minimum``) stay as their own nodes.
    """
    keyed = nodes.withColumn("_key", overview_owner(F.col("group"), F.col("path")))
    if minimum > 1:
        sizes = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_size"))
        keyed = lookup_join(keyed, sizes, ["_key"])
        grouped = F.col("_size") >= minimum
    else:
        grouped = F.lit(True)
    open_ = F.col("_key").isin(*expanded) if expanded else F.lit(False)
    owned = keyed.withColumn("owner", F.when(grouped & ~open_, F.concat(F.lit("overview:"), F.col("_key"))).otherwise(F.col("id")))
    groups = owned.groupBy("owner").agg(F.count(F.lit(1)).alias("members"), F.count_distinct("path").alias("files"))
    return groups, bundle_relations(edges, owned.select("id", "owner"))


def external_groups(dependencies: DataFrame, external: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Group of each external target (``dst``): its single source, ``shared`` with several, ``unlinked`` with none.

    Min/max over the sources answers "one or several" in constant state per target.
    """
    per = dependencies.groupBy(*by, "dst").agg(F.min("src").alias("_first"), F.max("src").alias("_last"))
    if external is not None:
        per = lookup_join(external.select(*by, F.col("id").alias("dst")).distinct(), per, [*by, "dst"])
    group = F.when(F.col("_first").isNull(), F.lit("unlinked")).when(F.col("_first") == F.col("_last"), F.col("_first").cast("string")).otherwise(F.lit("shared"))
    return per.select(*by, "dst", group.alias("group"))


def external_layout(dependencies: DataFrame, groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Where each external target is shown: below the group of its sources, or, when at most one source has any, directly
    below the summary of all (``flat``).  Columns: ``dst``, ``group``, ``parent``, ``layout``."""
    sources = dependencies.groupBy(*by).agg((F.min("src") == F.max("src")).alias("_single")) if by else dependencies.agg((F.min("src") == F.max("src")).alias("_single"))
    placed = lookup_join(groups, sources, by) if by else groups.join(F.broadcast(sources))  # one row
    flat = F.coalesce("_single", F.lit(True))
    return placed.select(*by, "dst", "group", F.when(flat, "external").otherwise(F.concat(F.lit("external:source:"), "group")).alias("parent"), F.when(flat, "flat").otherwise("grouped").alias("layout"))


def external_summary(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Targets per group."""
    return groups.groupBy(*by, "group").agg(F.count(F.lit(1)).alias("targets"))


def bundle_external(dependencies: DataFrame, groups: DataFrame, by: Sequence[str] = (), evidence: str | None = None) -> DataFrame:
    """Dependency edges per (source, group): relations, distinct targets and, given ``evidence``, distinct evidence."""
    joined = lookup_join(dependencies, groups, [*by, "dst"], "inner")
    counts = [F.count(F.lit(1)).alias("n"), F.count_distinct("dst").alias("targets")]
    if evidence:
        counts.append(F.count_distinct(evidence).alias("evidence"))
    return joined.groupBy(*by, "src", "group").agg(*counts)


def degrees(edges: DataFrame, by: Sequence[str] = (), unresolved: Column | None = None) -> DataFrame:
    """In- and out-degree per node (and its unresolved outgoing references) in one pass over the edges."""
    lost = F.coalesce(unresolved, F.lit(False)) if unresolved is not None else F.lit(False)
    ends = edges.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"), lost.cast("int").alias("u")),
                F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.lit(0).alias("u")),
            )
        ).alias("end"),
    ).filter(F.col("end.id").isNotNull())
    return ends.groupBy(*by, F.col("end.id").alias("id")).agg(
        F.sum("end.i").alias("in_degree"), F.sum("end.o").alias("out_degree"), F.sum("end.u").alias("unresolved")
    )


def site_counts(edges: DataFrame, evidence: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct evidence and distinct source ranges per edge group; null sites when any evidence has no range.

    ``edges`` carries ``evidence_id`` (one row per edge and evidence); ``evidence`` has ``evidence_id``, ``path``,
    ``start``, ``end``.
    """
    joined = lookup_join(edges, evidence, ["evidence_id"])
    site = F.when(F.col("start").isNotNull(), F.struct("path", "start", "end"))
    return joined.groupBy(*keys).agg(
        F.count_distinct("evidence_id").alias("evidence"),
        F.when(F.min(F.col("start").isNotNull()), F.count_distinct(site)).alias("sites"),
    )


def rollup_confidence(column: str = "confidence") -> Column:
    """Aggregate: all source → source, all observed → observed, any unresolved → unresolved, else inferred."""
    value = F.col(column)
    return (
        F.when(F.min(value == "source"), "source")
        .when(F.min(value == "observed"), "observed")
        .when(F.max(value == "unresolved"), "unresolved")
        .otherwise("inferred")
    )


def relation_summary(edges: DataFrame, keys: Sequence[str], evidence: str | None = None, site: Sequence[str] = ()) -> DataFrame:
    """Records, distinct evidence and sites, and one confidence label per group (``mixed`` when several)."""
    counts = [F.count(F.lit(1)).alias("records")]
    if evidence:
        counts.append(F.count_distinct(evidence).alias("evidence"))
    if site:
        counts.append(F.count_distinct(F.struct(*site)).alias("sites"))
    one = F.when(F.min("confidence") == F.max("confidence"), F.min("confidence")).otherwise(F.lit("mixed"))
    return edges.groupBy(*keys).agg(*counts, one.alias("confidence"))


def partners(edges: DataFrame, nodes: DataFrame, unresolved: DataFrame | None = None, environment: str | None = None) -> DataFrame:
    """Other ends of the relations of each selected node, by partner, direction and kind.

    ``nodes`` (``id``) are the nodes looked at; ``unresolved`` (``id``) marks partners whose target is unknown.
    """
    extra = [environment] if environment else []
    looked = nodes.select("id").distinct()
    out = edges.join(looked.withColumnRenamed("id", "src"), "src", "left_semi")
    self_or_out = F.when(F.col("src") == F.col("dst"), "self").otherwise("outgoing")
    into = edges.join(looked.withColumnRenamed("id", "dst"), "dst", "left_semi").filter(F.col("src") != F.col("dst"))
    both = out.select(F.col("src").alias("id"), F.col("dst").alias("partner"), self_or_out.alias("direction"), "kind", *extra).unionByName(
        into.select(F.col("dst").alias("id"), F.col("src").alias("partner"), F.lit("incoming").alias("direction"), "kind", *extra)
    )
    grouped = both.groupBy("id", "partner", "direction", "kind", *extra).agg(F.count(F.lit(1)).alias("n"))
    if unresolved is None:
        return grouped
    marks = unresolved.select(F.col("id").alias("partner")).distinct().withColumn("_lost", F.lit(True))
    return lookup_join(grouped, marks, ["partner"]).withColumn("known", F.col("_lost").isNull()).drop("_lost")


def dependency_detail(edges: DataFrame, summary: Column) -> DataFrame:
    """Per node: declared relations and summary relations, with distinct targets and sources (two passes of one aggregate)."""
    marked = edges.withColumn("_summary", summary)
    out = marked.groupBy(F.col("src").alias("id")).agg(
        F.count_if(~F.col("_summary")).alias("outgoing_declarations"),
        F.count_if("_summary").alias("outgoing_summaries"),
        F.count_distinct(F.when(~F.col("_summary"), F.col("dst"))).alias("targets"),
    )
    into = marked.groupBy(F.col("dst").alias("id")).agg(
        F.count_if(~F.col("_summary")).alias("incoming_declarations"),
        F.count_distinct(F.when(~F.col("_summary"), F.col("src"))).alias("sources"),
    )
    return out.join(into, "id", "full").fillna(0)


def boundary_stats(edges: DataFrame, memberships: DataFrame) -> DataFrame:
    """Internal, outgoing and incoming edges of each region over its (transitive) members.

    ``memberships`` (``region``, ``id``) may nest; an edge is internal to every region that holds both its ends.  Nodes of the same
    regions are one class, named by a fingerprint of its regions: an edge is counted between two classes, and only the counts meet
    the regions.
    """
    inside = memberships.select("region", "id").distinct()
    classes = inside.groupBy("id").agg(
        F.struct(F.bit_xor(F.xxhash64(F.lit("a"), "region")), F.bit_xor(F.xxhash64(F.lit("b"), "region")), F.count(F.lit(1))).alias("class")
    )
    held = inside.join(classes, "id").select("class", "region").distinct()
    between = edges.select("src", "dst")
    for end in ("src", "dst"):
        between = lookup_join(between, classes.select(F.col("id").alias(end), F.col("class").alias(f"_{end}")), [end])
    counts = between.groupBy("_src", "_dst").agg(F.count(F.lit(1)).alias("_n"))
    side = lambda end, mark: counts.join(held.withColumnRenamed("class", end), end).select("region", F.struct("_src", "_dst").alias("_pair"), "_n", F.lit(mark).alias("_side"))
    # A pair of classes meets a region once from each side that lies in it.
    met = side("_src", 1).unionByName(side("_dst", 2)).groupBy("region", "_pair", "_n").agg(F.sum("_side").alias("_sides"))
    total = lambda sides: F.sum(F.when(F.col("_sides") == sides, F.col("_n")).otherwise(0))
    return met.groupBy("region").agg(total(3).alias("internal"), total(1).alias("outgoing"), total(2).alias("incoming"))


def unresolved_summary(nodes: DataFrame, edges: DataFrame, call_site: Sequence[str]) -> DataFrame:
    """Unresolved call targets: members, relations touching them, distinct call sites (one row)."""
    lost = nodes.filter((F.col("kind") == "external") & (F.col("confidence") == "unresolved")).select("id").distinct()
    touching = edge_direction(edges, lost).filter(F.col("direction").isNotNull())
    site = F.when(F.col("kind") == "calls", F.struct(*call_site))
    stats = touching.agg(F.count(F.lit(1)).alias("relations"), F.count_distinct(site).alias("call_sites"), F.lit(1).alias("_k"))
    members = lost.agg(F.count(F.lit(1)).alias("members"), F.lit(1).alias("_k"))
    return members.join(stats, "_k").drop("_k")


def view_counts(nodes: DataFrame, visible: DataFrame, summary: Column) -> DataFrame:
    """Total, visible and hidden nodes, summaries not counted (one row)."""
    shown = visible.select("id").distinct().withColumn("_shown", F.lit(True))
    real = lookup_join(nodes.filter(~F.coalesce(summary, F.lit(False))), shown, ["id"])
    total, seen = F.count(F.lit(1)), F.count_if(F.coalesce("_shown", F.lit(False)))
    return real.agg(total.alias("total"), seen.alias("visible"), (total - seen).alias("hidden"))


def node_roles(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Role of every node touched by the selection — selected, outgoing, incoming or both — with the number of
    relations and of relation kinds that touch it."""
    directed = edge_direction(edges, selected).filter(F.col("direction").isNotNull())
    leaving, arriving = F.col("direction").isin("outgoing", "internal"), F.col("direction").isin("incoming", "internal")
    ends = directed.select(
        "kind",
        F.explode(
            F.array(
                F.struct(F.col("dst").alias("id"), leaving.alias("reached"), F.lit(False).alias("reaches")),
                F.struct(F.col("src").alias("id"), F.lit(False).alias("reached"), arriving.alias("reaches")),
            )
        ).alias("end"),
    )
    seen = ends.groupBy(F.col("end.id").alias("id")).agg(
        F.max("end.reached").alias("_reached"),
        F.max("end.reaches").alias("_reaches"),
        F.count_distinct("kind").alias("kinds"),
        F.count(F.lit(1)).alias("relations"),
    )
    marks = selected.select("id").distinct().withColumn("_selected", F.lit(True))
    role = (
        F.when(F.col("_selected"), "selected")
        .when(F.col("_reached") & F.col("_reaches"), "both")
        .when(F.col("_reached"), "outgoing")
        .otherwise("incoming")
    )
    joined = seen.join(marks, "id", "full")
    return joined.select("id", role.alias("role"), F.coalesce("kinds", F.lit(0)).alias("kinds"), F.coalesce("relations", F.lit(0)).alias("relations"))


def edge_end_roles(edges: DataFrame, edge_id: str) -> DataFrame:
    """Roles around one selected edge: source and target, or source-target for a self relation."""
    chosen = edges.filter(F.col("id") == edge_id)
    own = F.col("src") == F.col("dst")
    source = chosen.select(F.col("src").alias("id"), F.when(own, "source-target").otherwise("source").alias("role"))
    return source.unionByName(chosen.filter(~own).select(F.col("dst").alias("id"), F.lit("target").alias("role"))).distinct()


def resolve_edges(members: DataFrame, edge_ids: DataFrame) -> DataFrame:
    """Displayed (bundled) edges that carry any of the given original edges; ``members`` is from :func:`bundle_members`."""
    return members.join(edge_ids.select("id").distinct(), "id", "left_semi").groupBy("bundle_id").agg(F.count(F.lit(1)).alias("originals"))


def edges_between(bundles: DataFrame, first: str, second: str) -> DataFrame:
    """Displayed edges joining a pair of displayed nodes, in either direction."""
    forward = (F.col("src_owner") == first) & (F.col("dst_owner") == second)
    backward = (F.col("src_owner") == second) & (F.col("dst_owner") == first)
    return bundles.filter(forward | backward)


def lift_edges(edges: DataFrame, ancestors: DataFrame, visible: DataFrame, keys: Sequence[str] = ("kind",)) -> DataFrame:
    """Move edge ends to their nearest visible ancestor, drop self loops, merge equal edges.

    ``ancestors`` (``id``, ``ancestor``, ``distance``) includes each node itself at distance 0.
    """
    shown = visible.select(F.col("id").alias("ancestor")).distinct()
    nearest = ancestors.join(shown, "ancestor", "left_semi").groupBy("id").agg(F.min_by("ancestor", "distance").alias("owner"))
    owned = _with_owners(edges, nearest).filter(F.col("src_owner") != F.col("dst_owner"))
    return owned.groupBy(F.col("src_owner").alias("src"), F.col("dst_owner").alias("dst"), *keys).agg(F.count(F.lit(1)).alias("n"))


def drop_redundant(edges: DataFrame, expanded: DataFrame) -> DataFrame:
    """Bundle/hidden rule before lifting: a bundle of an opened group gives way to its hidden originals, and hidden
    originals stay out while their group is closed.  ``edges`` carries ``group``, ``bundle`` and ``hidden``."""
    opened = expanded.select(F.col("id").alias("group")).distinct().withColumn("_open", F.lit(True))
    marked = lookup_join(edges, opened, ["group"])
    is_open = F.coalesce("_open", F.lit(False))
    return marked.filter(~(F.col("bundle") & is_open) & ~(F.col("hidden") & ~is_open)).drop("_open")


def request_sources(requests: DataFrame, by: Sequence[str] = ("id",)) -> DataFrame:
    """Per request target: distinct recorded owners, and whether any request has no recorded owner."""
    return requests.groupBy(*by).agg(
        F.count_distinct("owner").alias("owners"), F.max(F.col("owner").isNull()).alias("has_unknown")
    )
