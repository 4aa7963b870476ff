"""Relation bundling, statistics, filters and projections on the supplier → part graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import names as NF
from corpusloom.operators import bundles as B
from corpusloom.operators import filters as FL

from .registry import EDGES, NODES, OWNERS, PAGES, edges, nodes, owners, page_paths, query, s

c = F.col


@query(
    "bundle_relations",
    f"""WITH {EDGES}, {OWNERS} SELECT a.owner AS src_owner, b.owner AS dst_owner, kind, confidence, count(*) AS n,
  a.owner = b.owner AS internal FROM e JOIN o a ON a.id = e.src JOIN o b ON b.id = e.dst GROUP BY ALL""",
)
def bundle_relations(t):
    return B.bundle_relations(edges(t), owners(t)).drop("aggregated")


@query(
    "bundle_passthrough",
    f"""WITH {EDGES}, {OWNERS}, w AS (SELECT id, CASE WHEN owner IN ('n1', 'n2', 'Brand#3') THEN id ELSE owner END AS owner FROM o)
  SELECT a.owner AS src_owner, b.owner AS dst_owner, kind, confidence, 1::BIGINT AS n, FALSE AS aggregated, FALSE AS internal
  FROM e JOIN w a ON a.id = e.src JOIN w b ON b.id = e.dst WHERE a.owner = e.src AND b.owner = e.dst
  UNION ALL SELECT a.owner, b.owner, kind, confidence, count(*), TRUE, a.owner = b.owner
  FROM e JOIN w a ON a.id = e.src JOIN w b ON b.id = e.dst WHERE NOT (a.owner = e.src AND b.owner = e.dst) GROUP BY 1, 2, 3, 4""",
)
def bundle_passthrough(t):
    opened = owners(t).withColumn("owner", F.when(c("owner").isin("n1", "n2", "Brand#3"), c("id")).otherwise(c("owner")))
    return B.bundle_relations(edges(t), opened)


@query(
    "bundle_members",
    f"""WITH {EDGES}, {OWNERS} SELECT 'bundle:' || to_json([a.owner, b.owner, kind, confidence])::VARCHAR AS bundle_id, count(*) AS originals,
  count(DISTINCT e.id) AS ids FROM e JOIN o a ON a.id = e.src JOIN o b ON b.id = e.dst GROUP BY ALL""",
)
def bundle_members(t):
    members = B.bundle_members(edges(t), owners(t))
    return members.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("originals"), F.count_distinct("id").alias("ids"))


@query(
    "bundle_with_environment",
    f"""WITH {EDGES}, {OWNERS} SELECT a.owner AS src_owner, b.owner AS dst_owner, kind, confidence, o_orderpriority AS environment,
  CASE WHEN a.owner <> b.owner THEN 'connection' WHEN e.src <> a.owner OR e.dst <> b.owner THEN 'internal' ELSE 'self' END AS relation,
  count(*) AS n FROM e JOIN orders ON o_orderkey = l_orderkey JOIN o a ON a.id = e.src JOIN o b ON b.id = e.dst GROUP BY ALL""",
)
def bundle_with_environment(t):
    placed = edges(t).join(t.orders.select(c("o_orderkey").alias("l_orderkey"), c("o_orderpriority").alias("environment")), "l_orderkey")
    return B.bundle_arch(placed, owners(t))


_KEY = "\"group\" || ' / ' || split_part(path, '/', 1) || '/' || split_part(path, '/', 2)"


@query(
    "summarize_graph",
    f"""WITH {EDGES}, {NODES}, w AS (SELECT id, CASE WHEN {_KEY} = 'ASIA / ASIA/NATION_2' THEN id ELSE 'overview:' || {_KEY} END AS owner FROM n)
  SELECT a.owner AS src_owner, b.owner AS dst_owner, e.kind, e.confidence, count(*) AS n
  FROM e JOIN w a ON a.id = e.src JOIN w b ON b.id = e.dst GROUP BY ALL""",
)
def summarize_graph(t):
    _, bundled = B.summarize_graph(nodes(t), edges(t), expanded=["ASIA / ASIA/NATION_2"])
    return bundled.select("src_owner", "dst_owner", "kind", "confidence", "n")


@query(
    "summary_groups",
    f"""WITH {NODES}, k AS (SELECT *, {_KEY} AS key FROM n), z AS (SELECT *, count(*) OVER (PARTITION BY key) AS size FROM k)
  SELECT CASE WHEN size >= 20 THEN 'overview:' || key ELSE id END AS owner, count(*) AS members, count(DISTINCT path) AS files
  FROM z GROUP BY 1""",
)
def summary_groups(t):
    groups, _ = B.summarize_graph(nodes(t), edges(t), minimum=20)
    return groups


@query(
    "module_degree",
    f"""WITH {EDGES}, x AS (SELECT src AS id, 0 AS i, 1 AS o, CASE WHEN kind = 'R' THEN 1 ELSE 0 END AS u FROM e UNION ALL SELECT dst, 1, 0, 0 FROM e)
  SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, sum(u)::BIGINT AS unresolved FROM x GROUP BY id""",
)
def module_degree(t):
    return B.degrees(edges(t), unresolved=c("kind") == "R")


@query(
    "site_counts",
    f"""WITH {EDGES} SELECT src, kind, count(DISTINCT l_orderkey) AS evidence,
  CASE WHEN bool_and(o_orderstatus <> 'P') THEN count(DISTINCT (o_custkey, o_orderdate)) END AS sites
  FROM e JOIN orders ON o_orderkey = l_orderkey GROUP BY src, kind""",
)
def site_counts(t):
    evidence = t.orders.select(
        c("o_orderkey").alias("evidence_id"),
        c("o_custkey").alias("path"),
        F.when(c("o_orderstatus") != "P", c("o_orderdate")).alias("start"),
        c("o_orderdate").alias("end"),
    )
    return B.site_counts(edges(t).withColumnRenamed("l_orderkey", "evidence_id"), evidence, ["src", "kind"])


@query(
    "relation_summary",
    f"""WITH {EDGES}, {OWNERS} SELECT a.owner, kind, count(*) AS records, count(DISTINCT l_orderkey) AS evidence,
  count(DISTINCT (l_orderkey, l_linenumber)) AS sites, CASE WHEN min(confidence) = max(confidence) THEN min(confidence) ELSE 'mixed' END AS confidence
  FROM e JOIN o a ON a.id = e.src GROUP BY a.owner, kind""",
)
def relation_summary(t):
    owned = edges(t).join(owners(t).withColumnRenamed("id", "src"), "src")
    return B.relation_summary(owned, ["owner", "kind"], evidence="l_orderkey", site=["l_orderkey", "l_linenumber"])


@query(
    "confidence_rollup",
    f"""WITH {EDGES}, x AS (SELECT dst AS id, CASE WHEN kind = 'A' THEN 'source' WHEN kind = 'N' THEN 'observed' WHEN confidence = 'F' THEN 'unresolved'
  ELSE 'inferred' END AS c FROM e) SELECT id, CASE WHEN bool_and(c = 'source') THEN 'source' WHEN bool_and(c = 'observed') THEN 'observed'
  WHEN bool_or(c = 'unresolved') THEN 'unresolved' ELSE 'inferred' END AS confidence FROM x GROUP BY id""",
)
def confidence_rollup(t):
    level = F.when(c("kind") == "A", "source").when(c("kind") == "N", "observed").when(c("confidence") == "F", "unresolved").otherwise("inferred")
    return edges(t).withColumn("confidence", level).groupBy(c("dst").alias("id")).agg(B.rollup_confidence().alias("confidence"))


_SELECTED = "sel AS (SELECT 's' || s_suppkey AS id FROM supplier WHERE s_nationkey = 3 UNION ALL SELECT 'p' || p_partkey FROM part WHERE p_brand = 'Brand#7')"


def _selected(t):
    return t.supplier.filter("s_nationkey = 3").select(s("s", c("s_suppkey")).alias("id")).unionByName(
        t.part.filter("p_brand = 'Brand#7'").select(s("p", c("p_partkey")).alias("id"))
    )


@query(
    "edge_direction",
    f"""WITH {EDGES}, {_SELECTED} SELECT CASE WHEN a AND b THEN 'internal' WHEN b THEN 'incoming' WHEN a THEN 'outgoing' END AS direction, kind, count(*) AS n
  FROM (SELECT kind, src IN (SELECT id FROM sel) AS a, dst IN (SELECT id FROM sel) AS b FROM e) GROUP BY ALL""",
)
def edge_direction(t):
    return FL.edge_direction(edges(t), _selected(t)).groupBy("direction", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "visible_by_direction",
    f"""WITH {EDGES}, {_SELECTED} SELECT src, count(*) AS n FROM e
  WHERE NOT (src NOT IN (SELECT id FROM sel) AND dst IN (SELECT id FROM sel)) GROUP BY src""",
)
def visible_by_direction(t):
    return FL.visible_by_direction(edges(t), _selected(t), "outgoing").groupBy("src").agg(F.count(F.lit(1)).alias("n"))


@query(
    "node_roles",
    f"""WITH {EDGES}, {_SELECTED}, d AS (SELECT * FROM (SELECT *, src IN (SELECT id FROM sel) AS a, dst IN (SELECT id FROM sel) AS b FROM e) WHERE a OR b),
  x AS (SELECT dst AS id, a AS reached, FALSE AS reaches, kind FROM d UNION ALL SELECT src, FALSE, b, kind FROM d),
  g AS (SELECT id, bool_or(reached) AS r1, bool_or(reaches) AS r2, count(DISTINCT kind) AS kinds, count(*) AS relations FROM x GROUP BY id)
  SELECT coalesce(g.id, sel.id) AS id, CASE WHEN sel.id IS NOT NULL THEN 'selected' WHEN r1 AND r2 THEN 'both' WHEN r1 THEN 'outgoing' ELSE 'incoming' END AS role,
  coalesce(kinds, 0) AS kinds, coalesce(relations, 0) AS relations FROM g FULL JOIN sel ON g.id = sel.id""",
)
def node_roles(t):
    return B.node_roles(edges(t), _selected(t))


_MEMBERS = """m AS (SELECT 'n' || s_nationkey AS region, 's' || s_suppkey AS id FROM supplier
  UNION ALL SELECT 'r' || n_regionkey, 's' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'world', 's' || s_suppkey FROM supplier UNION ALL SELECT p_brand, 'p' || p_partkey FROM part
  UNION ALL SELECT 'world', 'p' || p_partkey FROM part)"""


def _memberships(t):
    placed = t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey"))
    supplier = s("s", c("s_suppkey"))
    nested = placed.select(
        F.explode(F.array(s("n", c("s_nationkey")), s("r", c("n_regionkey")), F.lit("world"))).alias("region"), supplier.alias("id")
    )
    part = s("p", c("p_partkey")).alias("id")
    return nested.unionByName(t.part.select(c("p_brand").alias("region"), part)).unionByName(
        t.part.select(F.lit("world").alias("region"), part)
    )


@query(
    "boundary_stats",
    f"""WITH {EDGES}, {_MEMBERS}, ee AS (SELECT row_number() OVER () AS n, src, dst FROM e), x AS (SELECT n, region, TRUE AS a, FALSE AS b FROM ee JOIN m ON m.id = src
  UNION ALL SELECT n, region, FALSE, TRUE FROM ee JOIN m ON m.id = dst),
  y AS (SELECT n, region, bool_or(a) AS a, bool_or(b) AS b FROM x GROUP BY n, region)
  SELECT region, count(*) FILTER (a AND b) AS internal, count(*) FILTER (a AND NOT b) AS outgoing, count(*) FILTER (b AND NOT a) AS incoming
  FROM y GROUP BY region""",
)
def boundary_stats(t):
    return B.boundary_stats(edges(t), _memberships(t))


@query(
    "partner_summary",
    f"""WITH {EDGES}, {_SELECTED}, {NODES}, x AS (SELECT src AS id, dst AS partner, 'outgoing' AS direction, kind FROM e WHERE src IN (SELECT id FROM sel)
  UNION ALL SELECT dst, src, 'incoming', kind FROM e WHERE dst IN (SELECT id FROM sel))
  SELECT x.id, partner, direction, x.kind, count(*) AS n, partner NOT IN (SELECT id FROM n WHERE confidence = 'unresolved') AS known
  FROM x GROUP BY x.id, partner, direction, x.kind""",
)
def partner_summary(t):
    return B.partners(edges(t), _selected(t), unresolved=nodes(t).filter("confidence = 'unresolved'"))


@query(
    "dependency_detail",
    f"""WITH {EDGES}, a AS (SELECT src AS id, count(*) FILTER (kind <> 'N') AS outgoing_declarations, count(*) FILTER (kind = 'N') AS outgoing_summaries,
  count(DISTINCT CASE WHEN kind <> 'N' THEN dst END) AS targets FROM e GROUP BY src),
  b AS (SELECT dst AS id, count(*) FILTER (kind <> 'N') AS incoming_declarations, count(DISTINCT CASE WHEN kind <> 'N' THEN src END) AS sources FROM e GROUP BY dst)
  SELECT coalesce(a.id, b.id) AS id, coalesce(outgoing_declarations, 0) AS outgoing_declarations, coalesce(outgoing_summaries, 0) AS outgoing_summaries,
  coalesce(targets, 0) AS targets, coalesce(incoming_declarations, 0) AS incoming_declarations, coalesce(sources, 0) AS sources
  FROM a FULL JOIN b ON a.id = b.id""",
)
def dependency_detail(t):
    return B.dependency_detail(edges(t), c("kind") == "N")


_DEPENDS = """d AS (SELECT 'n' || c_nationkey AS src, p_name AS dst, l_orderkey AS evidence FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey)"""


_GROUPS = """g AS (SELECT id AS dst, CASE WHEN lo IS NULL THEN 'unlinked' WHEN lo = hi THEN lo ELSE 'shared' END AS "group" FROM
  (SELECT DISTINCT p_partkey || ':' || k AS id FROM part, range(10) r(k)) LEFT JOIN
  (SELECT dst, min(src) AS lo, max(src) AS hi FROM d GROUP BY dst) ON dst = id)"""
_DEPENDS_PART = _DEPENDS.replace("p_name AS dst", "p_partkey || ':' || (l_suppkey % 10) AS dst")


def _depends_part(t):
    lines = t.lineitem.join(t.orders, c("o_orderkey") == c("l_orderkey"))
    placed = lines.join(t.customer, c("c_custkey") == c("o_custkey")).join(t.part, c("p_partkey") == c("l_partkey"))
    return placed.select(s("n", c("c_nationkey")).alias("src"), s(c("p_partkey"), ":", c("l_suppkey") % 10).alias("dst"), c("l_orderkey").alias("evidence"))


def _part_groups(t, dependencies):
    every = t.part.select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"))
    return B.external_groups(dependencies, every.select(s(c("p_partkey"), ":", c("k")).alias("id")).distinct())


@query("external_groups", f'WITH {_DEPENDS_PART}, {_GROUPS} SELECT "group", count(*) AS targets FROM g GROUP BY 1')
def external_groups(t):
    return B.external_summary(_part_groups(t, _depends_part(t)))


@query(
    "bundle_external",
    f"""WITH {_DEPENDS_PART}, {_GROUPS} SELECT src, "group", count(*) AS n, count(DISTINCT d.dst) AS targets, count(DISTINCT evidence) AS evidence
  FROM d JOIN g ON g.dst = d.dst GROUP BY 1, 2""",
)
def bundle_external(t):
    dependencies = _depends_part(t)
    return B.bundle_external(dependencies, _part_groups(t, dependencies), evidence="evidence")


@query(
    "unresolved_summary",
    f"""WITH {EDGES}, {NODES}, u AS (SELECT id FROM n WHERE kind = 'external' AND confidence = 'unresolved')
  SELECT (SELECT count(*) FROM u) AS members, count(*) AS relations, count(DISTINCT CASE WHEN kind = 'A' THEN l_orderkey END) AS call_sites
  FROM e WHERE dst IN (SELECT id FROM u) OR src IN (SELECT id FROM u)""",
)
def unresolved_summary(t):
    renamed = edges(t).withColumn("kind", F.when(c("kind") == "A", "calls").otherwise(c("kind")))
    return B.unresolved_summary(nodes(t), renamed, ["l_orderkey"])


@query(
    "view_counts",
    f"""WITH {NODES} SELECT count(*) AS total, count(*) FILTER (confidence = 'source') AS visible, count(*) FILTER (confidence <> 'source') AS hidden
  FROM n WHERE kind <> 'external'""",
)
def view_counts(t):
    everything = nodes(t)
    return B.view_counts(everything, everything.filter("confidence = 'source'"), c("kind") == "external")


_LIFT = """anc AS (SELECT 's' || s_suppkey AS id, 's' || s_suppkey AS ancestor, 0 AS distance FROM supplier
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 1 FROM supplier
  UNION ALL SELECT 's' || s_suppkey, 'r' || n_regionkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'p' || p_partkey, 'p' || p_partkey, 0 FROM part UNION ALL SELECT 'p' || p_partkey, p_brand, 1 FROM part),
  vis AS (SELECT 'r' || r_regionkey AS id FROM region UNION ALL SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey = 1
  UNION ALL SELECT DISTINCT p_brand FROM part),
  own AS (SELECT anc.id, arg_min(ancestor, distance) AS owner FROM anc JOIN vis ON vis.id = anc.ancestor GROUP BY anc.id)"""


def _lift_tables(t):
    placed = t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey"))
    me = s("s", c("s_suppkey"))
    chain = F.array(
        F.struct(me.alias("ancestor"), F.lit(0).alias("distance")),
        F.struct(s("n", c("s_nationkey")).alias("ancestor"), F.lit(1).alias("distance")),
        F.struct(s("r", c("n_regionkey")).alias("ancestor"), F.lit(2).alias("distance")),
    )
    part = s("p", c("p_partkey"))
    part_chain = F.array(F.struct(part.alias("ancestor"), F.lit(0).alias("distance")), F.struct(c("p_brand").alias("ancestor"), F.lit(1).alias("distance")))
    ancestors = placed.select(me.alias("id"), F.inline(chain)).unionByName(t.part.select(part.alias("id"), F.inline(part_chain)))
    visible = (
        t.region.select(s("r", c("r_regionkey")).alias("id"))
        .unionByName(t.nation.filter("n_regionkey = 1").select(s("n", c("n_nationkey")).alias("id")))
        .unionByName(t.part.select(c("p_brand").alias("id")).distinct())
    )
    return ancestors, visible


@query(
    "lift_edges",
    f"""WITH {EDGES}, {_LIFT} SELECT a.owner AS src, b.owner AS dst, kind, count(*) AS n FROM e JOIN own a ON a.id = e.src JOIN own b ON b.id = e.dst
  WHERE a.owner <> b.owner GROUP BY ALL""",
)
def lift_edges(t):
    ancestors, visible = _lift_tables(t)
    return B.lift_edges(edges(t), ancestors, visible)


@query(
    "drop_redundant",
    f"""WITH {EDGES}, x AS (SELECT *, 'n' || (l_orderkey % 20) AS "group", kind = 'A' AS bundle, kind = 'R' AS hidden FROM e)
  SELECT "group", kind, count(*) AS n FROM x WHERE NOT (bundle AND "group" IN ('n1', 'n4')) AND NOT (hidden AND "group" NOT IN ('n1', 'n4')) GROUP BY ALL""",
)
def drop_redundant(t):
    marked = edges(t).withColumn("group", s("n", c("l_orderkey") % 20)).withColumn("bundle", c("kind") == "A").withColumn("hidden", c("kind") == "R")
    opened = t.nation.select(s("n", c("n_nationkey")).alias("id")).filter("id in ('n1', 'n4')")
    return B.drop_redundant(marked, opened).groupBy("group", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "resolve_edges",
    f"""WITH {EDGES}, {OWNERS} SELECT 'bundle:' || to_json([a.owner, b.owner, kind, confidence])::VARCHAR AS bundle_id, count(*) AS originals
  FROM e JOIN o a ON a.id = e.src JOIN o b ON b.id = e.dst GROUP BY ALL""",
)
def resolve_edges(t):
    all_edges = edges(t)
    return B.resolve_edges(B.bundle_members(all_edges, owners(t)), all_edges)


@query(
    "edges_between",
    f"""WITH {EDGES}, {OWNERS} SELECT a.owner AS src_owner, b.owner AS dst_owner, kind, count(*) AS n FROM e JOIN o a ON a.id = e.src
  JOIN o b ON b.id = e.dst WHERE (a.owner = 'n3' AND b.owner = 'Brand#7') OR (a.owner = 'Brand#7' AND b.owner = 'n3') GROUP BY ALL""",
)
def edges_between(t):
    return B.edges_between(B.bundle_relations(edges(t), owners(t), keys=["kind"]), "n3", "Brand#7").select("src_owner", "dst_owner", "kind", "n")


@query(
    "request_sources",
    """SELECT l_partkey AS id, count(DISTINCT CASE WHEN l_quantity > 5 THEN l_suppkey END) AS owners, bool_or(l_quantity <= 5) AS has_unknown
  FROM lineitem GROUP BY l_partkey""",
)
def request_sources(t):
    asked = t.lineitem.select(c("l_partkey").alias("id"), F.when(c("l_quantity") > 5, c("l_suppkey")).alias("owner"))
    return B.request_sources(asked)


@query(
    "edges_for_view",
    f"""WITH {EDGES}, {NODES}, k AS (SELECT id FROM n WHERE confidence = 'source') SELECT src, dst, 'uses-' || kind AS kind, count(*) AS n FROM e
  WHERE l_quantity > 25 AND src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k) GROUP BY ALL""",
)
def edges_for_view(t):
    kept = FL.edges_for(nodes(t).filter("confidence = 'source'"), edges(t), c("l_quantity") > 25, lambda kind: F.concat(F.lit("uses-"), kind))
    return kept.groupBy("src", "dst", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "semantic_filter",
    f"""WITH {EDGES}, {NODES}, k AS (SELECT id FROM n WHERE ("group" = 'ASIA' OR path = 'ASIA' OR starts_with(path, 'ASIA/') OR kind = 'model')
  AND confidence IN ('source', 'inferred')) SELECT src, e.kind, count(*) AS n FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k) GROUP BY ALL""",
)
def semantic_filter(t):
    everything = nodes(t)
    placed, _ = FL.semantic_filter(everything, edges(t), scope="ASIA", confidences=["source", "inferred"])
    models, _ = FL.semantic_filter(everything, edges(t), kinds=["model"], confidences=["source", "inferred"], hide_auxiliary=True)
    return FL.with_both_ends(edges(t), placed.unionByName(models)).groupBy("src", "kind").agg(F.count(F.lit(1)).alias("n"))


def _views(frame):
    return frame.withColumn("views", F.when(c("kind") == "A", F.array(F.lit("data-model"), F.lit("runtime-flow"))).otherwise(F.array(F.lit("runtime-flow"))))


@query(
    "project_view",
    f"""WITH {EDGES}, {NODES}, x AS (SELECT * FROM e WHERE kind = 'A'), u AS (SELECT src AS id FROM x UNION SELECT dst FROM x)
  SELECT kind, confidence, count(*) AS n FROM n WHERE id IN (SELECT id FROM u) OR (kind = 'model' AND confidence <> 'unresolved' AND label NOT LIKE 'red%') GROUP BY ALL""",
)
def project_view(t):
    shown, _ = FL.project_view(nodes(t), _views(edges(t)), "data-model", excluded=c("label").startswith("red"))
    return shown.groupBy("kind", "confidence").agg(F.count(F.lit(1)).alias("n"))


@query(
    "apply_layer",
    f"""WITH {EDGES}, {NODES}, src AS (SELECT id FROM n WHERE confidence = 'source'),
  se AS (SELECT id, src, dst, 'source' AS layer FROM e WHERE l_quantity < 25), oe AS (SELECT id, src, dst, 'observed' AS layer FROM e WHERE l_quantity >= 25 AND kind <> 'R'),
  ids AS (SELECT id FROM src UNION SELECT id FROM n WHERE confidence <> 'source' AND kind <> 'value')
  SELECT layer, count(*) AS n FROM (SELECT * FROM se UNION ALL SELECT * FROM oe)
  WHERE src IN (SELECT id FROM ids) AND dst IN (SELECT id FROM ids) GROUP BY layer""",
)
def apply_layer(t):
    everything = _views(edges(t))
    known = nodes(t)
    source = (known.filter("confidence = 'source'"), everything.filter("l_quantity < 25").withColumn("layer", F.lit("source")))
    seen_edges = everything.filter("l_quantity >= 25 and kind <> 'R'").withColumn("layer", F.lit("observed"))
    seen = (known.filter("confidence <> 'source'"), seen_edges.withColumn("kind", F.lit("observed-child")))
    _, layered = FL.apply_layer(source, seen, "combined", "runtime-flow")
    return layered.groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


@query(
    "filter_with_context",
    f"""WITH {EDGES}, {NODES}, near AS (SELECT src AS id FROM e WHERE src = 's7' OR dst = 's7' UNION SELECT dst FROM e WHERE src = 's7' OR dst = 's7')
  SELECT kind, count(*) AS n FROM n WHERE kind = 'external' OR id IN (SELECT id FROM near) OR id = 's7' GROUP BY kind""",
)
def filter_with_context(t):
    typed = nodes(t).withColumn("type", c("kind"))
    return FL.filter_with_context(typed, edges(t), "external", selected="s7").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "foreground_edges",
    f"""WITH {EDGES} SELECT src, dst, layer, count(*) AS n FROM (SELECT *, 0 AS layer FROM e WHERE src = 's7' OR dst IN ('p5')) GROUP BY ALL""",
)
def foreground_edges(t):
    return FL.foreground_edges(edges(t), node="s7", region="p5").groupBy("src", "dst", "layer").agg(F.count(F.lit(1)).alias("n"))


@query(
    "selection_context",
    f"""WITH {EDGES}, {_MEMBERS}, ids AS (SELECT 'n3' AS id UNION SELECT id FROM m WHERE region = 'n3' UNION SELECT 'r' || n_regionkey FROM nation WHERE n_nationkey = 3)
  SELECT direction, kind, count(*) AS n FROM (SELECT kind, CASE WHEN src IN (SELECT id FROM ids) AND dst IN (SELECT id FROM ids) THEN 'internal'
  WHEN dst IN (SELECT id FROM ids) THEN 'incoming' WHEN src IN (SELECT id FROM ids) THEN 'outgoing' END AS direction FROM e) WHERE direction IS NOT NULL GROUP BY ALL""",
)
def selection_context(t):
    memberships = _memberships(t).withColumnRenamed("region", "region_id")
    parents = t.nation.select(s("n", c("n_nationkey")).alias("id"), s("r", c("n_regionkey")).alias("ancestor"))
    _, related = FL.selection_context(edges(t), region="n3", memberships=memberships, region_parents=parents)
    return related.groupBy("direction", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "glob_match",
    rf"""WITH {PAGES}, x AS (SELECT page_id, regexp_replace(path, '^[^/]+/', '') AS path FROM pg)
  SELECT page_id FROM x WHERE regexp_full_match(path, '(en/[^/]*)|(de/.*)') AND NOT regexp_full_match(path, 'en/6[^/]*')""",
)
def glob_match(t):
    local = page_paths(t).withColumn("path", F.regexp_replace("path", "^[^/]+/", ""))
    return local.filter(FL.glob_match(c("path"), ["en/*", "de/**", "!en/6*"])).select("page_id")


@query(
    "glob_join",
    rf"""WITH {PAGES}, x AS (SELECT page_id, regexp_replace(path, '^[^/]+/', '') AS path FROM pg)
  SELECT page_id, path FROM x WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey < 10 AND
  regexp_full_match(path, (CASE WHEN n_nationkey % 2 = 0 THEN 'en' ELSE 'fr' END) || '/' || n_nationkey || '[^/]*'))
  AND NOT regexp_full_match(path, 'en/4[^/]')""",
)
def glob_join(t):
    local = page_paths(t).select("page_id", F.regexp_replace("path", "^[^/]+/", "").alias("path"))
    head = F.when(c("n_nationkey") % 2 == 0, "en").otherwise("fr")
    patterns = t.nation.filter("n_nationkey < 10").select(F.concat(head, F.lit("/"), c("n_nationkey").cast("string"), F.lit("*")).alias("pattern"))
    patterns = patterns.unionByName(t.region.filter("r_regionkey = 0").select(F.lit("!en/4?").alias("pattern")))
    return FL.glob_join(local, patterns)


@query(
    "route_match",
    """SELECT page_id FROM pages WHERE regexp_full_match(regexp_extract(url, '^[^?#]*'), 'https://.*/en/.*')
  AND NOT regexp_full_match(regexp_extract(url, '^[^?#]*'), '.*\\.html')""".replace("\\\\", "\\"),
)
def route_match(t):
    return t.pages.filter(FL.route_match(c("url"), ["https://*/en/*", "!*.html"])).select("page_id")


@query(
    "classify_auxiliary",
    r"""SELECT regexp_matches(p, '(?i)(?:^|/)(?:__tests__|__mocks__|__fixtures__|tests?|specs?|mocks?|fixtures?|samples?|examples?|generated)(?:/|\.)|\.(?:test|spec|mock|fixture|generated|g)\.|\.Tests(?:/|\.)') AS auxiliary,
  regexp_matches(p, '(?i)(?:^|/)generated/') OR regexp_matches(text[:600], '(?i)\b(?:auto.generated|generated by|code generated|do not edit)\b') AS "generated", count(*) AS n
  FROM (SELECT text, source || CASE WHEN doc_id % 7 = 0 THEN '/tests/' WHEN doc_id % 11 = 0 THEN '/generated/' ELSE '/src/' END || doc_id || '.md' AS p FROM documents) GROUP BY ALL""",
)
def classify_auxiliary(t):
    folder = F.when(c("doc_id") % 7 == 0, "/tests/").when(c("doc_id") % 11 == 0, "/generated/").otherwise("/src/")
    files = t.documents.select("text", F.concat("source", folder, c("doc_id").cast("string"), F.lit(".md")).alias("path"))
    return FL.classify_auxiliary(files).groupBy("auxiliary", "generated").agg(F.count(F.lit(1)).alias("n"))


@query(
    "external_layout",
    """WITH d AS (SELECT l_orderkey AS project, l_suppkey AS src, l_partkey AS dst FROM lineitem), g AS (SELECT project, dst, CASE WHEN min(src) = max(src) THEN min(src)::VARCHAR ELSE 'shared' END AS "group" FROM d GROUP BY ALL),
  n AS (SELECT project, min(src) = max(src) AS flat FROM d GROUP BY project)
  SELECT project, dst, "group", CASE WHEN flat THEN 'external' ELSE 'external:source:' || "group" END AS parent, CASE WHEN flat THEN 'flat' ELSE 'grouped' END AS layout FROM g JOIN n USING (project)""",
)
def external_layout(t):
    """Orders are projects, suppliers their sources and parts the external targets: a project with one source is shown flat."""
    dependencies = t.lineitem.select(c("l_orderkey").alias("project"), c("l_suppkey").alias("src"), c("l_partkey").alias("dst"))
    return B.external_layout(dependencies, B.external_groups(dependencies, by=["project"]), ["project"])


@query(
    "display_labels",
    f"""WITH {NODES} SELECT CASE kind WHEN 'function' THEN 'Function' WHEN 'external' THEN 'External call' WHEN 'model' THEN 'Model / Schema' END AS kind_label,
  CASE confidence WHEN 'source' THEN 'ソースで確認' WHEN 'inferred' THEN '推定' WHEN 'unresolved' THEN '未解決' END AS confidence_label,
  CASE length("group") % 3 WHEN 0 THEN '利用中' WHEN 1 THEN 'レガシー' END AS status_label, count(*) AS n FROM n GROUP BY ALL""",
)
def display_labels(t):
    status = F.when(F.length("group") % 3 == 0, "active").when(F.length("group") % 3 == 1, "legacy")
    labels = [NF.kind_label("kind").alias("kind_label"), NF.confidence_label("confidence").alias("confidence_label"), NF.status_label(status).alias("status_label")]
    return nodes(t).groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))


@query(
    "relation_readings",
    """WITH e AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, CASE l_returnflag WHEN 'R' THEN 'depends-on' WHEN 'A' THEN 'imports' ELSE 'runs-in' END AS kind FROM lineitem)
  SELECT node, label, count(*) AS n FROM (SELECT src AS node, kind AS label FROM e UNION ALL SELECT dst, CASE kind WHEN 'depends-on' THEN 'used-by' WHEN 'imports' THEN 'imported-by' ELSE 'hosts' END FROM e) GROUP BY ALL""",
)
def relation_readings(t):
    """Every relation as read from both of its ends."""
    kind = F.when(c("l_returnflag") == "R", "depends-on").when(c("l_returnflag") == "A", "imports").otherwise("runs-in")
    e = t.lineitem.select(s("s", c("l_suppkey")).alias("src"), s("p", c("l_partkey")).alias("dst"), kind.alias("kind"))
    read = e.withColumn("node", F.explode(F.array("src", "dst")))
    return read.groupBy("node", NF.relation_label_for(c("node"), c("src"), c("dst"), c("kind"), c("kind")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
