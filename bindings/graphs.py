"""Traversal, trees and components on part graphs and geographic trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import compress as C
from corpusloom.operators import owners as O
from corpusloom.operators import scc as K
from corpusloom.operators import traverse as T
from corpusloom.operators import tree as R
from corpusloom.plans import cut_lineage

from .registry import PAGES, edges, page_paths, query, s

c = F.col


def followers(t):
    """Each part leads to every part that follows it on some order."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", c("l_partkey").alias("src"))
    after = t.lineitem.select("l_orderkey", (c("l_linenumber") - 1).alias("l_linenumber"), c("l_partkey").alias("dst"))
    pairs = lines.join(after, ["l_orderkey", "l_linenumber"]).filter("src <> dst").select("src", "dst").distinct()
    return pairs.withColumn("id", s(c("src"), "-", c("dst")))


G = """g AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey
    AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey)"""
SEED = "(SELECT min(src) FROM g)"


def graph(t):
    """All edges, written once for the steps that read them, their nodes, and the node that the searches begin at."""
    whole = cut_lineage(followers(t))
    return whole, whole.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), whole.agg(F.min("src").alias("id"))


def bfs_sql(name: str, step: str, limit: int = 40) -> str:
    """Shortest distances by a recursive query that keeps distinct (id, depth) pairs up to a depth no path exceeds here."""
    return f"""{name}_r(id, depth) AS (SELECT {SEED}, 0 UNION SELECT {step}, depth + 1 FROM {name}_r JOIN gg ON gg.a = {name}_r.id WHERE depth < {limit}),
  {name} AS (SELECT id, min(depth) AS depth FROM {name}_r GROUP BY id)"""


BOTH = "gg AS (SELECT src AS a, dst AS b FROM g UNION SELECT dst, src FROM g)"


@query("bfs_depths", f"WITH RECURSIVE {G}, {BOTH}, {bfs_sql('d', 'gg.b', 25)} SELECT id, depth FROM d")
def bfs_depths(t):
    whole, nodes, start = graph(t)
    return T.bfs_depths(nodes, whole, start)


@query("khop_nodes", f"WITH RECURSIVE {G}, gg AS (SELECT src AS a, dst AS b FROM g), {bfs_sql('d', 'gg.b', 3)} SELECT id, depth FROM d")
def khop_nodes(t):
    whole, _, start = graph(t)
    return T.neighbours(whole, start, 3, "outgoing")


@query(
    "khop_relations",
    f"""WITH RECURSIVE {G}, {BOTH}, {bfs_sql('d', 'gg.b', 2)} SELECT DISTINCT src, dst FROM g
  WHERE src IN (SELECT id FROM d WHERE depth < 2) OR dst IN (SELECT id FROM d WHERE depth < 2)""",
)
def khop_relations(t):
    whole, _, start = graph(t)
    return T.khop_relations(whole, start, 2, "both").select("src", "dst")


@query(
    "signed_hops",
    f"""WITH RECURSIVE {G}, fo(id, depth) AS (SELECT {SEED}, 0 UNION SELECT g.dst, depth + 1 FROM fo JOIN g ON g.src = fo.id WHERE depth < 40),
  ba(id, depth) AS (SELECT {SEED}, 0 UNION SELECT g.src, depth + 1 FROM ba JOIN g ON g.dst = ba.id WHERE depth < 40),
  f AS (SELECT id, min(depth) AS o FROM fo GROUP BY id), b AS (SELECT id, min(depth) AS i FROM ba GROUP BY id)
  SELECT coalesce(f.id, b.id) AS id, CASE WHEN i IS NOT NULL AND (o IS NULL OR i <= o) THEN -i ELSE o END AS hop FROM f FULL JOIN b ON f.id = b.id""",
)
def signed_hops(t):
    whole, _, start = graph(t)
    return T.signed_hops(whole, start)


HUB = "(SELECT arg_max(id, (n, -id)) FROM (SELECT id, count(*) AS n FROM (SELECT src AS id FROM g UNION ALL SELECT dst FROM g) GROUP BY id))"


@query(
    "edge_emphasis",
    f"""WITH RECURSIVE {G}, {BOTH}, r(id, depth) AS (SELECT {HUB}, 0 UNION SELECT gg.b, depth + 1 FROM r JOIN gg ON gg.a = r.id WHERE depth < 25),
  d AS (SELECT id, min(depth) AS depth FROM r GROUP BY id)
  SELECT src, dst, CASE WHEN greatest(x.depth, y.depth) <= 1 THEN 'primary' WHEN greatest(x.depth, y.depth) = 2 THEN 'secondary' WHEN x.depth IS NOT NULL AND y.depth IS NOT NULL THEN 'deep' END AS emphasis
  FROM g LEFT JOIN d x ON x.id = src LEFT JOIN d y ON y.id = dst""",
)
def edge_emphasis(t):
    whole, nodes, _ = graph(t)
    ends = whole.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    hub = ends.agg(F.max_by("id", F.struct("n", -c("id"))).alias("id"))
    return T.edge_emphasis(nodes, whole, hub).select("src", "dst", "emphasis")


REACH = """r AS (SELECT DISTINCT src AS a, dst AS b FROM g UNION SELECT r.a, g.dst FROM r JOIN g ON g.src = r.b)"""


@query(
    "scc_components",
    f"""WITH RECURSIVE {G}, n AS (SELECT src AS id FROM g UNION SELECT dst FROM g), {REACH},
  m AS (SELECT x.a AS id, max(x.b) AS component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY x.a)
  SELECT n.id, coalesce(component, n.id) AS component FROM n LEFT JOIN m ON m.id = n.id""",
)
def scc_components(t):
    whole, nodes, _ = graph(t)
    return K.strong_components(nodes, whole)


@query(
    "scc_depths",
    f"""WITH RECURSIVE {G}, n AS (SELECT src AS id FROM g UNION SELECT dst FROM g), {REACH},
  m AS (SELECT x.a AS id, max(x.b) AS component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY x.a), co AS (SELECT n.id, coalesce(component, n.id) AS component FROM n LEFT JOIN m ON m.id = n.id),
  ce AS (SELECT DISTINCT a.component AS src, b.component AS dst FROM g JOIN co a ON a.id = g.src JOIN co b ON b.id = g.dst WHERE a.component <> b.component),
  dp(id, depth) AS (SELECT DISTINCT component, 0 FROM co UNION SELECT ce.dst, depth + 1 FROM dp JOIN ce ON ce.src = dp.id), dd AS (SELECT id, max(depth) AS depth FROM dp GROUP BY id)
  SELECT co.id, component, depth FROM co JOIN dd ON dd.id = co.component""",
)
def scc_depths(t):
    whole, nodes, _ = graph(t)
    return K.scc_depths(nodes, whole)


@query(
    "longest_depths",
    """WITH RECURSIVE u AS (SELECT least(l_partkey, l_suppkey * 20) AS src, greatest(l_partkey, l_suppkey * 20) AS dst FROM lineitem WHERE l_partkey <> l_suppkey * 20),
  g AS (SELECT DISTINCT src, dst FROM u), r(id, depth) AS (SELECT src, 0 FROM g UNION SELECT dst, depth + 1 FROM r JOIN g ON g.src = r.id)
  SELECT id, max(depth) AS depth FROM r GROUP BY id""",
)
def longest_depths(t):
    scaled = c("l_suppkey") * 20
    upward = t.lineitem.filter(c("l_partkey") != scaled).select(F.least("l_partkey", scaled).alias("src"), F.greatest("l_partkey", scaled).alias("dst"))
    return K.longest_depths(upward.distinct())


def _typed(t, relations):
    kinds = t.part.select(c("p_partkey").alias("src"), F.when(c("p_size") % 7 == 0, "callback").otherwise("calls").alias("kind"), F.when(c("p_size") % 11 == 0, "inferred").otherwise("source").alias("confidence"))
    return relations.join(kinds, "src")


def _typed_graph(t):
    return cut_lineage(_typed(t, followers(t)))


def _kept(t):
    return t.part.filter("p_brand = 'Brand#3'").select(c("p_partkey").alias("id"))


@query(
    "compress_paths",
    f"""WITH RECURSIVE {G}, k AS (SELECT p_partkey AS id FROM part WHERE p_brand = 'Brand#3'),
  f AS (SELECT id FROM k UNION SELECT g.dst FROM f JOIN g ON g.src = f.id), b AS (SELECT id FROM k UNION SELECT g.src FROM b JOIN g ON g.dst = b.id), rel AS (SELECT id FROM f INTERSECT SELECT id FROM b),
  e AS (SELECT src, dst, CASE WHEN p_size % 7 = 0 THEN 'callback' ELSE 'calls' END AS kind, p_size % 11 = 0 AS weak FROM g JOIN part ON p_partkey = src WHERE src IN (SELECT id FROM rel) AND dst IN (SELECT id FROM rel)),
  st AS (SELECT id FROM k UNION SELECT src FROM e GROUP BY src HAVING count(*) > 1 UNION SELECT dst FROM e GROUP BY dst HAVING count(*) > 1),
  w(src, spot, hops, kind, cb, weak) AS (SELECT src, dst, 1::BIGINT, kind, kind = 'callback', weak FROM e WHERE src IN (SELECT id FROM st)
    UNION ALL SELECT w.src, e.dst, hops + 1, 'processing-path', cb OR e.kind = 'callback', w.weak OR e.weak FROM w JOIN e ON e.src = w.spot WHERE w.spot NOT IN (SELECT id FROM st))
  SELECT src, spot AS dst, hops, kind, CASE WHEN weak THEN 'inferred' ELSE 'source' END AS confidence, cb AS has_callback FROM w WHERE spot IN (SELECT id FROM st)""",
)
def compress_paths(t):
    _, relations, _ = C.compress_paths(_typed_graph(t), _kept(t))
    return relations.select("src", "dst", "hops", "kind", "confidence", "has_callback")


@query(
    "path_junctions",
    f"""WITH RECURSIVE {G}, k AS (SELECT p_partkey AS id FROM part WHERE p_brand = 'Brand#3'),
  f AS (SELECT id FROM k UNION SELECT g.dst FROM f JOIN g ON g.src = f.id), b AS (SELECT id FROM k UNION SELECT g.src FROM b JOIN g ON g.dst = b.id),
  rel AS (SELECT id FROM f INTERSECT SELECT id FROM b), e AS (SELECT * FROM g WHERE src IN (SELECT id FROM rel) AND dst IN (SELECT id FROM rel)),
  x AS (SELECT id, (SELECT count(*) FROM e WHERE dst = id) AS i, (SELECT count(*) FROM e WHERE src = id) AS o FROM rel WHERE id NOT IN (SELECT id FROM k))
  SELECT id, CASE WHEN i > 1 AND o > 1 THEN 'branch and merge' WHEN i > 1 THEN 'merge' ELSE 'branch' END AS junction FROM x WHERE i > 1 OR o > 1""",
)
def path_junctions(t):
    junctions, _, _ = C.compress_paths(_typed_graph(t), _kept(t))
    return junctions.select("id", "junction")


@query(
    "path_provenance",
    f"""WITH RECURSIVE {G}, k AS (SELECT p_partkey AS id FROM part WHERE p_brand = 'Brand#3'),
  f AS (SELECT id FROM k UNION SELECT g.dst FROM f JOIN g ON g.src = f.id), b AS (SELECT id FROM k UNION SELECT g.src FROM b JOIN g ON g.dst = b.id),
  rel AS (SELECT id FROM f INTERSECT SELECT id FROM b) SELECT count(*) AS edges, count(DISTINCT src) AS starts FROM g WHERE src IN (SELECT id FROM rel) AND dst IN (SELECT id FROM rel)""",
)
def path_provenance(t):
    _, _, provenance = C.compress_paths(_typed_graph(t), _kept(t))
    return provenance.agg(F.count_distinct("id").alias("edges"), F.count_distinct(F.split_part("id", F.lit("-"), F.lit(1))).alias("starts"))


def _places(t):
    """region → nation → customer → order as one parent table."""
    world = t.region.select(s("r", c("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("parent_id"))
    return (
        world.unionByName(t.nation.select(s("n", c("n_nationkey")).alias("id"), s("r", c("n_regionkey")).alias("parent_id")))
        .unionByName(t.customer.select(s("c", c("c_custkey")).alias("id"), s("n", c("c_nationkey")).alias("parent_id")))
        .unionByName(t.orders.select(s("o", c("o_orderkey")).alias("id"), s("c", c("o_custkey")).alias("parent_id")))
    )


PLACES = """p AS (SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent_id FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders)"""
CLOSURE = "cl(id, ancestor, distance) AS (SELECT id, id, 0 FROM p UNION ALL SELECT cl.id, p.parent_id, distance + 1 FROM cl JOIN p ON p.id = cl.ancestor WHERE p.parent_id IS NOT NULL)"


@query("tree_closure", f"WITH RECURSIVE {PLACES}, {CLOSURE} SELECT id, ancestor, distance FROM cl")
def tree_closure(t):
    return R.ancestors(_places(t))


@query("root_depth", f"WITH RECURSIVE {PLACES}, {CLOSURE} SELECT id, arg_max(ancestor, distance) AS root, max(distance) AS depth, FALSE AS cyclic FROM cl GROUP BY id")
def root_depth(t):
    return R.roots(_places(t))


@query(
    "parent_cycles",
    """WITH RECURSIVE p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 10 <> 0 THEN (p_partkey * 7 + 3) % (SELECT max(p_partkey) + 1 FROM part) END AS parent_id FROM part),
  w(id, spot, n) AS (SELECT id, parent_id, 1 FROM p UNION ALL SELECT w.id, p.parent_id, n + 1 FROM w JOIN p ON p.id = w.spot WHERE w.spot IS NOT NULL AND n < (SELECT count(*) + 2 FROM part)),
  e AS (SELECT id, bool_or(spot IS NULL) AS ends FROM w GROUP BY id) SELECT id, NOT ends AS cyclic FROM e""",
)
def parent_cycles(t):
    size = t.part.agg((F.max("p_partkey") + 1).alias("_size"))
    parents = t.part.select(c("p_partkey").alias("id"), F.lit(1).alias("_k")).join(F.broadcast(size.withColumn("_k", F.lit(1))), "_k")  # one row
    parents = parents.select("id", F.when(c("id") % 10 != 0, (c("id") * 7 + 3) % c("_size")).alias("parent_id"))
    return R.roots(parents).select("id", "cyclic")


@query("tree_children", f"WITH {PLACES} SELECT parent_id AS id, count(*) AS children FROM p WHERE parent_id IS NOT NULL GROUP BY 1")
def tree_children(t):
    return R.children(_places(t))


@query(
    "scope_members",
    f"""WITH RECURSIVE {PLACES}, {CLOSURE}, o AS (SELECT l_orderkey, 'o' || l_orderkey AS scope FROM lineitem)
  SELECT ancestor AS scope, count(*) AS members, count(*) FILTER (distance = 0) AS direct FROM o JOIN cl ON cl.id = o.scope GROUP BY ancestor""",
)
def scope_members(t):
    owned = t.lineitem.select(s("o", c("l_orderkey")).alias("scope"))
    return R.scope_members(owned, _places(t))


@query(
    "tree_paths",
    f"""WITH RECURSIVE {PLACES}, t(id, path, depth) AS (SELECT id, id, 0 FROM p WHERE parent_id IS NULL UNION ALL SELECT p.id, t.path || '/' || p.id, depth + 1 FROM p JOIN t ON t.id = p.parent_id)
  SELECT id, path, depth FROM t""",
)
def tree_paths(t):
    return R.tree_paths(R.ancestors(_places(t)))


def _files(t):
    """Documents as files four directories deep below two packages."""
    lang, source = c("lang"), c("source")
    path = F.concat_ws("/", F.lit("pkg"), lang, F.lit("src"), source, F.when(c("doc_id") % 4 == 0, F.lit("deep/only")), F.concat(c("doc_id").cast("string"), F.lit(".md")))
    return t.documents.select(path.alias("path"), F.concat(F.lit("pkg/"), lang).alias("package_path"))


FILES = """f AS (SELECT 'pkg/' || lang || '/src/' || source || CASE WHEN doc_id % 4 = 0 THEN '/deep/only' ELSE '' END AS dir, 'pkg/' || lang AS package_path FROM documents),
  x AS (SELECT package_path, dir, string_split(dir, '/') AS p FROM f), y AS (SELECT package_path, dir, array_to_string(p[:i], '/') AS path, i FROM (SELECT *, unnest(range(3, len(p) + 1)) AS i FROM x)),
  dirs AS (SELECT package_path, path, i - 3 AS depth, count(*) FILTER (dir = path) AS modules, CASE WHEN i > 3 THEN regexp_replace(path, '/[^/]*$', '') END AS parent FROM y GROUP BY package_path, path, i),
  tree AS (SELECT d.*, (SELECT count(*) FROM dirs k WHERE k.parent = d.path) AS children FROM dirs d)"""


@query("directory_tree", f"WITH {FILES} SELECT package_path, path, depth, modules, parent, children FROM tree")
def directory_tree(t):
    return R.directory_tree(_files(t))


@query(
    "compress_chain",
    f"""WITH RECURSIVE {FILES}, w(path, spot) AS (SELECT path, path FROM tree UNION ALL SELECT w.path, k.path FROM w JOIN tree d ON d.path = w.spot AND d.modules = 0 AND d.children = 1 JOIN tree k ON k.parent = d.path),
  z AS (SELECT path, arg_max(spot, length(spot)) AS terminal FROM w GROUP BY path), q AS (SELECT tree.*, terminal FROM tree JOIN z USING (path)),
  h AS (SELECT terminal, count(*) AS folded, arg_min(parent, length(path)) AS above FROM q GROUP BY terminal)
  SELECT h.terminal, folded, q.terminal AS parent_terminal FROM h LEFT JOIN q ON q.path = h.above""",
)
def compress_chain(t):
    return R.chain_groups(R.compress_chain(R.directory_tree(_files(t)).drop("package_path")))
