"""Architecture, view, command and dictionary operators on a model that Spark derives from the trade tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import architecture as A
from corpusloom.operators import commandgraph as CG
from corpusloom.operators import quality as Q
from corpusloom.operators import tree as TR
from corpusloom.operators import views as V

from .registry import PAGES, page_paths, query, s, sized

c = F.col
PURPOSES = ("build", "deploy", "start", "serve", "generate", "apply", "package", "script")


def _pick(column, values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (column % len(values)).cast("int") + 1)


def model_nodes(t):
    """regions → code packages, nations → applications, suppliers → operations, parts → artifacts, configurations, resources, unknowns."""
    none, no_env = F.lit(None).cast("string"), F.array().cast("array<string>")
    envs = lambda k: F.when(k % 3 == 0, F.array(F.lit("prod"))).when(k % 3 == 1, F.array(F.lit("except:prod"))).otherwise(no_env)
    make = lambda frame, id_, kind, parent, environments, auxiliary, purpose, owner, tool, library: frame.select(
        id_.alias("id"), kind.alias("kind"), parent.alias("parent_id"), environments.alias("environments"), auxiliary.alias("auxiliary"), purpose.alias("purpose"), owner.alias("logical_owner"), tool.alias("tool"), library.alias("library"),
        none.alias("request_owner"), none.alias("definition_owner"), F.lit(False).alias("has_entry"),
    )
    no, r, n, k, p = F.lit(False), c("r_regionkey"), c("n_nationkey"), c("s_suppkey"), c("p_partkey")
    rows = make(t.region, s("r", r), F.lit("code-package"), none, no_env, r == 4, none, none, none, r % 2 == 0)
    rows = rows.unionByName(make(t.nation, s("n", n), F.lit("application"), s("r", c("n_regionkey")), no_env, no, none, none, none, no))
    rows = rows.unionByName(make(t.supplier, s("s", k), F.lit("tool-operation"), s("n", c("s_nationkey")), envs(k), no, _pick(k, PURPOSES), none, s("tool", k % 4), no))
    kinds = _pick(p, ("artifact", "execution-config", "resource", "unresolved"))
    owner = F.when(p % 4 == 1, s("n", p % 25))
    return rows.unionByName(make(t.part, s("p", p), kinds, none, envs(p), no, none, owner, none, no))


MODEL = """md AS (SELECT 'r' || r_regionkey AS id, 'code-package' AS kind, NULL::VARCHAR AS parent_id, []::VARCHAR[] AS environments, r_regionkey = 4 AS auxiliary, NULL::VARCHAR AS purpose, NULL::VARCHAR AS logical_owner, NULL::VARCHAR AS tool, r_regionkey % 2 = 0 AS library FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'application', 'r' || n_regionkey, [], FALSE, NULL, NULL, NULL, FALSE FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'tool-operation', 'n' || s_nationkey, CASE s_suppkey % 3 WHEN 0 THEN ['prod'] WHEN 1 THEN ['except:prod'] ELSE [] END, FALSE, (['build', 'deploy', 'start', 'serve', 'generate', 'apply', 'package', 'script'])[s_suppkey % 8 + 1], NULL, 'tool' || (s_suppkey % 4), FALSE FROM supplier
  UNION ALL SELECT 'p' || p_partkey, (['artifact', 'execution-config', 'resource', 'unresolved'])[p_partkey % 4 + 1], NULL, CASE p_partkey % 3 WHEN 0 THEN ['prod'] WHEN 1 THEN ['except:prod'] ELSE [] END, FALSE, NULL, CASE WHEN p_partkey % 4 = 1 THEN 'n' || (p_partkey % 25) END, NULL, FALSE FROM part)"""


def model_edges(t):
    """Typed flows between operations and their targets, command order between operations, and recorded definitions."""
    lines = t.lineitem.select("l_suppkey", "l_partkey", "l_returnflag", "l_linestatus").distinct()
    reading = (c("l_partkey") % 4 == 0) & (c("l_returnflag") == "R")
    kind = (
        F.when(reading, "flow-input").when(c("l_partkey") % 4 == 0, "flow-generates").when((c("l_partkey") % 4 == 1) & (c("l_returnflag") == "A"), "flow-deploys").when(c("l_partkey") % 4 == 1, "flow-starts")
        .when((c("l_partkey") % 4 == 2) & (c("l_returnflag") == "A"), "flow-applies").when(c("l_partkey") % 4 == 2, "data-operation").otherwise("http-request")
    )
    op, part = s("s", c("l_suppkey")), s("p", c("l_partkey"))
    flows = lines.select(F.when(reading, part).otherwise(op).alias("src"), F.when(reading, op).otherwise(part).alias("dst"), kind.alias("kind"), F.when(c("l_linestatus") == "O", "prod").otherwise("").alias("environment"))
    calls = t.supplier.select(s("s", c("s_suppkey")).alias("src"), s("s", F.floor(c("s_suppkey") / 3)).alias("dst"), F.when(c("s_suppkey") % 2 == 0, "flow-precedes").otherwise("flow-invokes").alias("kind"), F.lit("").alias("environment")).filter("src <> dst")
    owned = t.part.filter("p_partkey % 4 = 1").select(s("n", c("p_partkey") % 25).alias("src"), s("p", c("p_partkey")).alias("dst"), F.lit("flow-definition").alias("kind"), F.lit("").alias("environment"))
    uses = t.nation.select(s("n", c("n_nationkey")).alias("src"), s("n", (c("n_nationkey") * 7 + 3) % 25).alias("dst"), F.when(c("n_nationkey") % 3 == 0, "code-reference").otherwise("declaration-dependency").alias("kind"), F.lit("").alias("environment"))
    served = t.part.filter("p_partkey % 100 = 2").select(s("n", c("p_partkey") % 25).alias("src"), s("p", c("p_partkey")).alias("dst"), F.lit("service-use").alias("kind"), F.lit("").alias("environment"))
    rows = flows.unionByName(calls).unionByName(owned).unionByName(uses).unionByName(served)
    return rows.withColumn("id", F.concat_ws("|", "src", "dst", "kind", "environment")).withColumn("confidence", F.when(c("environment") == "prod", "source").otherwise("inferred"))


def model_edges_sql() -> str:
    return """li AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS p, l_returnflag AS f, l_linestatus AS st FROM lineitem),
  me0 AS (SELECT CASE WHEN p % 4 = 0 AND f = 'R' THEN 'p' || p ELSE 's' || k END AS src, CASE WHEN p % 4 = 0 AND f = 'R' THEN 's' || k ELSE 'p' || p END AS dst,
  CASE WHEN p % 4 = 0 AND f = 'R' THEN 'flow-input' WHEN p % 4 = 0 THEN 'flow-generates' WHEN p % 4 = 1 AND f = 'A' THEN 'flow-deploys' WHEN p % 4 = 1 THEN 'flow-starts' WHEN p % 4 = 2 AND f = 'A' THEN 'flow-applies' WHEN p % 4 = 2 THEN 'data-operation' ELSE 'http-request' END AS kind,
  CASE WHEN st = 'O' THEN 'prod' ELSE '' END AS environment FROM li UNION ALL SELECT 's' || s_suppkey, 's' || (s_suppkey // 3), CASE WHEN s_suppkey % 2 = 0 THEN 'flow-precedes' ELSE 'flow-invokes' END, '' FROM supplier WHERE s_suppkey <> s_suppkey // 3
  UNION ALL SELECT 'n' || (p_partkey % 25), 'p' || p_partkey, 'flow-definition', '' FROM part WHERE p_partkey % 4 = 1
  UNION ALL SELECT 'n' || n_nationkey, 'n' || ((n_nationkey * 7 + 3) % 25), CASE WHEN n_nationkey % 3 = 0 THEN 'code-reference' ELSE 'declaration-dependency' END, '' FROM nation UNION ALL SELECT 'n' || (p_partkey % 25), 'p' || p_partkey, 'service-use', '' FROM part WHERE p_partkey % 100 = 2),
  me AS (SELECT *, concat_ws('|', src, dst, kind, environment) AS id, CASE WHEN environment = 'prod' THEN 'source' ELSE 'inferred' END AS confidence FROM me0)"""


EDGES_SQL = model_edges_sql()
ANC = """anc(id, ancestor, d) AS (SELECT id, id, 0 FROM md UNION ALL SELECT anc.id, md.parent_id, d + 1 FROM anc JOIN md ON md.id = anc.ancestor WHERE md.parent_id IS NOT NULL)"""


@query(
    "env_filter",
    f"""WITH RECURSIVE {MODEL}, {ANC} SELECT id FROM md WHERE (kind = 'application' OR len(environments) = 0 OR list_contains(environments, 'prod')) AND id NOT IN (SELECT anc.id FROM anc JOIN md a ON a.id = anc.ancestor WHERE a.auxiliary)""",
)
def env_filter(t):
    nodes = model_nodes(t)
    return A.env_filter(nodes, "prod", ancestors=TR.ancestors(nodes.select("id", "parent_id"))).select("id")


@query(
    "env_edges",
    f"""WITH RECURSIVE {MODEL}, {EDGES_SQL}, ok AS (SELECT id FROM md WHERE kind = 'application' OR len(environments) = 0 OR list_contains(environments, 'dev') OR environments = ['except:prod'])
  SELECT kind, count(*) AS n FROM me WHERE environment = '' AND src IN (SELECT id FROM ok) AND dst IN (SELECT id FROM ok) GROUP BY kind""",
)
def env_edges(t):
    shown = A.env_filter(model_nodes(t), "dev", include_auxiliary=True)
    return A.env_edges(model_edges(t), shown, "dev").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "content_choices",
    f"""WITH {MODEL}, {EDGES_SQL}, x AS (SELECT *, kind IN ('application', 'code-package') AS def FROM md) SELECT 'environment' AS "group", 'prod' AS choice, count(*) AS nodes FROM x WHERE NOT def AND list_contains(environments, 'prod')
  UNION ALL SELECT 'partition', 'definition:', count(*) FROM x WHERE def UNION ALL SELECT 'partition', 'unknown:', count(*) FROM x WHERE NOT def AND NOT list_contains(environments, 'prod')
  UNION ALL SELECT 'path', CASE WHEN purpose IN ('start', 'serve') THEN 'start' WHEN purpose IN ('build', 'package', 'deploy') THEN 'publish' ELSE 'database' END, count(*) FROM x WHERE kind = 'tool-operation' AND purpose <> 'script' GROUP BY 2
  UNION ALL SELECT 'path', 'runtime', count(*) FROM me WHERE kind = 'service-use'""",
)
def content_choices(t):
    return A.content_choices(model_nodes(t), model_edges(t))


@query(
    "content_range",
    f"""WITH RECURSIVE {MODEL}, {model_edges_sql()}, op AS (SELECT id FROM md WHERE kind = 'tool-operation'), al AS (SELECT id FROM md WHERE purpose IN ('build', 'package', 'deploy')), sc AS (SELECT id FROM md WHERE purpose = 'script' UNION SELECT id FROM al),
  io AS (SELECT * FROM me WHERE kind IN ('flow-input', 'flow-starts', 'flow-deploys', 'flow-generates', 'flow-applies')), ord AS (SELECT * FROM me WHERE kind IN ('flow-invokes', 'flow-precedes')), art AS (SELECT id FROM md WHERE kind = 'artifact'),
  step AS (SELECT 'o' AS a, dst AS x, 'o' AS b, src AS y FROM ord WHERE src IN (SELECT id FROM sc) UNION ALL SELECT 'o', src, 'a', dst FROM io WHERE dst IN (SELECT id FROM art) UNION ALL SELECT 'o', dst, 'a', src FROM io WHERE src IN (SELECT id FROM art)
    UNION ALL SELECT 'a', src, 'o', dst FROM io WHERE kind = 'flow-input' AND dst IN (SELECT id FROM al) UNION ALL SELECT 'a', dst, 'o', src FROM io WHERE kind = 'flow-generates' AND src IN (SELECT id FROM al)),
  st(t, id) AS (SELECT 'o', id FROM al UNION SELECT b, y FROM st JOIN step ON a = st.t AND x = st.id), ops AS (SELECT id FROM st WHERE t = 'o'), ars AS (SELECT id FROM st WHERE t = 'a'),
  inc AS (SELECT * FROM ord WHERE dst IN (SELECT id FROM ops) AND src IN (SELECT id FROM sc) UNION SELECT * FROM io WHERE src IN (SELECT id FROM ops) OR dst IN (SELECT id FROM ops)),
  sub AS (SELECT id FROM al UNION SELECT src FROM inc UNION SELECT dst FROM inc), sup AS (SELECT src AS id FROM me WHERE kind = 'flow-definition' AND dst IN (SELECT id FROM sub)),
  al2 AS (SELECT id FROM sub UNION SELECT id FROM sup), up(id) AS (SELECT id FROM al2 UNION SELECT parent_id FROM up JOIN md ON md.id = up.id WHERE parent_id IS NOT NULL)
  SELECT id, CASE WHEN id IN (SELECT id FROM al) THEN 'core' WHEN id IN (SELECT id FROM sub) THEN 'peer' ELSE 'support' END AS role FROM up""",
)
def content_range(t):
    nodes, _ = A.content_range(model_nodes(t), model_edges(t), path="publish")
    return nodes


@query(
    "content_range_runtime",
    f"""WITH RECURSIVE {MODEL}, {model_edges_sql()}, rt AS (SELECT * FROM me WHERE kind IN ('data-operation', 'http-request', 'service-use') AND src NOT IN (SELECT id FROM md WHERE kind = 'tool-operation')),
  core AS (SELECT src AS id FROM rt UNION SELECT dst FROM rt), exp AS (SELECT src AS id FROM me WHERE kind = 'flow-definition' AND dst IN (SELECT id FROM core)), al2 AS (SELECT id FROM core UNION SELECT id FROM exp),
  up(id) AS (SELECT id FROM al2 UNION SELECT parent_id FROM up JOIN md ON md.id = up.id WHERE parent_id IS NOT NULL) SELECT id, CASE WHEN id IN (SELECT id FROM core) THEN 'core' ELSE 'support' END AS role FROM up""",
)
def content_range_runtime(t):
    nodes, _ = A.content_range(model_nodes(t), model_edges(t), path="runtime")
    return nodes


@query("content_range_environment")
def content_range_environment(t):
    nodes, _ = A.content_range(model_nodes(t), model_edges(t), environment="prod")
    return nodes.groupBy("role").agg(F.count(F.lit(1)).alias("nodes"))


@query("content_range_definition")
def content_range_definition(t):
    nodes, _ = A.content_range(model_nodes(t), model_edges(t), meaning="definition")
    return nodes.groupBy("role").agg(F.count(F.lit(1)).alias("nodes"))


@query(
    "scope_projection",
    f"""WITH RECURSIVE {MODEL}, {EDGES_SQL}, {ANC}, rt AS (SELECT id, arg_max(ancestor, d) AS root FROM anc GROUP BY id), zz AS (SELECT id, d AS zd FROM anc WHERE ancestor = 'r1'),
  ow AS (SELECT rt.id, CASE WHEN zd > 0 THEN (SELECT ancestor FROM anc WHERE anc.id = rt.id AND anc.d = zz.zd - 1) WHEN rt.id = 'r1' THEN 'r1' ELSE root END AS owner FROM rt LEFT JOIN zz ON zz.id = rt.id)
  SELECT a.owner AS src_owner, b.owner AS dst_owner, kind, environment, CASE WHEN a.owner <> b.owner THEN 'connection' WHEN src <> a.owner OR dst <> b.owner THEN 'internal' ELSE 'self' END AS relation, count(*) AS n
  FROM me JOIN ow a ON a.id = src JOIN ow b ON b.id = dst GROUP BY ALL""",
)
def scope_projection(t):
    nodes = model_nodes(t)
    _, bundled = A.scope_projection(nodes, model_edges(t), TR.ancestors(nodes.select("id", "parent_id")), scope="r1")
    return bundled.groupBy("src_owner", "dst_owner", "kind", "environment", "relation").agg(F.sum("n").alias("n"))


@query(
    "ownership",
    rf"""WITH {PAGES}, x AS (SELECT page_id, path, CASE WHEN page_id % 5 = 0 THEN 'external' ELSE 'function' END AS kind, page_id % 3 <> 0 AS known, CASE page_id % 4 WHEN 0 THEN 'context:runtime:rt' || (page_id % 7) WHEN 1 THEN 'context:service:svc' ELSE 'context:unclassified' END AS ctx FROM pg)
  SELECT page_id AS id, 'project' AS scope, 'project' AS kind, 0 AS level FROM x UNION ALL SELECT page_id, ctx, 'context', 1 FROM x
  UNION ALL SELECT page_id, 'directory|' || ctx || '|' || array_to_string((string_split(path, '/'))[:i], '/'), 'directory', (i + 1)::INT FROM (SELECT *, unnest(range(1, len(string_split(path, '/')))) AS i FROM x WHERE known AND kind <> 'external')
  UNION ALL SELECT page_id, 'file|' || ctx || '|' || path, 'file', (len(string_split(path, '/')) + 1)::INT FROM x WHERE known AND kind <> 'external'
  UNION ALL SELECT page_id, 'group|' || ctx || '|' || CASE WHEN kind = 'external' THEN 'unresolved-calls' ELSE 'membership:g' END, 'group', 2 FROM x WHERE NOT known OR kind = 'external'""",
)
def ownership(t):
    return _ownership(t)


def _ownership(t):
    pages = page_paths(t)
    nodes = pages.select(
        c("page_id").alias("id"), F.when(c("page_id") % 5 == 0, "external").otherwise("function").alias("kind"), "path", F.lit("g").alias("group"), F.when(c("page_id") % 4 == 1, "svc").alias("service")
    )
    files = pages.filter("page_id % 3 <> 0").select("path")
    # Pages 2 mod 4 have two candidate runtimes, which decides nothing.
    two = F.when(c("page_id") % 4 == 0, F.array(s("rt", c("page_id") % 7))).when(c("page_id") % 4 == 2, F.array(F.lit("rtA"), F.lit("rtB"))).otherwise(F.array().cast("array<string>"))
    return A.ownership(nodes, files, pages.select(c("page_id").alias("id"), F.explode(two).alias("runtime")))


@query("ownership_mode", "SELECT 'mixed' AS mode FROM (SELECT count(*) AS n FROM pages) WHERE n > 3")
def ownership_mode(t):
    return _ownership(t).agg(A.ownership_mode().alias("mode"))


TARGETS = """lo AS (SELECT id, kind, coalesce(logical_owner, CASE WHEN kind IN ('application', 'code-package') THEN id END) AS logical FROM md),
  ops AS (SELECT id, purpose FROM md WHERE kind = 'tool-operation' AND purpose <> 'script'),
  r0 AS (SELECT src AS id, coalesce(logical, CASE WHEN lo.kind = 'resource' THEN dst END) AS target, 1 AS tier FROM me JOIN ops ON ops.id = src JOIN lo ON lo.id = dst WHERE me.kind IN ('flow-starts', 'flow-deploys', 'flow-applies')
    UNION SELECT dst, logical, 2 FROM me JOIN ops ON ops.id = dst JOIN lo ON lo.id = src WHERE me.kind = 'flow-input' AND purpose NOT IN ('generate', 'apply')
    UNION SELECT g.src, ap.dst, 1 FROM me g JOIN ops ON ops.id = g.src AND purpose = 'generate' JOIN me i ON i.src = g.dst AND i.kind = 'flow-input' JOIN me ap ON ap.src = i.dst AND ap.kind = 'flow-applies' WHERE g.kind = 'flow-generates'
    UNION SELECT src, dst, 3 FROM me JOIN ops ON ops.id = src WHERE me.kind = 'flow-generates'),
  r1 AS (SELECT DISTINCT * FROM r0 WHERE target IS NOT NULL), tg AS (SELECT DISTINCT r1.id, target FROM r1 JOIN (SELECT id, min(tier) AS m FROM r1 GROUP BY id) z ON z.id = r1.id AND tier = m)"""


@query("usage_targets", f"WITH {MODEL}, {EDGES_SQL}, {TARGETS} SELECT id, target FROM tg")
def usage_targets(t):
    return A.usage_targets(model_nodes(t), model_edges(t))


@query(
    "usage_index",
    f"""WITH {MODEL}, {model_edges_sql()}, {TARGETS}, i AS (SELECT dst AS id, count(DISTINCT coalesce(logical, src)) AS n FROM me JOIN ops ON ops.id = dst JOIN lo ON lo.id = src WHERE me.kind = 'flow-input' GROUP BY 1),
  o AS (SELECT src AS id, count(DISTINCT (kind, dst, environment)) AS n FROM me JOIN ops ON ops.id = src WHERE kind IN ('flow-generates', 'flow-starts', 'flow-deploys', 'flow-applies') GROUP BY 1), k AS (SELECT id, count(*) AS n FROM tg GROUP BY 1)
  SELECT md.id, tool, md.purpose, coalesce(k.n, 0) AS targets, coalesce(i.n, 0) AS inputs, coalesce(o.n, 0) AS outputs, coalesce(k.n, 0) > 0 OR coalesce(i.n, 0) > 0 AS resolved FROM md JOIN ops ON ops.id = md.id LEFT JOIN i ON i.id = md.id LEFT JOIN o ON o.id = md.id LEFT JOIN k ON k.id = md.id""",
)
def usage_index(t):
    return A.usage_index(model_nodes(t), model_edges(t)).drop("context")


@query("simple_overview")
def simple_overview(t):
    """Entities and units of every rule, then edges, relations between units and edges inside a unit of every kind of relation."""
    nodes, edges = model_nodes(sized(t, "lineitem")), model_edges(t)
    units, relations = A.simple_overview(nodes, edges, _structural(nodes, edges).select("id", "group_id"))
    rules = units.groupBy("rule").agg(F.count(F.lit(1)).alias("entities"), F.count_distinct("unit").alias("units"))
    kinds = relations.groupBy("kind").agg(F.sum("n").alias("edges"), F.count_if(~c("internal")).alias("relations"), F.sum(F.when(c("internal"), c("n")).otherwise(0)).alias("internal"))
    return rules.unionByName(kinds, allowMissingColumns=True)


@query(
    "overview_conservation",
    f"""WITH {MODEL}, {model_edges_sql()} SELECT (SELECT count(*) FROM md) AS entities, (SELECT count(*) FROM me WHERE src IN (SELECT id FROM md) AND dst IN (SELECT id FROM md)) AS relations""",
)
def overview_conservation(t):
    units, relations = A.simple_overview(model_nodes(sized(t, "lineitem")), model_edges(t))
    return units.agg(F.count_distinct("id").alias("entities"), F.lit(1).alias("_k")).join(relations.agg(F.sum("n").alias("relations"), F.lit(1).alias("_k")), "_k").drop("_k")


@query(
    "structural_groups",
    """WITH x AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 9 = 0 THEN 'original|' || s_suppkey ELSE 'n' || s_nationkey || '|wrangler.json|' || CASE WHEN s_suppkey % 2 = 0 THEN 'local' ELSE '' END || '|env' || (s_suppkey % 4) END AS key FROM supplier)
  SELECT id, CASE WHEN count(*) OVER (PARTITION BY key) = 1 THEN key ELSE key || ':' || id END AS group_id FROM x""",
)
def structural_groups(t):
    rows = t.supplier.select(
        c("s_suppkey").alias("id"), F.when(c("s_suppkey") % 9 != 0, s("n", c("s_nationkey"))).alias("owner"), F.lit("wrangler.json").alias("configuration_path"), F.when(c("s_suppkey") % 2 == 0, "local").alias("place"),
        F.array(s("env", c("s_suppkey") % 4)).alias("environments"),
    )
    return A.structural_groups(rows)


@query(
    "structural_categories",
    f"""WITH {MODEL}, d AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_partkey % 4 = 1 AND l_returnflag = 'A'),
  x AS (SELECT 'p' || p_partkey AS id, CASE WHEN k IS NULL THEN 'runtime' ELSE 'destination' END AS category, 'n' || (p_partkey % 25) || '|app.json|' || '|' || CASE p_partkey % 3 WHEN 0 THEN 'prod' WHEN 1 THEN 'except:prod' ELSE '' END AS key
    FROM part LEFT JOIN d ON k = p_partkey WHERE p_partkey % 4 = 1)
  SELECT id, CASE WHEN count(*) OVER (PARTITION BY category, key) = 1 THEN category || '|' || key ELSE category || '|' || key || ':' || id END AS group_id, category FROM x
  UNION ALL SELECT id, 'unconfirmed-code-packages', 'unconfirmed' FROM md WHERE kind = 'code-package' AND parent_id IS NULL AND NOT auxiliary""",
)
def structural_categories(t):
    return _structural(model_nodes(t), model_edges(t))


def _structural(nodes, edges):
    configurations = nodes.filter("kind = 'execution-config'").select("id", c("logical_owner").alias("owner"), F.lit("app.json").alias("configuration_path"), F.lit(None).cast("string").alias("place"), "environments")
    return A.structural_groups(configurations, edges).unionByName(A.unconfirmed_packages(nodes))


@query(
    "resource_groups",
    """WITH x AS (SELECT s_suppkey AS id, 'D1|' || 'w' || (s_suppkey % 40) || '|DB' AS key, s_nationkey % 4 AS e FROM supplier) SELECT id, key AS group_id FROM x WHERE key IN (SELECT key FROM x GROUP BY key HAVING count(*) >= 2 AND count(*) = count(DISTINCT e))""",
)
def resource_groups(t):
    rows = t.supplier.select(
        c("s_suppkey").alias("id"), F.lit("D1").alias("type"), s("w", c("s_suppkey") % 40).alias("path"), F.lit("DB").alias("binding"), s("e", c("s_nationkey") % 4).alias("environment"), F.lit("local").alias("place")
    )
    return A.resource_groups(rows)


@query(
    "package_usage",
    f"""WITH RECURSIVE {MODEL}, {EDGES_SQL}, {ANC}, rt AS (SELECT id, arg_max(ancestor, d) AS root FROM anc GROUP BY id),
  l AS (SELECT a.root AS consumer, b.root AS id, kind FROM me JOIN rt a ON a.id = src JOIN rt b ON b.id = dst WHERE kind IN ('code-reference', 'declaration-dependency') AND a.root <> b.root),
  g AS (SELECT id, count(DISTINCT consumer) AS consumers, count(*) FILTER (kind = 'code-reference') AS s, count(*) FILTER (kind <> 'code-reference') AS d FROM l GROUP BY id)
  SELECT md.id, coalesce(consumers, 0) AS consumers, coalesce(s, 0) AS source_uses, coalesce(d, 0) AS declared_uses, CASE WHEN s > 0 THEN 'source' WHEN d > 0 THEN 'declared' ELSE 'unconfirmed' END AS status, coalesce(s, 0) > 0 OR (coalesce(d, 0) > 0 AND library) AS shared
  FROM md LEFT JOIN g ON g.id = md.id WHERE kind = 'code-package'""",
)
def package_usage(t):
    nodes = model_nodes(t)
    return A.package_usage(nodes, model_edges(t), TR.roots(nodes.select("id", "parent_id")).select("id", "root"))


@query(
    "technology_usage",
    """WITH r AS (SELECT l_suppkey AS e, p_name AS n, CASE WHEN l_returnflag = 'R' OR l_linenumber = 1 THEN 2 ELSE 1 END AS k FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity >= 3 UNION ALL SELECT l_suppkey, p_name, 3 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity < 3)
  SELECT e AS entity, n AS name, CASE min(k) WHEN 1 THEN 'source' WHEN 2 THEN 'support' ELSE 'declared' END AS usage FROM r GROUP BY ALL""",
)
def technology_usage(t):
    named = t.lineitem.join(t.part.select(c("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    references = named.filter("l_quantity >= 3").select(
        c("l_suppkey").alias("entity"), c("p_name").alias("name"), F.when(c("l_linenumber") == 1, "a/tests/x.ts").otherwise("a/src/x.ts").alias("path"), (c("l_returnflag") == "R").alias("type_only")
    )
    declared = named.filter("l_quantity < 3").select(c("l_suppkey").alias("entity"), c("p_name").alias("name"))
    return A.technology_usage(references, declared)


@query(
    "content_coverage",
    """WITH g AS (SELECT source AS group_id, count(*) AS total, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS inside FROM documents WHERE lang <> 'en' OR doc_id IN (SELECT doc_id FROM labels) GROUP BY 1)
  SELECT group_id, inside, total, CASE WHEN inside = total THEN 'inside' WHEN inside > 0 THEN 'partial' ELSE 'outside' END AS state FROM g""",
)
def content_coverage(t):
    listed = t.documents.join(t.labels.select("doc_id").distinct().withColumn("_l", F.lit(True)), "doc_id", "left").filter("lang <> 'en' or _l")
    return A.content_coverage(listed.select(c("source").alias("group_id"), c("doc_id").alias("id")), t.labels.select(c("doc_id").alias("id")))


def _workspace(t):
    root = t.region.filter("r_regionkey = 0").select(F.lit("project:root").alias("id"), F.lit("project").alias("kind"), F.lit(False).alias("is_root"))
    facts = (
        root.unionByName(t.region.select(s("cfg", c("r_regionkey")).alias("id"), F.lit("workspace-config").alias("kind"), F.lit(False).alias("is_root")))
        .unionByName(t.nation.select(s("pat", c("n_nationkey")).alias("id"), F.lit("workspace-pattern").alias("kind"), F.lit(False).alias("is_root")))
        .unionByName(t.supplier.select(s("pkg", c("s_suppkey")).alias("id"), F.lit("workspace-package").alias("kind"), (c("s_suppkey") % 10 == 0).alias("is_root")))
        .unionByName(t.part.select(s("mod", c("p_partkey")).alias("id"), F.lit("module").alias("kind"), F.lit(False).alias("is_root")))
    )
    relations = (
        t.nation.select(s("cfg", c("n_regionkey")).alias("src"), s("pat", c("n_nationkey")).alias("dst"), F.lit("declares").alias("kind"))
        .unionByName(t.supplier.select(s("pat", c("s_nationkey")).alias("src"), s("pkg", c("s_suppkey")).alias("dst"), F.lit("matches").alias("kind")))
        .unionByName(t.supplier.select(F.lit("project:root").alias("src"), s("pkg", c("s_suppkey")).alias("dst"), F.lit("contains").alias("kind")))
        .unionByName(t.part.select(s("pat", c("p_partkey") % 25).alias("src"), s("mod", c("p_partkey")).alias("dst"), F.lit("matches").alias("kind")))
    )
    return facts, relations.withColumn("id", F.concat_ws(":", F.lit("relation"), "kind", "src", "dst"))


@query(
    "workspace_view",
    """SELECT 'declares' AS kind, count(*) AS n FROM nation UNION ALL SELECT 'matches', count(*) FROM supplier UNION ALL SELECT 'contains', count(*) FROM supplier WHERE s_suppkey % 10 = 0""",
)
def workspace_view(t):
    _, shown, _ = V.workspace_view(*_workspace(t))
    return shown.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def _usage_inputs(t):
    """Line items as evidence of part brands (facts) in page folders (scopes)."""
    detector = F.when(c("l_linenumber") == 1, "package-dependency").when(c("l_linenumber") == 2, "source-import").when(c("l_linenumber") == 3, "vite-config").otherwise("other")
    rows = t.lineitem.join(t.part, c("p_partkey") == c("l_partkey"))
    eid = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    fact = rows.select(s("f", c("p_brand"), ":", c("p_size") % 5).alias("fact_id"), F.lit("technology").alias("fact_kind"), c("p_brand").alias("stack_id"), (c("p_size") % 5 == 0).alias("explicit"), eid.alias("evidence_id"))
    path = F.concat(s("ws/n", c("l_suppkey") % 30), F.when(c("l_orderkey") % 2 == 0, "/sub").otherwise(""), F.lit("/a.ts"))
    evidence = rows.select(eid.alias("evidence_id"), path.alias("path"), F.when(c("l_linenumber") == 4, "usage").alias("role"), detector.alias("detector_id")).repartition("evidence_id").distinct()
    scopes = t.nation.select(s("ws/n", c("n_nationkey")).alias("path"), F.when(c("n_nationkey") % 2 == 0, "package").otherwise("config").alias("source"), F.lit("application").alias("kind"), F.lit(False).alias("explicit"), F.lit(None).cast("string").alias("fact_id"))
    scopes = scopes.unionByName(t.nation.filter("n_nationkey % 5 = 0").select(s("ws/n", c("n_nationkey"), "/sub").alias("path"), F.lit("runtime").alias("source"), F.lit("application").alias("kind"), F.lit(False).alias("explicit"), F.lit(None).cast("string").alias("fact_id")))
    return fact, evidence, scopes


ATTRIBUTED = """ev AS (SELECT 'f' || p_brand || ':' || (p_size % 5) AS fact_id, p_brand AS stack_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS evidence_id,
    CASE WHEN l_linenumber = 4 THEN 'usage' WHEN l_linenumber = 1 THEN 'declaration' WHEN l_linenumber IN (2, 3) THEN 'usage' WHEN p_size % 5 = 0 THEN 'usage' ELSE 'declaration' END AS role,
    CASE WHEN l_suppkey % 30 < 25 THEN 'ws/n' || (l_suppkey % 30) || CASE WHEN l_orderkey % 2 = 0 AND (l_suppkey % 30) % 5 = 0 THEN '/sub' ELSE '' END END AS scope FROM lineitem JOIN part ON p_partkey = l_partkey),
  us AS (SELECT DISTINCT fact_id, scope FROM ev WHERE role = 'usage' AND scope IS NOT NULL),
  att AS (SELECT fact_id, stack_id, scope, evidence_id, role FROM ev WHERE role = 'usage' AND scope IS NOT NULL
    UNION SELECT fact_id, stack_id, scope, evidence_id, role FROM ev WHERE role = 'declaration' AND scope IS NOT NULL AND fact_id NOT IN (SELECT fact_id FROM us)
    UNION SELECT ev.fact_id, stack_id, ev.scope, evidence_id, role FROM ev JOIN us ON us.fact_id = ev.fact_id AND us.scope = ev.scope WHERE role = 'declaration'
    UNION SELECT ev.fact_id, stack_id, us.scope, evidence_id, role FROM ev JOIN us ON us.fact_id = ev.fact_id WHERE role = 'declaration' AND NOT EXISTS (SELECT 1 FROM us u2 WHERE u2.fact_id = ev.fact_id AND u2.scope = ev.scope))"""


@query("attribute_usage", f"WITH {ATTRIBUTED} SELECT fact_id, scope, role, count(*) AS evidence FROM att GROUP BY ALL")
def attribute_usage(t):
    fact, evidence, scopes = _usage_inputs(t)
    return V.attribution_counts(V.attribute_evidence(fact, evidence, scopes.select(c("path").alias("owner_path"), c("path").alias("owner"))))


_SCOPE_NAMES = """nm AS (SELECT scope, replace(scope, '/sub', '') AS top, 'scope:' || CASE WHEN scope LIKE '%/sub' THEN 'runtime' WHEN regexp_extract(scope, '[0-9]+$')::INT % 2 = 0 THEN 'package' ELSE 'config' END || ':' || scope AS id
  FROM (SELECT DISTINCT scope FROM att))"""


@query(
    "stack_map_edges",
    f"""WITH {ATTRIBUTED}, {_SCOPE_NAMES} SELECT 'view-edge:contains:' || nm.id AS id, 'project:root' AS src, nm.id AS dst, 'contains' AS kind, count(DISTINCT evidence_id) AS evidence
  FROM nm JOIN att ON att.scope = nm.scope WHERE nm.scope = nm.top OR nm.top NOT IN (SELECT scope FROM nm) GROUP BY nm.id""",
)
def stack_map_edges(t):
    return V.stack_map(*_usage_inputs(sized(t, "lineitem")), project="project:root")["edge"].select("id", "src", "dst", "kind", "evidence")


@query(
    "stack_map",
    f"""WITH {ATTRIBUTED}, sc AS (SELECT scope, 'scope:' || CASE WHEN scope LIKE '%/sub' THEN 'runtime' WHEN regexp_extract(scope, '[0-9]+$')::INT % 2 = 0 THEN 'package' ELSE 'config' END || ':' || scope AS id FROM (SELECT DISTINCT scope FROM att))
  SELECT sc.id AS scope, stack_id, count(DISTINCT evidence_id) AS evidence, count(DISTINCT fact_id) AS facts, bool_or(role = 'usage') AS used FROM att JOIN sc ON sc.scope = att.scope GROUP BY ALL""",
)
def stack_map(t):
    return V.stack_map(*_usage_inputs(t))["usage"].select("scope", "stack_id", "evidence", "facts", "used")


@query(
    "stack_map_regions",
    f"""WITH {ATTRIBUTED}, sc AS (SELECT DISTINCT scope, replace(scope, '/sub', '') AS top FROM att), nm AS (SELECT scope, top, 'scope:' || CASE WHEN scope <> top THEN 'runtime' WHEN regexp_extract(top, '[0-9]+$')::INT % 2 = 0 THEN 'package' ELSE 'config' END || ':' || scope AS id FROM sc)
  SELECT nm.id, up.id AS parent_id FROM nm LEFT JOIN nm up ON up.scope = nm.top AND nm.scope <> nm.top""",
)
def stack_map_regions(t):
    return V.stack_map(*_usage_inputs(t))["region"].select("id", "parent_id")


@query(
    "scope_candidates",
    """WITH x AS (SELECT 'd/' || (o_custkey % 200) AS path, CASE o_orderstatus WHEN 'F' THEN 'package' WHEN 'O' THEN 'config' ELSE 'workspace' END AS source, CASE o_orderstatus WHEN 'F' THEN 5 WHEN 'O' THEN 3 ELSE 2 END AS k, o_totalprice > 490000 AS desk, o_orderpriority = '1-URGENT' AS ex FROM orders)
  SELECT path, arg_max(source, k) AS source, CASE WHEN bool_or(desk) THEN 'desktop' ELSE 'application' END AS kind, bool_or(ex) AS explicit FROM x GROUP BY path""",
)
def scope_candidates(t):
    rows = t.orders.select(
        s("d/", c("o_custkey") % 200).alias("path"), F.when(c("o_orderstatus") == "F", "package").when(c("o_orderstatus") == "O", "config").otherwise("workspace").alias("source"),
        F.when(c("o_totalprice") > 490000, "desktop").otherwise("application").alias("kind"), (c("o_orderpriority") == "1-URGENT").alias("explicit"), F.lit(None).cast("string").alias("fact_id"),
    )
    return V.scope_candidates(rows).select("path", "source", "kind", "explicit")


@query(
    "module_view",
    """WITH f AS (SELECT doc_id, 'pkg/' || lang || '/src/' || source || '/' || doc_id || '.ts' AS path FROM documents), i AS (SELECT f.path, g.path AS target FROM f LEFT JOIN f g ON g.doc_id = f.doc_id * 7 % 1500),
  d AS (SELECT path, (SELECT count(*) FROM i WHERE i.target = f.path) AS in_degree, (SELECT count(*) FROM i WHERE i.path = f.path AND target IS NOT NULL) AS out_degree, (SELECT count(*) FROM i WHERE i.path = f.path AND target IS NULL) AS unresolved FROM f)
  SELECT path, in_degree, out_degree, unresolved, regexp_replace(path, '/[^/]*$', '') AS region FROM d""",
)
def module_view(t):
    path = F.concat(F.lit("pkg/"), "lang", F.lit("/src/"), "source", F.lit("/"), c("doc_id").cast("string"), F.lit(".ts"))
    modules = t.documents.select("doc_id", path.alias("path"), F.concat(F.lit("pkg/"), "lang").alias("package_path"))
    target = modules.select(c("doc_id").alias("_t"), c("path").alias("resolved_path"))
    imports = modules.withColumn("_t", c("doc_id") * 7 % 1500).join(target, "_t", "left").select("path", "resolved_path")
    return V.module_view(modules.select("path", "package_path"), imports)["node"].select("path", "in_degree", "out_degree", "unresolved", "region")


@query(
    "analysis_stats",
    """WITH n AS (SELECT 'n' || n_nationkey AS project_id FROM nation), a AS (SELECT 'n' || c_nationkey AS p, count(*) AS v FROM customer GROUP BY 1), b AS (SELECT 'n' || s_nationkey AS p, count(*) AS v FROM supplier WHERE s_suppkey % 4 <> 0 GROUP BY 1),
  m AS (SELECT 'n' || (p_partkey % 25) AS p, count(*) AS v FROM part GROUP BY 1), u AS (SELECT 'n' || (o_custkey % 25) AS p, count(*) FILTER (o_orderstatus = 'P') AS v FROM orders GROUP BY 1)
  SELECT project_id, coalesce(a.v, 0) AS files, coalesce(b.v, 0) AS functions, coalesce(m.v, 0) AS models, coalesce(u.v, 0) AS unresolved FROM n LEFT JOIN a ON a.p = project_id LEFT JOIN b ON b.p = project_id LEFT JOIN m ON m.p = project_id LEFT JOIN u ON u.p = project_id""",
)
def analysis_stats(t):
    files = t.customer.select(s("n", c("c_nationkey")).alias("project_id"))
    functions = t.supplier.select(s("n", c("s_nationkey")).alias("project_id"), (c("s_suppkey") % 4 == 0).alias("initializer"))
    models = t.part.select(s("n", c("p_partkey") % 25).alias("project_id"))
    calls = t.orders.select(s("n", c("o_custkey") % 25).alias("project_id"), F.when(c("o_orderstatus") != "P", c("o_orderkey")).alias("target"))
    return V.analysis_stats(files, functions, models, calls)


@query(
    "file_coverage",
    """WITH p AS (SELECT doc_id, max(toxic) AS e FROM labels GROUP BY 1) SELECT CASE WHEN documents.doc_id % 13 = 0 THEN 'skipped' WHEN lang = 'es' THEN 'unsupported' WHEN e IS NULL THEN 'skipped' WHEN e > 0 THEN 'partial' ELSE 'parsed' END AS coverage, count(*) AS n FROM documents LEFT JOIN p ON p.doc_id = documents.doc_id GROUP BY 1""",
)
def file_coverage(t):
    files = t.documents.select(c("doc_id").alias("path"), (c("doc_id") % 13 == 0).alias("generated"), F.when(c("lang") != "es", c("lang")).alias("language"))
    parsed = t.labels.select(c("doc_id").alias("path"), c("toxic").alias("errors"))
    return V.file_coverage(files, parsed).groupBy("coverage").agg(F.count(F.lit(1)).alias("n"))


COMMANDS = """fr AS (SELECT p_partkey AS script, 0 AS seq, 2 * p_partkey + 1 AS target FROM part UNION ALL SELECT p_partkey, 1, 2 * p_partkey + 2 FROM part UNION ALL SELECT p_partkey, 2, CASE WHEN p_partkey % 7 = 0 AND p_partkey > 0 THEN (p_partkey - 1) // 2 END FROM part),
  ok AS (SELECT fr.script, seq, CASE WHEN target IN (SELECT p_partkey FROM part) THEN target END AS target FROM fr),
  cl(script, rank, depth, branch, parent) AS (SELECT 0::BIGINT, 1::BIGINT, 1, 'root', NULL::BIGINT UNION ALL SELECT target, rank + seq + 2, depth + 2, branch || '.' || (seq + 1), cl.script FROM cl JOIN ok ON ok.script = cl.script WHERE seq < 2 AND target IS NOT NULL)"""


def _commands(t):
    p = c("p_partkey")
    known = t.part.select(p.alias("target"), p.alias("_known"))
    third = F.when((p % 7 == 0) & (p > 0), F.floor((p - 1) / 2))
    rows = t.part.select(p.alias("script_id"), F.posexplode(F.array(2 * p + 1, 2 * p + 2, third)).alias("seq", "target"))
    fragments = rows.join(known, "target", "left").select("script_id", "seq", F.lit("run").alias("text"), c("_known").alias("target"))
    return CG.command_closure(t.part.filter("p_partkey = 0").select(p.alias("script_id")), fragments)


@query("command_closure", f"WITH RECURSIVE {COMMANDS} SELECT script AS script_id, rank::INT AS rank, depth, branch FROM cl")
def command_closure(t):
    scripts, _, _ = _commands(t)
    return scripts.select("script_id", "rank", "depth", "branch")


@query(
    "command_cycles",
    f"""WITH RECURSIVE {COMMANDS} SELECT script AS script_id, target FROM ok WHERE seq = 2 AND target IS NOT NULL""",
)
def command_cycles(t):
    _, _, cycles = _commands(t)
    return cycles.select("script_id", "target")


@query("command_fragments", f"WITH RECURSIVE {COMMANDS} SELECT count(*) AS fragments, max(rank + 1 + seq)::INT AS last_rank FROM cl JOIN ok ON ok.script = cl.script")
def command_fragments(t):
    _, placed, _ = _commands(t)
    return placed.agg(F.count(F.lit(1)).alias("fragments"), F.max("rank").alias("last_rank"))


@query(
    "command_targets",
    """WITH f AS (SELECT event_id, user_id % 30 AS pk, CASE event_type WHEN 'view' THEN 'node' WHEN 'click' THEN 'tsc' ELSE 'wrangler' END AS exe, CASE event_type WHEN 'signup' THEN 'dev' WHEN 'purchase' THEN 'd1' WHEN 'error' THEN 'types' END AS sub, CASE WHEN event_id % 2 = 0 THEN 'db' || (user_id % 40) END AS word FROM events),
  ru AS (SELECT s_nationkey AS pk, min(s_suppkey) AS k FROM supplier GROUP BY 1), ra AS (SELECT min(s_suppkey) AS k FROM supplier),
  nm AS (SELECT s_nationkey AS pk, 'db' || (s_suppkey % 40) AS name, min(s_suppkey) AS k FROM supplier GROUP BY ALL), na AS (SELECT 'db' || (s_suppkey % 40) AS name, min(s_suppkey) AS k FROM supplier GROUP BY 1)
  SELECT event_id AS fragment_id, CASE exe WHEN 'node' THEN 'tech:nodejs' ELSE 'tech:typescript' END AS fact_id, CASE exe WHEN 'node' THEN 'starts' ELSE 'uses' END AS kind FROM f WHERE exe <> 'wrangler'
  UNION ALL SELECT event_id, 'rt' || coalesce(ru.k, ra.k), CASE sub WHEN 'dev' THEN 'starts' ELSE 'uses' END FROM f LEFT JOIN ru ON ru.pk = f.pk, ra WHERE sub IN ('dev', 'types')
  UNION ALL SELECT event_id, 'db' || CASE WHEN ru.k IS NOT NULL THEN coalesce(nm.k, ru.k) ELSE coalesce(na.k, ra.k) END, 'uses' FROM f LEFT JOIN ru ON ru.pk = f.pk LEFT JOIN nm ON nm.pk = f.pk AND nm.name = f.word LEFT JOIN na ON na.name = f.word, ra WHERE sub = 'd1'""",
)
def command_targets(t):
    kind = c("event_type")
    fragments = t.events.select(
        c("event_id").alias("fragment_id"), (c("user_id") % 30).alias("package_id"), F.when(kind == "view", "node").when(kind == "click", "tsc").otherwise("wrangler").alias("executable"),
        F.when(kind == "signup", "dev").when(kind == "purchase", "d1").when(kind == "error", "types").alias("subcommand"),
        F.when(c("event_id") % 2 == 0, F.array(F.lit("d1"), F.lit("execute"), F.upper(s("db", c("user_id") % 40)))).otherwise(F.array(F.lit("d1"))).alias("positional"),
    )
    technologies = t.events.select(F.when(kind == "view", "nodejs").when(kind == "click", "typescript").alias("stack_id")).filter("stack_id is not null").distinct().withColumn("fact_id", F.concat(F.lit("tech:"), "stack_id"))
    held = lambda prefix: t.supplier.select(s(prefix, c("s_suppkey")).alias("fact_id"), c("s_nationkey").cast("bigint").alias("package_id"), c("s_suppkey").alias("seq"), s("db", c("s_suppkey") % 40).alias("binding"), F.lit(None).cast("string").alias("database_name"))
    return CG.command_targets(fragments, technologies, held("rt").select("fact_id", "package_id", "seq"), held("db"))


@query(
    "validate_dictionary",
    """WITH cat AS (SELECT lower(replace(n_name, '_', CASE WHEN n_nationkey % 6 = 0 THEN '_' ELSE '-' END)) AS id, CASE WHEN n_nationkey % 4 = 1 THEN 'gone-' || n_regionkey WHEN n_nationkey = 8 THEN 'nation-10' WHEN n_nationkey = 10 THEN 'nation-8' END AS parent_id FROM nation),
  st AS (SELECT 'cust-' || c_custkey AS id, 'nation-' || (c_custkey % 30) AS category_id, 'pkg' || (c_custkey % 1490) AS pkg FROM customer)
  SELECT 'bad-category-id' AS rule, id, NULL AS detail FROM cat WHERE contains(id, '_') UNION ALL SELECT 'missing-parent', id, parent_id FROM cat WHERE parent_id LIKE 'gone%'
  UNION ALL SELECT 'missing-category', id, category_id FROM st WHERE category_id NOT IN (SELECT id FROM cat) UNION ALL SELECT 'package-owned-twice', pkg, count(DISTINCT id)::VARCHAR FROM st GROUP BY pkg HAVING count(DISTINCT id) > 1
  UNION ALL SELECT 'parent-cycle', id, NULL FROM cat WHERE id IN ('nation-8', 'nation-10')""",
)
def validate_dictionary(t):
    n = c("n_nationkey")
    id_ = F.lower(F.when(n % 6 == 0, c("n_name")).otherwise(F.replace("n_name", F.lit("_"), F.lit("-"))))
    none = F.array().cast("array<string>")
    parent = F.when(n % 4 == 1, s("gone-", c("n_regionkey"))).when(n == 8, "nation-10").when(n == 10, "nation-8")
    categories = t.nation.select(id_.alias("id"), parent.alias("parent_id"), none.alias("related_ids"))
    stacks = t.customer.select(s("cust-", c("c_custkey")).alias("id"), s("nation-", c("c_custkey") % 30).alias("category_id"), none.alias("aliases"), F.array(s("Pkg", c("c_custkey") % 1490)).alias("package_names"), none.alias("related_ids"))
    return Q.validate_dictionary(categories, stacks)


@query(
    "validate_visual_groups",
    """WITH g AS (SELECT 'g' || n_regionkey AS id, CASE WHEN n_regionkey = 3 THEN 'top' WHEN n_regionkey % 2 = 0 THEN 'left' ELSE 'right' END AS side, n_regionkey % 4 AS o FROM nation GROUP BY n_regionkey),
  l AS (SELECT 'g' || n_regionkey AS grp, 'c' || CASE WHEN n_nationkey = 24 THEN 0 WHEN n_nationkey = 23 THEN 99 ELSE n_nationkey END AS id FROM nation WHERE n_nationkey <> 5)
  SELECT 'bad-side' AS rule, id, side AS detail FROM g WHERE side = 'top' UNION ALL SELECT 'bad-order', id, o::VARCHAR FROM g WHERE o < 1 UNION ALL SELECT 'duplicate-order', side, o::VARCHAR FROM (SELECT side, o FROM g GROUP BY ALL HAVING count(*) > 1)
  UNION ALL SELECT 'unknown-root', grp, id FROM l WHERE id = 'c99' UNION ALL SELECT 'not-a-root', grp, id FROM l WHERE id IN ('c7', 'c14') UNION ALL SELECT 'root-in-several-groups', id, count(*)::VARCHAR FROM l GROUP BY id HAVING count(*) > 1
  UNION ALL SELECT 'root-without-group', 'c' || n_nationkey, NULL FROM nation WHERE n_nationkey IN (5, 23, 24)""",
)
def validate_visual_groups(t):
    n, r = c("n_nationkey"), c("n_regionkey")
    member = F.when(n != 5, s("c", F.when(n == 24, 0).when(n == 23, 99).otherwise(n)))
    groups = t.nation.groupBy(r.alias("k")).agg(F.array_compact(F.collect_list(member)).alias("root_ids")).select(
        s("g", c("k")).alias("id"), F.when(c("k") == 3, "top").when(c("k") % 2 == 0, "left").otherwise("right").alias("side"), (c("k") % 4).alias("order"), "root_ids"
    )
    categories = t.nation.select(s("c", n).alias("id"), F.when(n.isin(7, 14), "c0").alias("parent_id"))
    return Q.validate_visual_groups(groups, categories)
