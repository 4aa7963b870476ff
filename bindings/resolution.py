"""Resolution joins: owners, dictionaries, routes, references, versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import names as N
from corpusloom.operators import lookups as L
from corpusloom.operators import owners as O
from corpusloom.operators import windows as W

from .registry import PAGES, page_paths, query, s, sized

c = F.col

# Owners: every host, and every host/language folder.
_PLACES = r"""own AS (SELECT DISTINCT split_part(path, '/', 1) AS owner_path FROM pg
  UNION SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM pg)"""


def _places(t):
    parts = F.split("path", "/")
    hosts = page_paths(t).select(F.get(parts, F.lit(0)).alias("owner_path"))
    folders = page_paths(t).select(F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))).alias("owner_path"))
    return hosts.unionByName(folders).distinct().withColumn("owner", F.concat(F.lit("own:"), c("owner_path")))


@query(
    "nearest_owner",
    f"""WITH {PAGES}, {_PLACES} SELECT page_id, (SELECT 'own:' || owner_path FROM own WHERE starts_with(path, owner_path || '/')
  ORDER BY length(owner_path) DESC LIMIT 1) AS owner FROM pg""",
)
def nearest_owner(t):
    return O.nearest_owner(page_paths(t), _places(t)).select("page_id", "owner")


@query(
    "region_nesting",
    f"""WITH {PAGES}, {_PLACES}, r AS (SELECT owner_path AS path FROM own UNION SELECT DISTINCT path FROM pg)
  SELECT path, (SELECT 'own:' || p.path FROM r p WHERE starts_with(r.path, p.path || '/') ORDER BY length(p.path) DESC LIMIT 1) AS parent_id FROM r""",
)
def region_nesting(t):
    paths = _places(t).select(c("owner_path").alias("path")).union(page_paths(t).select("path")).distinct()
    return O.region_nesting(paths.withColumn("id", F.concat(F.lit("own:"), c("path")))).select("path", "parent_id")


@query(
    "pattern_root",
    rf"""WITH {PAGES}, x AS (SELECT page_id, path, unnest([path, regexp_replace(path, '/[^/]+$', ''), regexp_replace(path, '/[^/]+/[^/]+$', '')]) AS a FROM pg),
  f AS (SELECT *, CASE WHEN regexp_full_match(a, '[^/]*/en') THEN abs(length(a) - length(replace(a, '/', '')) + 1 - 2)
    WHEN regexp_full_match(a, '[^/]*\.net/[^/]*/[^/]*') THEN abs(length(a) - length(replace(a, '/', '')) + 1 - 3) END AS gap FROM x)
  SELECT page_id, arg_min(a, (gap, -length(a))) FILTER (gap IS NOT NULL AND NOT regexp_full_match(a, '[^/]*\.net/de/[^/]*')) AS root FROM f GROUP BY page_id""",
)
def pattern_root(t):
    patterns = t.region.select(
        F.element_at(F.array(F.lit("*/en"), F.lit("*.net/*/*"), F.lit("!*.net/de/*")), F.least(c("r_regionkey") + 1, F.lit(3))).alias("pattern")
    ).distinct()
    return O.pattern_root(page_paths(t), patterns).select("page_id", "root")


@query(
    "common_ancestor",
    rf"""WITH {PAGES}, g AS (SELECT split_part(path, '/', 1) || CASE WHEN page_id % 2 = 0 THEN '/a' ELSE '/b' END AS "group", string_split(path, '/') AS p FROM pg),
  k AS (SELECT "group", count(*) AS n FROM g GROUP BY 1),
  x AS (SELECT "group", unnest(list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[1:i], '/'))) AS prefix FROM g),
  y AS (SELECT x."group", prefix FROM x JOIN k ON k."group" = x."group" GROUP BY x."group", prefix, n HAVING count(*) = n)
  SELECT "group", arg_max(prefix, length(prefix)) AS ancestor FROM y GROUP BY 1""",
)
def common_ancestor(t):
    half = F.when(c("page_id") % 2 == 0, "/a").otherwise("/b")
    return O.common_ancestor(page_paths(t).withColumn("group", F.concat(F.get(F.split("path", "/"), F.lit(0)), half)))


@query(
    "inherit_definition",
    """WITH d AS (SELECT n_nationkey FROM nation WHERE n_nationkey % 3 = 0), p AS (SELECT r_regionkey, r_name FROM region WHERE r_regionkey < 3)
  SELECT s_suppkey AS id, CASE WHEN s_nationkey % 3 = 0 THEN 'n' || s_nationkey WHEN n_regionkey < 3 THEN 'r' || n_regionkey END AS definition_id,
  CASE WHEN s_nationkey % 3 = 0 THEN 'parent' WHEN n_regionkey < 3 THEN 'path' ELSE 'undetermined' END AS definition_basis
  FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
)
def inherit_definition(t):
    placed = t.supplier.join(t.nation, c("n_nationkey") == c("s_nationkey")).join(t.region, c("r_regionkey") == c("n_regionkey"))
    entities = placed.select(c("s_suppkey").alias("id"), F.concat_ws("/", "r_name", "n_name", "s_name").alias("path"), "s_nationkey")
    chain = entities.select("id", s("n", c("s_nationkey")).alias("ancestor"), F.lit(1).alias("distance"))
    nations = t.nation.filter("n_nationkey % 3 = 0").select(s("n", c("n_nationkey")).alias("id"), F.concat(F.lit("-/"), "n_name").alias("path"))
    regions = t.region.filter("r_regionkey < 3").select(s("r", c("r_regionkey")).alias("id"), c("r_name").alias("path"))
    return O.inherit_definition(entities, chain, nations.unionByName(regions)).select("id", "definition_id", "definition_basis")


@query(
    "unique_lookup",
    """WITH d AS (SELECT p_brand, p_type, p_size, CASE WHEN count(DISTINCT p_name) = 1 THEN min(p_name) END AS owner FROM part GROUP BY ALL)
  SELECT p_partkey, owner FROM part JOIN d USING (p_brand, p_type, p_size)""",
)
def unique_lookup(t):
    return L.unique_lookup(t.part, t.part.withColumnRenamed("p_name", "owner"), ["p_brand", "p_type", "p_size"]).select("p_partkey", "owner")


@query(
    "dictionary_keys",
    """WITH x AS (SELECT p_partkey AS owner, unnest([p_name, p_brand || ' ' || p_type]) AS raw FROM part)
  SELECT lower(trim(raw)) AS key, count(DISTINCT owner) AS owners FROM x GROUP BY 1""",
)
def dictionary_keys(t):
    entries = t.part.select(c("p_partkey").alias("id"), F.array("p_name").alias("packages"), F.array(F.concat_ws(" ", "p_brand", "p_type")).alias("aliases"))
    return L.dictionary_keys(entries, "packages", "aliases").groupBy("key").agg(F.count_distinct("owner").alias("owners"))


@query(
    "resolve_dependencies",
    """WITH dep AS (SELECT p_name AS name, CASE WHEN l_quantity > 25 THEN 'workspace:*' ELSE '^1' END AS version_range FROM lineitem JOIN part ON p_partkey = l_partkey),
  loc AS (SELECT p_name AS name, 'pkg:' || min(p_partkey) AS id FROM part WHERE p_name LIKE 'red%' GROUP BY 1),
  tech AS (SELECT DISTINCT lower(p_name) AS key, 'tech:' || lower(p_name) AS owner FROM part WHERE p_name LIKE '%ring')
  SELECT target, target_kind, unmatched_workspace, count(*) AS n FROM (SELECT
    CASE WHEN loc.id IS NOT NULL AND version_range LIKE 'workspace:%' THEN loc.id ELSE coalesce(owner, dep.name) END AS target,
    CASE WHEN loc.id IS NOT NULL AND version_range LIKE 'workspace:%' THEN 'workspace-package' WHEN owner IS NOT NULL THEN 'technology' ELSE 'external-package' END AS target_kind,
    version_range LIKE 'workspace:%' AND loc.id IS NULL AS unmatched_workspace
  FROM dep LEFT JOIN loc ON loc.name = dep.name LEFT JOIN tech ON key = lower(dep.name)) GROUP BY ALL""",
)
def resolve_dependencies(t):
    named = t.lineitem.join(t.part, c("p_partkey") == c("l_partkey"))
    dependencies = named.select(c("p_name").alias("name"), F.when(c("l_quantity") > 25, "workspace:*").otherwise("^1").alias("version_range"))
    packages = t.part.filter(c("p_name").startswith("red")).groupBy(c("p_name").alias("name")).agg(s("pkg:", F.min("p_partkey")).alias("package_id"))
    known = t.part.filter(c("p_name").endswith("ring")).select(F.lower("p_name").alias("key"), F.concat(F.lit("tech:"), F.lower("p_name")).alias("owner")).distinct()
    resolved = L.resolve_dependencies(dependencies, packages, known)
    return resolved.groupBy("target", "target_kind", "unmatched_workspace").agg(F.count(F.lit(1)).alias("n"))


_ROUTE = r"regexp_replace(regexp_replace(split_part(regexp_replace(regexp_replace({0}, '^https?://[^/]+', ''), '\$\{{[^}}]*\}}', ':param', 'g'), '?', 1), ':\w+', ':param', 'g'), '/$', '')"


@query("normalize_route", f"SELECT page_id, {_ROUTE.format('url')} AS route FROM pages")
def normalize_route(t):
    return t.pages.select("page_id", N.normalize_route("url").alias("route"))


@query(
    "match_routes",
    f"""WITH r AS (SELECT event_id AS id, '/' || CASE event_type WHEN 'view' THEN 'en' WHEN 'click' THEN 'de' ELSE 'fr' END || '/' || (event_id % 1000) || '?x=1' AS address,
    CASE WHEN user_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method FROM events),
  ep AS (SELECT 'page' || page_id AS eid, {_ROUTE.format('url')} AS route, CASE WHEN page_id % 3 = 0 THEN 'ANY' WHEN page_id % 3 = 1 THEN 'GET' ELSE 'POST' END AS method FROM pages),
  x AS (SELECT r.id, count(DISTINCT eid) AS n, min(eid) AS eid FROM r JOIN ep ON ep.route = {_ROUTE.format('r.address')} AND (ep.method = r.method OR ep.method = 'ANY') GROUP BY r.id)
  SELECT r.id, CASE WHEN n = 1 THEN eid END AS endpoint_id, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS match
  FROM r LEFT JOIN x ON x.id = r.id""",
)
def match_routes(t):
    language = F.when(c("event_type") == "view", "en").when(c("event_type") == "click", "de").otherwise("fr")
    asked = t.events.select(
        c("event_id").alias("id"),
        F.concat(F.lit("/"), language, F.lit("/"), (c("event_id") % 1000).cast("string"), F.lit("?x=1")).alias("address"),
        F.when(c("user_id") % 2 == 0, "GET").otherwise("POST").alias("method"),
    )
    method = F.when(c("page_id") % 3 == 0, "ANY").when(c("page_id") % 3 == 1, "GET").otherwise("POST")
    served = t.pages.select(s("page", c("page_id")).alias("id"), c("url").alias("address"), method.alias("method"))
    return L.match_routes(asked, served).select("id", "endpoint_id", "match")


@query(
    "resolve_references",
    """WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_type AS path, upper(p_name) AS reference FROM lineitem JOIN part ON p_partkey = l_partkey),
  m AS (SELECT 'm' || p_partkey AS id, p_name AS label, p_type AS path FROM part),
  l AS (SELECT lower(label) AS key, path, min(id) AS lo, max(id) AS hi FROM m GROUP BY ALL), g AS (SELECT lower(label) AS key, min(id) AS lo, max(id) AS hi FROM m GROUP BY ALL)
  SELECT f.path, reference, CASE WHEN l.lo = l.hi THEN l.lo WHEN g.lo = g.hi THEN g.lo END AS target,
  CASE WHEN l.lo = l.hi THEN 'source' WHEN g.lo = g.hi THEN 'inferred' ELSE 'unresolved' END AS confidence,
  CASE WHEN g.lo IS NULL THEN 'missing' WHEN NOT coalesce(l.lo = l.hi, FALSE) AND g.lo <> g.hi THEN 'ambiguous' END AS reason, count(*) AS n
  FROM f LEFT JOIN l ON l.key = lower(reference) AND l.path = f.path LEFT JOIN g ON g.key = lower(reference) GROUP BY ALL""",
)
def resolve_references(t):
    fields = t.lineitem.join(t.part, c("p_partkey") == c("l_partkey")).select(c("p_type").alias("path"), F.upper("p_name").alias("reference"))
    models = t.part.select(s("m", c("p_partkey")).alias("id"), c("p_name").alias("label"), c("p_type").alias("path"))
    return L.resolve_references(fields, models).groupBy("path", "reference", "target", "confidence", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "db_edges",
    """WITH k AS (SELECT event_id AS id, CASE event_type WHEN 'purchase' THEN 'insert' WHEN 'signup' THEN 'create' ELSE 'find' END AS verb, user_id % 25 AS n FROM events),
  x AS (SELECT CASE WHEN verb IN ('insert', 'create') THEN 'writes' ELSE 'reads' END AS kind, n_name, id FROM k JOIN nation ON n_nationkey = n
  UNION ALL SELECT CASE WHEN verb IN ('insert', 'create') THEN 'writes' ELSE 'reads' END, n_name, id FROM k JOIN nation ON n_nationkey = (n + 1) % 25)
  SELECT kind, CASE WHEN kind = 'writes' THEN 'call' ELSE n_name END AS source, CASE WHEN kind = 'writes' THEN n_name ELSE 'call' END AS target, count(*) AS n FROM x GROUP BY ALL""",
)
def db_edges(t):
    verb = F.when(c("event_type") == "purchase", "insert").when(c("event_type") == "signup", "create").otherwise("find")
    called = t.events.join(t.nation, c("n_nationkey") == c("user_id") % 25)
    second = t.nation.select(((c("n_nationkey") + 24) % 25).alias("_k"), c("n_name").alias("_argument"))
    called = called.join(second, c("_k") == c("user_id") % 25)
    calls = called.select(s("call:", c("event_id")).alias("id"), F.concat(F.lit("db."), F.lower("n_name"), F.lit("."), verb).alias("callee"), F.array("_argument").alias("names"))
    models = t.nation.select(c("n_name").alias("id"), c("n_name").alias("label"))
    name = lambda end: F.regexp_replace(end, "^call:.*", "call")
    return L.db_edges(calls, models).groupBy("kind", name("src").alias("source"), name("dst").alias("target")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "link_types",
    """WITH v AS (SELECT 'v' || event_id AS id, event_type AS symbol FROM events), m AS (SELECT DISTINCT 'm:' || event_type AS id, event_type AS symbol FROM events),
  p AS (SELECT v.id AS value, m.id AS model FROM v JOIN m USING (symbol))
  SELECT left(id, 1) AS side, link, count(*) AS n, count(DISTINCT linked) AS linked FROM
  (SELECT value AS id, model AS linked, 'type' AS link FROM p UNION ALL SELECT model, value, 'value' FROM p) GROUP BY ALL""",
)
def link_types(t):
    values = t.events.select(s("v", c("event_id")).alias("id"), c("event_type").alias("symbol"))
    models = t.events.select(F.concat(F.lit("m:"), "event_type").alias("id"), c("event_type").alias("symbol")).distinct()
    links = L.link_types(values, models)
    return links.groupBy(F.substring("id", 1, 1).alias("side"), "link").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("linked").alias("linked"))


@query(
    "resolve_script",
    """WITH f AS (SELECT event_id, 'n' || (user_id % 30) AS package_id, CASE WHEN event_type = 'view' THEN 'NATION_' || (event_id % 30) WHEN event_type = 'click' THEN './path/' || (event_id % 30) END AS selector,
    CASE WHEN event_id % 2 = 0 THEN 'build' ELSE 'test' END AS script_name FROM events),
  p AS (SELECT 'n' || n_nationkey AS package_id, n_name AS name, 'path/' || n_nationkey AS package_path FROM nation),
  x AS (SELECT event_id, script_name, CASE WHEN selector IS NULL THEN f.package_id ELSE coalesce(a.package_id, b.package_id) END AS target
    FROM f LEFT JOIN p a ON a.name = selector LEFT JOIN p b ON b.package_path = regexp_replace(selector, '^\\./', ''))
  SELECT event_id, CASE WHEN script_name = 'build' AND target IN (SELECT package_id FROM p) THEN target || ':build' END AS script_id FROM x""".replace("\\\\", "\\"),
)
def resolve_script(t):
    selector = F.when(c("event_type") == "view", s("NATION_", c("event_id") % 30)).when(c("event_type") == "click", s("./path/", c("event_id") % 30))
    fragments = t.events.select("event_id", s("n", c("user_id") % 30).alias("package_id"), selector.alias("selector"), F.when(c("event_id") % 2 == 0, "build").otherwise("test").alias("script_name"))
    packages = t.nation.select(s("n", c("n_nationkey")).alias("package_id"), c("n_name").alias("name"), s("path/", c("n_nationkey")).alias("package_path"))
    scripts = packages.select("package_id", F.lit("build").alias("name"), F.concat("package_id", F.lit(":build")).alias("script_id"))
    return L.resolve_script(fragments, packages, scripts).select("event_id", "script_id")


@query(
    "navigation_context",
    """WITH q AS (SELECT o_orderkey AS id, o_custkey AS owner FROM orders),
  nd AS (SELECT 'o' || o_orderkey AS id, 'c' || o_custkey AS owner FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer WHERE c_custkey % 2 = 0),
  tg AS (SELECT 'o' || o_orderkey AS id, 'c' || o_custkey AS owner FROM orders UNION ALL SELECT 'c' || c_custkey, NULL FROM customer UNION ALL SELECT 'n' || n_nationkey, NULL FROM nation),
  own AS (SELECT owner AS id, count(DISTINCT id) AS n, min(id) AS m FROM nd GROUP BY owner), g AS (SELECT 'c' || c_custkey AS id, 'grp:' || c_mktsegment AS m FROM customer)
  SELECT tg.id, CASE WHEN a.id IS NOT NULL THEN 'direct' WHEN b.id IS NOT NULL THEN 'owner' WHEN own.n = 1 THEN 'owned' WHEN own.n > 1 THEN 'members' WHEN g.m IS NOT NULL THEN 'group' ELSE 'search' END AS context,
  CASE WHEN a.id IS NOT NULL THEN a.id WHEN b.id IS NOT NULL THEN b.id WHEN own.n = 1 THEN own.m WHEN own.n > 1 THEN NULL WHEN g.m IS NOT NULL THEN g.m END AS match,
  CASE WHEN a.id IS NOT NULL OR b.id IS NOT NULL THEN 1 WHEN own.n IS NOT NULL THEN own.n WHEN g.m IS NOT NULL THEN 1 ELSE 0 END::BIGINT AS candidates
  FROM tg LEFT JOIN nd a ON a.id = tg.id LEFT JOIN nd b ON b.id = tg.owner LEFT JOIN own ON own.id = tg.id LEFT JOIN g ON g.id = tg.id""",
)
def navigation_context(t):
    customer = s("c", c("c_custkey"))
    order_owner = s("c", c("o_custkey")).alias("owner")
    none = F.lit(None).cast("array<string>").alias("members")
    held = t.orders.filter("o_orderkey % 3 = 0").select(s("o", c("o_orderkey")).alias("id"), order_owner, none)
    held = held.unionByName(t.customer.filter("c_custkey % 2 = 0").select(customer.alias("id"), s("n", c("c_nationkey")).alias("owner"), none))
    # One group row per listed customer keeps the group lists short.
    groups = t.customer.select(F.concat(F.lit("grp:"), "c_mktsegment").alias("id"), F.lit(None).cast("string").alias("owner"), F.array(customer).alias("members"))
    nobody = F.lit(None).cast("string").alias("owner")
    targets = t.orders.select(s("o", c("o_orderkey")).alias("id"), order_owner)
    targets = targets.unionByName(t.customer.select(customer.alias("id"), nobody)).unionByName(t.nation.select(s("n", c("n_nationkey")).alias("id"), nobody))
    return L.navigation_context(held.unionByName(groups), targets)


@query(
    "resolve_identity",
    """WITH x AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'D1' WHEN 'O' THEN 'R2' ELSE 'Queue' END AS type, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE 'acc' || (o_custkey % 3) END AS account,
    CASE WHEN o_orderkey % 10 = 0 THEN '****' ELSE 'db' || (o_custkey % 50) END AS identifier FROM orders),
  k AS (SELECT *, CASE WHEN identifier <> '****' AND (type = 'D1' OR (type = 'R2' AND account <> '')) THEN to_json([type, CASE WHEN account <> '' THEN account ELSE 'stable-id' END, identifier])::VARCHAR END AS key FROM x)
  SELECT coalesce(key, 'occurrence:' || id) AS entity, CASE WHEN key IS NULL THEN 'unconfirmed' ELSE 'confirmed' END AS status, count(*) AS configurations FROM k GROUP BY ALL""",
)
def resolve_identity(t):
    rows = t.orders.select(
        c("o_orderkey").alias("id"),
        F.when(c("o_orderstatus") == "F", "D1").when(c("o_orderstatus") == "O", "R2").otherwise("Queue").alias("type"),
        F.when(c("o_custkey") % 3 == 0, "").otherwise(s("acc", c("o_custkey") % 3)).alias("account"),
        F.when(c("o_orderkey") % 10 == 0, "****").otherwise(s("db", c("o_custkey") % 50)).alias("identifier"),
    )
    key = L.resource_identity_key(c("type"), c("account"), c("identifier"))
    return L.resolve_identity(rows, key).groupBy("entity", "status").agg(F.count(F.lit(1)).alias("configurations"))


@query(
    "detect_technologies",
    r"""WITH f AS (SELECT source || '/' || doc_id || CASE WHEN lang = 'en' THEN '.py' WHEN lang = 'fr' THEN '.rs' ELSE '.txt' END AS path, doc_id, lang, source FROM documents),
  x AS (SELECT path, CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'rust' END AS stack_id, 'extension' AS channel FROM f WHERE lang IN ('en', 'fr')
  UNION ALL SELECT path, 'lib-' || source, 'import' FROM f WHERE source IN ('src1', 'src2', 'src3')
  UNION ALL SELECT path, 'dep-' || lang, 'dependency' FROM f WHERE lang IN ('de', 'es'))
  SELECT stack_id, channel, count(*) AS files FROM (SELECT DISTINCT * FROM x) GROUP BY ALL""",
)
def detect_technologies(t):
    suffix = F.when(c("lang") == "en", ".py").when(c("lang") == "fr", ".rs").otherwise(".txt")
    docs = t.documents.select("doc_id", "lang", "source", F.concat("source", F.lit("/"), c("doc_id").cast("string"), suffix).alias("path"), suffix.alias("extension"))
    files = docs.select("path", "extension", F.element_at(F.split("path", "/"), -1).alias("name"))
    ecosystem = F.lit("pypi").alias("ecosystem")
    imports = docs.select("path", ecosystem, F.concat("source", F.lit(".deep.part")).alias("specifier"))
    used = docs.select("path", ecosystem, F.concat(F.lit("Dep_"), "lang").alias("name"))
    languages = t.documents.select("lang").distinct()
    sources = t.documents.select("source").distinct()

    def entry(frame, stack, identifier, channel):
        return frame.select(stack.alias("stack_id"), ecosystem, identifier.alias("identifier"), F.lit(channel).alias("channel"))

    registry = (
        entry(languages.filter("lang = 'en'"), F.lit("python"), F.lit(".py"), "extension")
        .unionByName(entry(languages.filter("lang = 'fr'"), F.lit("rust"), F.lit(".rs"), "extension"))
        .unionByName(entry(sources.filter("source in ('src1', 'src2', 'src3')"), F.concat(F.lit("lib-"), "source"), c("source"), "import"))
        .unionByName(entry(languages.filter("lang in ('de', 'es')"), F.concat(F.lit("dep-"), "lang"), F.concat(F.lit("dep-"), "lang"), "dependency"))
    )
    found = L.detect_technologies(registry, files=files, imports=imports, dependencies=used)
    return found.groupBy("stack_id", "channel").agg(F.count(F.lit(1)).alias("files"))


@query(
    "match_members",
    rf"""WITH {PAGES}, p AS (SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS path FROM pg),
  r AS (SELECT unnest(['*.net/*', 'blog.*/en', '!blog.*/de', 'none/*']) AS pattern)
  SELECT path AS item, 'member' AS outcome FROM p WHERE (regexp_full_match(path, '[^/]*\.net/[^/]*') OR regexp_full_match(path, 'blog\.[^/]*/en')) AND NOT regexp_full_match(path, 'blog\.[^/]*/de')
  UNION ALL SELECT 'none/*', 'unmatched pattern'""",
)
def match_members(t):
    parts = F.split("path", "/")
    packages = page_paths(t).select(F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))).alias("path")).distinct()
    globs = F.array(F.lit("*.net/*"), F.lit("blog.*/en"), F.lit("!blog.*/de"), F.lit("none/*"))
    patterns = t.region.filter("r_regionkey < 4").select(F.element_at(globs, c("r_regionkey") + 1).alias("pattern"))
    members, unmatched = L.match_members(patterns, packages)
    return members.select(c("path").alias("item"), F.lit("member").alias("outcome")).unionByName(
        unmatched.select(c("pattern").alias("item"), F.lit("unmatched pattern").alias("outcome"))
    )


@query(
    "lock_versions",
    """WITH d AS (SELECT DISTINCT 'r' || n_regionkey || '/n' || c_nationkey AS project_dir, n_nationkey % 3 <> 0 AS member, 'Part_' || l_partkey AS name FROM lineitem JOIN orders ON o_orderkey = l_orderkey
    JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
  k AS (SELECT 'r' || n_regionkey || CASE WHEN n_nationkey % 2 = 0 THEN '/n' || n_nationkey ELSE '' END AS lock_dir, 'part-' || l_partkey AS name,
    CASE WHEN l_partkey % 50 = 0 THEN 'latest' ELSE '1.' || (l_suppkey % 2) || '.0' END AS version FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
  h AS (SELECT d.project_dir, d.name, k.lock_dir, min(version) AS v0, max(version) AS v1, bool_or(version = 'latest') AS bad FROM d JOIN k
    ON k.name = lower(replace(d.name, '_', '-')) AND (k.lock_dir = d.project_dir OR d.member AND k.lock_dir = split_part(d.project_dir, '/', 1)) GROUP BY ALL),
  b AS (SELECT project_dir, name, arg_max(struct_pack(lock_dir := lock_dir, v0 := v0, v1 := v1, bad := bad), length(lock_dir)) AS l FROM h GROUP BY ALL)
  SELECT d.project_dir, d.name, l.lock_dir AS lock_dir, CASE WHEN l IS NULL THEN 'unlocked' WHEN l.bad THEN 'unsupported' WHEN l.v0 <> l.v1 THEN 'ambiguous' ELSE 'resolved' END AS status,
  CASE WHEN NOT l.bad AND l.v0 = l.v1 THEN l.v0 END AS resolved_version FROM d LEFT JOIN b USING (project_dir, name)""",
)
def lock_versions(t):
    buyers = t.lineitem.join(t.orders, c("o_orderkey") == c("l_orderkey")).join(t.customer, c("c_custkey") == c("o_custkey")).join(t.nation, c("n_nationkey") == c("c_nationkey"))
    dependencies = buyers.select(
        s("r", c("n_regionkey"), "/n", c("c_nationkey")).alias("project_dir"), s("Part_", c("l_partkey")).alias("name"),
        F.lit("pypi").alias("ecosystem"), F.lit("*").alias("version_range"),
    ).distinct()
    sellers = t.lineitem.join(t.supplier, c("s_suppkey") == c("l_suppkey")).join(t.nation, c("n_nationkey") == c("s_nationkey"))
    none = F.lit(None).cast("string")
    own = F.when(c("n_nationkey") % 2 == 0, s("/n", c("n_nationkey"))).otherwise("")
    locks = sellers.select(
        F.concat(s("r", c("n_regionkey")), own).alias("lock_dir"), F.lit("pypi").alias("ecosystem"), s("part-", c("l_partkey")).alias("name"),
        F.when(c("l_partkey") % 50 == 0, "latest").otherwise(s("1.", c("l_suppkey") % 2, ".0")).alias("version"),
        none.alias("descriptor"), none.alias("source_identity"), none.alias("framework"),
    )
    # The root of a region lists two thirds of its nations as members; the others only take their own lock.
    listed = t.nation.filter(c("n_nationkey") % 3 != 0)
    members = listed.select(s("r", c("n_regionkey")).alias("lock_dir"), F.lit("pypi").alias("ecosystem"), s("r", c("n_regionkey"), "/n", c("n_nationkey")).alias("project_dir"))
    return L.resolve_versions(dependencies, locks, members).select("project_dir", "name", "lock_dir", "status", "resolved_version")


@query(
    "lock_importers",
    """WITH d AS (SELECT DISTINCT 'n' || c_nationkey AS project_dir, 'p' || l_partkey AS name FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey),
  k AS (SELECT DISTINCT 'p' || l_partkey AS name, '1.' || (l_suppkey % 3) || '.0' AS version FROM lineitem),
  a AS (SELECT DISTINCT 'n' || c_nationkey AS project_dir, 'p' || l_partkey AS name, CASE WHEN l_partkey % 3 > 0 THEN '1.' || (l_suppkey % 3) || '.0' END AS version
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_nationkey % 4 > 0 AND l_returnflag <> 'R'),
  h AS (SELECT d.project_dir, d.name, min(k.version) AS v0, max(k.version) AS v1 FROM d JOIN k USING (name)
    WHERE d.project_dir NOT IN (SELECT project_dir FROM a) OR EXISTS (SELECT 1 FROM a WHERE a.project_dir = d.project_dir AND a.name = d.name AND (a.version IS NULL OR a.version = k.version)) GROUP BY ALL)
  SELECT d.project_dir, d.name, CASE WHEN v0 IS NULL THEN 'unlocked' WHEN v0 <> v1 THEN 'ambiguous' ELSE 'resolved' END AS status, CASE WHEN v0 = v1 THEN v0 END AS resolved_version FROM d LEFT JOIN h USING (project_dir, name)""",
)
def lock_importers(t):
    """Nations are projects of one workspace, parts its packages; what a nation asks for in the lock decides among their versions."""
    t = sized(t, "lineitem")
    buyers = t.lineitem.join(t.orders, c("o_orderkey") == c("l_orderkey")).join(t.customer, c("c_custkey") == c("o_custkey"))
    project, part, version = s("n", c("c_nationkey")), s("p", c("l_partkey")), s("1.", c("l_suppkey") % 3, ".0")
    dependencies = buyers.select(project.alias("project_dir"), project.alias("project_name"), part.alias("name"), F.lit("cargo").alias("ecosystem"), F.lit("*").alias("version_range")).distinct()
    none, place = F.lit(None).cast("string"), {"lock_dir": F.lit("."), "ecosystem": F.lit("cargo")}
    asking = buyers.filter((c("c_nationkey") % 4 > 0) & (c("l_returnflag") != "R"))
    asks = asking.select(project.alias("owner"), part.alias("name"), F.when(c("l_partkey") % 3 > 0, version).alias("version"), none.alias("source_identity")).distinct().withColumns(place)
    packages = t.lineitem.select(part.alias("name"), version.alias("version"), F.lit("registry").alias("source_identity"))
    own = asking.select(project.alias("name"), F.lit("0.1.0").alias("version"), none.alias("source_identity"))
    locks = packages.unionByName(own).distinct().withColumns({**place, "descriptor": none, "framework": none, "importer": none})
    members = t.nation.select(F.lit(".").alias("lock_dir"), F.lit("cargo").alias("ecosystem"), s("n", c("n_nationkey")).alias("project_dir"))
    return L.resolve_versions(dependencies, locks, members, asks=asks).select("project_dir", "name", "status", "resolved_version")


@query(
    "short_labels",
    rf"""WITH {PAGES}, q AS (SELECT DISTINCT path, string_split(path, '/') AS p FROM pg),
  x AS (SELECT path, unnest(list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[len(p) - i + 1:], '/'))) AS suffix FROM q),
  y AS (SELECT path, suffix, count(*) OVER (PARTITION BY suffix) AS n FROM x),
  z AS (SELECT path, coalesce(arg_min(suffix, length(suffix)) FILTER (n = 1), path) AS l FROM y GROUP BY path)
  SELECT path, l AS label FROM z""",
)
def short_labels(t):
    return W.short_labels(page_paths(t).select("path").distinct())


@query(
    "distinct_titles",
    """WITH k AS (SELECT *, count(*) OVER (PARTITION BY p_name, p_brand) AS n FROM part) SELECT p_partkey, CASE WHEN n > 1 THEN p_name || ' · ' || p_type || '/' || p_size ELSE p_name END AS display FROM k""",
)
def distinct_titles(t):
    return W.distinct_titles(t.part, "p_name", ["p_brand"], s(c("p_type"), "/", c("p_size"))).select("p_partkey", "display")


@query(
    "best_per_key",
    """SELECT l_orderkey, arg_min(l_partkey, (-l_quantity, l_linenumber, l_partkey, l_suppkey)) AS l_partkey, bool_or(l_returnflag = 'R') AS returned FROM lineitem GROUP BY l_orderkey""",
)
def best_per_key(t):
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", (c("l_returnflag") == "R").alias("returned"))
    order = [-c("l_quantity"), c("l_linenumber"), c("l_partkey"), c("l_suppkey")]
    return W.best_per_key(lines, ["l_orderkey"], order, flags=["returned"]).select("l_orderkey", "l_partkey", "returned")


@query(
    "edge_slots",
    """WITH e AS (SELECT l_suppkey % 20 AS src, l_partkey % 20 AS dst, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem),
  w AS (SELECT *, row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS slot,
    count(*) OVER (PARTITION BY least(src, dst), greatest(src, dst)) AS slots FROM e)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, slot, slots FROM w""",
)
def edge_slots(t):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    pairs = t.lineitem.select((c("l_suppkey") % 20).alias("src"), (c("l_partkey") % 20).alias("dst"), *keys)
    return W.edge_slots(pairs, order=keys).select(*keys, "slot", "slots")


@query("lanes", "SELECT user_id, event_type, min(event_id) AS lane_rank, count(*) AS steps FROM events GROUP BY ALL")
def lanes(t):
    return W.lanes(t.events, ["user_id", "event_type"], rank="event_id")


@query(
    "first_last_command",
    "SELECT user_id, arg_min(event_type, (ts, event_id)) AS first, arg_max(event_type, (ts, event_id)) AS last, count(*) AS n FROM events GROUP BY user_id",
)
def first_last_command(t):
    return W.first_and_last(t.events, ["user_id"], ["ts", "event_id"], "event_type")


@query(
    "preview_list",
    """WITH w AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position, count(*) OVER (PARTITION BY user_id) AS total FROM events)
  SELECT *, greatest(total - 6, 0) AS remaining FROM w WHERE position <= 6""",
)
def preview_list(t):
    return W.preview(t.events.select("user_id", "event_id"), ["user_id"], ["event_id"])
