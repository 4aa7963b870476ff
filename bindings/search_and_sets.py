"""Ranked search and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import search as S
from corpusloom.operators import sets as X

from .registry import query, s

c = F.col


def _score(column: str, q: str, a: int, b: int, d: int) -> str:
    return f"CASE WHEN lower(trim({column})) = '{q}' THEN {a} WHEN starts_with(lower(trim({column})), '{q}') THEN {b} WHEN contains(lower(trim({column})), '{q}') THEN {d} ELSE 0 END"


_DICT = f"""WITH d AS (SELECT p_partkey AS id, p_name AS name, {_score('p_name', 'blue', 100, 90, 70)} AS n, greatest({_score('p_brand', 'blue', 88, 78, 62)},
  {_score("'Blue ' || p_type", 'blue', 88, 78, 62)}) AS a, {_score("p_name || '-pkg'", 'blue', 86, 76, 60)} AS p, {_score("p_type || ' blue'", 'blue', 44, 38, 28)} AS m FROM part)"""


@query(
    "dictionary_search",
    f"""{_DICT} SELECT id, name, greatest(n, a, p, m) AS score, CASE WHEN n = greatest(n, a, p, m) THEN 'name' WHEN a = greatest(n, a, p, m) THEN 'alias'
  WHEN p = greatest(n, a, p, m) THEN 'package' ELSE 'summary' END AS matched_field FROM d WHERE greatest(n, a, p, m) > 0 ORDER BY score DESC, name, id LIMIT 40""",
)
def dictionary_search(t):
    entries = t.part.select(
        c("p_partkey").alias("id"), c("p_name").alias("name"), F.array("p_brand", F.concat(F.lit("Blue "), "p_type")).alias("aliases"),
        F.array(F.concat("p_name", F.lit("-pkg"))).alias("packages"), F.concat("p_type", F.lit(" blue")).alias("summary"),
    )
    return S.dictionary_search(entries, " Blue ", limit=40).select("id", "name", "score", "matched_field")


def _entities(t):
    document = S.search_document(
        names=[c("p_name")], paths=[F.concat_ws("\\", F.lit("parts"), c("p_type"), c("p_brand"))], groups=[c("p_brand")], fields=[F.concat(F.lit("size "), c("p_size").cast("string"))]
    )
    return t.part.select(c("p_partkey").alias("id"), c("p_name").alias("label"), c("p_brand").alias("path"), document.alias("document"))


_TOKENS = """x AS (SELECT p_partkey AS id, lower(p_name) AS name, 'parts/' || lower(p_type) || '/' || lower(p_brand) AS path, lower(p_brand) AS grp, 'size ' || p_size AS field FROM part)"""


@query(
    "entity_search",
    f"""WITH {_TOKENS} SELECT id, CASE WHEN name = 'red ring' THEN 0 WHEN starts_with(name, 'red ring') THEN 1 WHEN contains(name, 'red') AND contains(name, 'ring') THEN 2 ELSE 3 END AS rank FROM x
  WHERE (contains(name, 'red') OR contains(path, 'red') OR contains(grp, 'red') OR contains(field, 'red')) AND (contains(name, 'ring') OR contains(path, 'ring') OR contains(grp, 'ring') OR contains(field, 'ring'))""",
)
def entity_search(t):
    return S.entity_search(_entities(t), "  Red   RING ").select("id", "rank")


@query(
    "entity_search_sections",
    f"""WITH {_TOKENS} SELECT id, 3 AS rank, 'names,paths,fields' AS matched FROM x WHERE contains(name, 'red') AND NOT contains(name, 'parts/economy') AND contains(path, 'parts/economy')
  AND NOT contains(name, '7') AND NOT contains(path, '7') AND NOT contains(grp, '7') AND contains(field, '7')
  UNION ALL SELECT id, 3, 'names,paths' FROM x WHERE contains(name, 'red') AND contains(path, 'parts/economy') AND contains(path, '7')""",
)
def entity_search_sections(t):
    found = S.entity_search(_entities(t), "red parts\\economy 7")
    return found.select("id", "rank", F.array_join("matched", ",").alias("matched"))


@query(
    "explaining_fields",
    f"""WITH {_TOKENS} SELECT id, CASE WHEN contains(name, '3') OR contains(path, '3') OR contains(grp, '3') OR NOT contains(field, '3') THEN '' ELSE field END AS matching FROM x WHERE contains(name, 'blue')
  AND (contains(path, '3') OR contains(grp, '3') OR contains(field, '3'))""",
)
def explaining_fields(t):
    found = S.explaining_fields(S.entity_search(_entities(t), "blue 3"), "blue 3")
    return found.select("id", F.array_join("matching_fields", ",").alias("matching"))


@query(
    "ranked_results",
    f"""WITH {_TOKENS} SELECT id, name AS label, CASE WHEN name = 'small' THEN 0 WHEN starts_with(name, 'small') THEN 1 WHEN contains(name, 'small') THEN 2 ELSE 3 END AS rank FROM x
  WHERE contains(name, 'small') OR contains(path, 'small') OR contains(grp, 'small') OR contains(field, 'small')""",
)
def ranked_results(t):
    return S.ranked(S.entity_search(_entities(t), "small")).select("id", "label", "rank")


@query(
    "display_order",
    """SELECT p_partkey AS id, p_type AS kind, CASE p_type WHEN 'SMALL' THEN 0 WHEN 'ECONOMY' THEN 1 ELSE 2 END AS kind_rank FROM part""",
)
def display_order(t):
    items = t.part.select(c("p_partkey").alias("id"), c("p_type").alias("kind"), c("p_name").alias("label"))
    return S.display_order(items, {"SMALL": 0, "ECONOMY": 1}).select("id", "kind", "kind_rank")


@query(
    "union_evidence",
    """SELECT path, start, "end", description, count(*) AS n FROM (SELECT DISTINCT l_partkey AS path, l_linenumber AS start, l_linenumber AS "end", l_returnflag AS description FROM lineitem WHERE l_quantity > 20
  UNION SELECT l_partkey, l_linenumber, l_linenumber, l_returnflag FROM lineitem WHERE l_quantity < 30) GROUP BY ALL""",
)
def union_evidence(t):
    seen = t.lineitem.select("l_quantity", c("l_partkey").alias("path"), c("l_linenumber").alias("start"), c("l_linenumber").alias("end"), c("l_returnflag").alias("description"))
    merged = X.union_distinct(seen.filter("l_quantity > 20").drop("l_quantity"), seen.filter("l_quantity < 30").drop("l_quantity"))
    return merged.groupBy("path", "start", "end", "description").agg(F.count(F.lit(1)).alias("n"))


@query("id_intersection", "SELECT l_partkey AS id FROM lineitem WHERE l_quantity > 48 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity < 3")
def id_intersection(t):
    ids = lambda test: t.lineitem.filter(test).select(c("l_partkey").alias("id"))
    return X.intersection(ids("l_quantity > 48"), ids("l_quantity < 3"))


@query("id_difference", "SELECT DISTINCT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def id_difference(t):
    return X.difference(t.customer.select(c("c_custkey").alias("id")), t.orders.filter("o_totalprice > 300000").select(c("o_custkey").alias("id")))


@query("overlay", "SELECT layer, count(*) AS n, count(value) AS observed FROM (SELECT 'source' AS layer, NULL AS value FROM orders UNION ALL SELECT 'observed', value FROM events) GROUP BY layer")
def overlay(t):
    source = t.orders.select(s("o", c("o_orderkey")).alias("id"), F.lit("source").alias("layer"))
    observed = t.events.select(s("e", c("event_id")).alias("id"), F.lit("observed").alias("layer"), "value")
    return X.overlay(source, observed).groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("observed"))
