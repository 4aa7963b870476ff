"""Keyed merges and execution records, driven by line items and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import traces as TF
from corpusloom.operators import merge as M
from corpusloom.operators import spans as S

from .registry import query, s

c = F.col
SEQ = "(l_orderkey, l_linenumber, l_suppkey)"


def _facts(t):
    return t.lineitem.select(
        c("l_partkey").alias("id"), F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("seq"), c("l_returnflag").alias("kind"), c("l_suppkey").alias("label"),
        (c("l_linestatus") == "O").alias("explicit"), F.array(c("l_suppkey"), -c("l_linenumber").cast("bigint")).alias("evidence_ids"),
        F.create_map(c("l_returnflag"), c("l_suppkey").cast("string"), F.lit("last"), c("l_orderkey").cast("string")).alias("metadata"),
    )


@query(
    "merge_facts",
    f"""SELECT l_partkey AS id, arg_min(l_returnflag, {SEQ}) AS kind, arg_min(l_suppkey, {SEQ}) AS label, count(*) AS occurrences, bool_or(l_linestatus = 'O') AS explicit
  FROM lineitem GROUP BY l_partkey""",
)
def merge_facts(t):
    return M.merge_facts(_facts(t), flags=["explicit"]).drop("seq")


@query("merged_set", "SELECT l_partkey AS id, count(*) AS items FROM (SELECT l_partkey, l_suppkey AS v FROM lineitem UNION SELECT l_partkey, -l_linenumber FROM lineitem) GROUP BY 1")
def merged_set(t):
    return M.merged_set(_facts(t), "evidence_ids").groupBy("id").agg(F.count(F.lit(1)).alias("items"))


@query(
    "merged_metadata",
    f"""SELECT l_partkey AS id, l_returnflag AS name, arg_max(l_suppkey, {SEQ})::VARCHAR AS value FROM lineitem GROUP BY ALL
  UNION ALL SELECT l_partkey, 'last', arg_max(l_orderkey, {SEQ})::VARCHAR FROM lineitem GROUP BY 1""",
)
def merged_metadata(t):
    return M.merged_metadata(_facts(t))


@query("metadata_maps", f"SELECT l_partkey AS id, arg_max(l_orderkey, {SEQ})::VARCHAR AS last, count(DISTINCT l_returnflag) + 1 AS names FROM lineitem GROUP BY 1")
def metadata_maps(t):
    maps = M.as_maps(M.merged_metadata(_facts(t)))
    return maps.select("id", c("metadata")["last"].alias("last"), F.size("metadata").cast("bigint").alias("names"))


@query(
    "merge_relations",
    f"""SELECT 'relation:' || l_returnflag || ':' || l_suppkey || ':' || l_partkey AS id, l_suppkey AS src, l_partkey AS dst, count(*) AS occurrences FROM lineitem GROUP BY l_returnflag, l_suppkey, l_partkey""",
)
def merge_relations(t):
    rows = t.lineitem.select(
        F.concat_ws(":", F.lit("relation"), "l_returnflag", "l_suppkey", "l_partkey").alias("id"), c("l_suppkey").alias("src"), c("l_partkey").alias("dst"),
        F.struct("l_orderkey", "l_linenumber").alias("seq"),
    )
    return M.merge_relations(rows).select("id", "src", "dst", "occurrences")


@query("upsert_warnings", "SELECT user_id AS id, arg_max(event_type, event_id) AS message, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def upsert_warnings(t):
    rows = t.events.select(c("user_id").alias("id"), c("event_id").alias("seq"), c("event_type").alias("message"), "value")
    return M.upsert(rows).select("id", "message", "value")


@query(
    "stack_usage",
    """SELECT 'n' || c_nationkey AS scope, p_brand AS stack_id, count(DISTINCT l_orderkey) AS evidence, count(DISTINCT l_partkey) AS facts, count(DISTINCT l_returnflag) AS kinds,
  bool_or(l_linestatus = 'O') AS used, bool_or(l_linestatus <> 'O') AS declared
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey GROUP BY ALL""",
)
def stack_usage(t):
    placed = t.lineitem.join(t.orders, c("o_orderkey") == c("l_orderkey")).join(t.customer, c("c_custkey") == c("o_custkey")).join(t.part, c("p_partkey") == c("l_partkey"))
    rows = placed.select(
        s("n", c("c_nationkey")).alias("scope"), c("p_brand").alias("stack_id"), c("l_orderkey").alias("evidence_id"), c("l_partkey").alias("fact_id"),
        c("l_returnflag").alias("kind"), F.when(c("l_linestatus") == "O", "usage").otherwise("declaration").alias("role"),
    )
    return M.stack_usage(rows)


K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def _spans(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return t.events.select(
        F.lit("t").alias("trace_id"), c("event_id").cast("string").alias("span_id"), (c("event_id") - k).cast("string").alias("parent_span_id"), c("event_id").alias("seq"), c("event_type").alias("name")
    )


@query(
    "span_parents",
    f"""WITH e AS (SELECT event_id, event_id - {K} AS parent FROM events) SELECT e.event_id::VARCHAR AS span_id,
  CASE WHEN e.parent = e.event_id THEN 'self' WHEN p.event_id IS NOT NULL THEN 'linked' ELSE 'missing' END AS link FROM e LEFT JOIN events p ON p.event_id = e.parent""",
)
def span_parents(t):
    spans = _spans(t)
    return S.link_parents(spans, spans, salt=8).select("span_id", "link")


@query(
    "observed_edges",
    f"""WITH e AS (SELECT event_id, event_id - {K} AS parent FROM events), l AS (SELECT event_id, user_id * 100 AS span FROM events)
  SELECT kind, count(*) AS n, count(DISTINCT src) AS sources FROM (SELECT 'observed-child' AS kind, p.event_id AS src FROM e JOIN events p ON p.event_id = e.parent WHERE e.parent <> e.event_id
  UNION ALL SELECT 'log-event', span FROM l JOIN events s ON s.event_id = l.span) GROUP BY kind""",
)
def observed_edges(t):
    logs = t.events.select(F.lit("t").alias("trace_id"), (c("user_id") * 100).cast("string").alias("span_id"), c("event_id").alias("seq"))
    return S.observed_edges(_spans(t), logs).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src").alias("sources"))


@query(
    "span_duplicates",
    "SELECT event_type AS trace_id, user_id::VARCHAR AS span_id, arg_min(event_id, event_id) AS seq, count(*) - 1 AS duplicates FROM events GROUP BY event_type, user_id",
)
def span_duplicates(t):
    rows = t.events.select(c("event_type").alias("trace_id"), c("user_id").cast("string").alias("span_id"), c("event_id").alias("seq"))
    return S.dedupe_spans(rows)


@query(
    "trace_warnings",
    f"""WITH f AS (SELECT event_type AS trace_id, user_id AS span_id, arg_min(user_id - {K}, event_id) AS parent, count(*) - 1 AS d FROM events GROUP BY event_type, user_id)
  SELECT trace_id, 'duplicate-span' AS warning, sum(d)::BIGINT AS n FROM f GROUP BY 1 HAVING sum(d) > 0
  UNION ALL SELECT f.trace_id, 'missing-parent', count(*) FROM f LEFT JOIN f p ON p.trace_id = f.trace_id AND p.span_id = f.parent WHERE p.span_id IS NULL OR f.parent = f.span_id GROUP BY 1""",
)
def trace_warnings(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    rows = t.events.select(c("event_type").alias("trace_id"), c("user_id").cast("string").alias("span_id"), (c("user_id") - k).cast("string").alias("parent_span_id"), c("event_id").alias("seq"))
    return S.trace_warnings(rows)


@query(
    "span_binding",
    """WITH f AS (SELECT p_partkey AS fn_id, lower(p_type) || '/' || lower(p_brand) || '.py' AS path, p_name AS label, split_part(p_name, ' ', 2) AS name, (p_partkey % 97) * 10 + 1 AS line, (p_partkey % 97) * 10 + p_size AS end_line FROM part),
  x AS (SELECT DISTINCT CASE WHEN l_linenumber <> 7 THEN '/srv/app/' || lower(p_type) || '/' || lower(p_brand) || '.py' END AS path, CASE WHEN l_linenumber % 2 = 0 THEN p_name WHEN l_linenumber = 7 THEN p_name END AS function_name,
    CASE WHEN l_linenumber < 5 THEN ((l_partkey % 97) * 10 + l_suppkey % 30)::INT END AS line FROM lineitem JOIN part ON p_partkey = l_partkey),
  m AS (SELECT x.path, x.function_name, x.line, count(DISTINCT fn_id) AS n, min(fn_id) AS fn FROM x JOIN f ON (x.path IS NULL OR ends_with(x.path, '/' || f.path)) AND (x.function_name IS NULL OR x.function_name IN (f.label, f.name)) AND (x.line IS NULL OR x.line BETWEEN f.line AND f.end_line) GROUP BY ALL)
  SELECT x.path, x.function_name, x.line, CASE WHEN n = 1 THEN fn END AS fn_id, CASE WHEN n = 1 THEN CASE WHEN x.path IS NULL THEN 'inferred' ELSE 'observed' END END AS confidence
  FROM x LEFT JOIN m ON m.path IS NOT DISTINCT FROM x.path AND m.function_name IS NOT DISTINCT FROM x.function_name AND m.line IS NOT DISTINCT FROM x.line""",
)
def span_binding(t):
    file = F.concat(F.lower("p_type"), F.lit("/"), F.lower("p_brand"), F.lit(".py"))
    start = (c("p_partkey") % 97) * 10
    functions = t.part.select(c("p_partkey").alias("fn_id"), file.alias("path"), c("p_name").alias("label"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("name"), (start + 1).alias("line"), (start + c("p_size")).alias("end_line"))
    lines = t.lineitem.join(t.part.hint("merge"), c("p_partkey") == c("l_partkey"))
    spans = lines.select(
        F.when(c("l_linenumber") != 7, F.concat(F.lit("/srv/app/"), file)).alias("path"),
        F.when((c("l_linenumber") % 2 == 0) | (c("l_linenumber") == 7), c("p_name")).alias("function_name"),
        F.when(c("l_linenumber") < 5, ((c("l_partkey") % 97) * 10 + c("l_suppkey") % 30).cast("int")).alias("line"),
    ).distinct()
    return S.bind_spans(spans, functions)


@query(
    "boundary_values",
    """SELECT direction, label, count(*) AS n FROM (SELECT 'input' AS direction, event_type AS label FROM events WHERE user_id % 2 = 0 UNION ALL SELECT 'output', event_type || '!' FROM events WHERE user_id % 3 = 0) GROUP BY ALL""",
)
def boundary_values(t):
    attributes = F.map_from_entries(
        F.filter(
            F.array(
                F.struct(F.lit("data.input.name").alias("key"), F.when(c("user_id") % 2 == 0, c("event_type")).alias("value")),
                F.struct(F.lit("data.output.name").alias("key"), F.when(c("user_id") % 3 == 0, F.concat("event_type", F.lit("!"))).alias("value")),
            ),
            lambda item: item["value"].isNotNull(),
        )
    )
    spans = t.events.select(F.lit("t").alias("trace_id"), c("event_id").cast("string").alias("span_id"), attributes.alias("attributes"))
    nodes, links = S.boundary_values(spans)
    touched = links.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return nodes.join(touched, "id", "left_semi").groupBy("direction", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "adapt_data_trace",
    """SELECT kind, count(*) AS n, sum(attrs)::BIGINT AS attributes FROM (SELECT 'span' AS kind, 2 AS attrs FROM events UNION ALL SELECT 'value', 1 FROM events) GROUP BY kind""",
)
def adapt_data_trace(t):
    from corpusloom.operators.filters import adapt_data_trace as adapt

    marked = F.create_map(F.lit("traceId"), F.lit("t"), F.lit("http.url"), F.lit("x"))
    spans = t.events.select(s("span:", c("event_id")).alias("id"), F.lit("span").alias("kind"), marked.alias("attributes"), F.lit("a/b.py").alias("path"), F.lit(None).cast("int").alias("line"))
    values = t.events.select(
        s("value:", c("event_id")).alias("id"), F.lit("value").alias("kind"), F.create_map(F.lit("owner"), F.lit("x")).alias("attributes"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("line")
    )
    links = t.events.select(
        s("e", c("event_id")).alias("id"), s("value:", c("event_id")).alias("src"), s("span:", c("event_id")).alias("dst"), F.lit("observed-data").alias("kind"),
        F.array(F.lit("data-flow")).alias("views"), F.lit("observed").alias("confidence"),
    )
    nodes, _ = adapt(spans.unionByName(values), links)
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("attributes")).alias("attributes"))


@query(
    "reaching_defs",
    """SELECT e.event_id, v.event_id AS reaching FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON e.user_id = v.user_id AND e.ts >= v.ts""",
)
def reaching_defs(t):
    rows = t.events.filter("event_type in ('error', 'view')").select("event_id", "user_id", "ts", "event_type")
    seen = S.last_before(rows, ["user_id"], ["ts", "event_id"], c("event_type") == "view", c("event_id"))
    return seen.filter("event_type = 'error'").select("event_id", "reaching")


BRACKETS = """p AS (SELECT *, CASE event_type WHEN 'signup' THEN 'B' WHEN 'purchase' THEN 'E' WHEN 'click' THEN 'i' END AS phase FROM events WHERE event_type IN ('signup', 'purchase', 'click')),
  a AS (SELECT *, sum(CASE phase WHEN 'B' THEN 1 WHEN 'E' THEN -1 ELSE 0 END) OVER w AS h FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  b AS (SELECT *, least(0, min(h) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS lo, least(0, coalesce(min(h) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lob FROM a),
  q AS (SELECT event_id, user_id, ts, phase, phase = 'E' AND h < lob AS orphan, CASE WHEN NOT (phase = 'E' AND h < lob) THEN (h - lo + CASE WHEN phase = 'E' THEN 1 ELSE 0 END)::BIGINT END AS depth FROM b)"""


def _phases(t):
    phase = F.when(c("event_type") == "signup", "B").when(c("event_type") == "purchase", "E").otherwise("i")
    return t.events.filter("event_type in ('signup', 'purchase', 'click')").select("event_id", "user_id", "ts", phase.alias("phase"))


@query("begin_end_pairs", f"WITH {BRACKETS} SELECT event_id, phase, orphan, depth FROM q")
def begin_end_pairs(t):
    return S.bracket_pairs(_phases(t), ["user_id"], ["ts", "event_id"]).select("event_id", "phase", "orphan", "depth")


@query(
    "bracket_spans",
    f"""WITH {BRACKETS}, x AS (SELECT *, lead(phase) OVER w AS np, lead(event_id) OVER w AS ne FROM q WHERE NOT orphan AND phase IN ('B', 'E') WINDOW w AS (PARTITION BY user_id, depth ORDER BY ts, event_id)),
  s AS (SELECT event_id, user_id, ts, depth, CASE WHEN np = 'E' THEN ne END AS end_item FROM x WHERE phase = 'B')
  SELECT s.event_id, s.depth, s.end_item, p.event_id AS parent_item FROM s ASOF LEFT JOIN (SELECT *, depth + 1 AS d1 FROM s) p ON p.user_id = s.user_id AND p.d1 = s.depth AND s.ts >= p.ts""",
)
def bracket_spans(t):
    paired = S.bracket_pairs(_phases(t), ["user_id"], ["ts", "event_id"])
    return S.complete_brackets(paired, ["user_id"], ["ts", "event_id"]).select("event_id", "depth", "end_item", "parent_item")


@query(
    "instant_logs",
    f"""WITH {BRACKETS}, i AS (SELECT * FROM q WHERE phase = 'i') SELECT i.event_id, CASE WHEN i.depth > 0 THEN b.event_id END AS span_item
  FROM i ASOF LEFT JOIN (SELECT * FROM q WHERE phase = 'B') b ON b.user_id = i.user_id AND b.depth = i.depth AND i.ts >= b.ts""",
)
def instant_logs(t):
    phases = _phases(t)
    paired = S.bracket_pairs(phases, ["user_id"], ["ts", "event_id"])
    return S.attach_instants(phases, ["user_id"], ["ts", "event_id"], paired).select("event_id", "span_item")


@query("attribute_json", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def attribute_json(t):
    parsed = t.events.select("event_id", F.from_json("props", "map<string,string>").alias("attributes"))
    return parsed.select("event_id", TF.clean_attributes("attributes")["k"].alias("k"))


@query(
    "duration_ms",
    """WITH x AS (SELECT event_id, epoch_us(ts) * 1000 + 7 AS b, epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) * 1000 AS a FROM events) SELECT event_id, CASE WHEN b >= a THEN ((b - a) // 1000) / 1000.0::DOUBLE END AS ms FROM x WHERE a IS NOT NULL""",
)
def duration_ms(t):
    from corpusloom.plans import Blocks
    from pyspark.sql import Window

    clocks = t.events.select("event_id", "user_id", "ts", F.unix_micros(c("ts").cast("timestamp")).alias("us"))
    cut = Blocks(clocks, ["user_id"], ["ts", "event_id"])
    lagged = cut.rows.withColumn("_own", F.lag("us").over(cut.inside))
    carried = cut.carry({"_last": F.max("us")}, {"_before": ("last", "_last")}, rows=lagged).withColumn("start", F.coalesce("_own", "_before"))
    nanos = carried.filter(c("start").isNotNull()).select("event_id", F.concat(c("start").cast("string"), F.lit("000")).alias("a"), F.concat(c("us").cast("string"), F.lit("007")).alias("b"))
    return nanos.select("event_id", TF.duration_ms("a", "b").alias("ms"))
