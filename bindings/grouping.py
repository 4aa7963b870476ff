"""Display grouping of embedding points."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import groups as G

from .registry import PAGES, page_paths, query, s

c = F.col
# A point cloud from the first two dimensions; labels are groups, label parity the group above.
POINTS = "pt AS (SELECT vec_id AS id, embedding[1]::DOUBLE * 700 AS x, embedding[2]::DOUBLE * 700 AS y, label FROM embeddings)"
MEMBERS = "mb AS (SELECT id, 'l' || label AS group_id, 1 AS level FROM pt UNION ALL SELECT id, 'q' || (label % 2), 2 FROM pt)"


def points(t):
    return t.embeddings.select(
        c("vec_id").alias("id"), (F.get("embedding", F.lit(0)).cast("double") * 700).alias("x"), (F.get("embedding", F.lit(1)).cast("double") * 700).alias("y"), "label", s("cat", c("label") % 3).alias("category")
    )


def memberships(t):
    two = F.array(F.struct(s("l", c("label")).alias("group_id"), F.lit(1).alias("level")), F.struct(s("q", c("label") % 2).alias("group_id"), F.lit(2).alias("level")))
    return points(t).select("id", F.inline(two))


@query(
    "build_groups",
    f"""WITH {POINTS}, {MEMBERS} SELECT group_id, max(mb.level) AS level, count(*) AS members, round(avg(x), 6) AS x, round(avg(y), 6) AS y, min(mb.id) AS first_member, max(mb.id) AS last_member FROM mb JOIN pt ON pt.id = mb.id GROUP BY 1""",
)
def build_groups(t):
    return G.build_groups(memberships(t), points(t)).withColumn("x", F.round("x", 6)).withColumn("y", F.round("y", 6))


CROWDED = "cr AS (SELECT a.id FROM pt a WHERE EXISTS (SELECT 1 FROM pt b WHERE b.id <> a.id AND (b.x - a.x) ** 2 + (b.y - a.y) ** 2 < 144))"


@query("crowded_points", f"WITH {POINTS}, {CROWDED} SELECT id FROM cr")
def crowded_points(t):
    return G.crowded_points(points(t))


DENSITY = f"""{POINTS}, {MEMBERS}, {CROWDED}, me AS (SELECT group_id, max(mb.level) AS level, count(*) AS members, greatest(8, max(x) - min(x)) AS width, greatest(8, max(y) - min(y)) AS height, avg(CASE WHEN mb.id IN (SELECT id FROM cr) THEN 1.0 ELSE 0 END) AS crowded
  FROM mb JOIN pt ON pt.id = mb.id GROUP BY 1 HAVING count(*) >= CASE WHEN group_id LIKE 'l%' THEN 8 ELSE 60 END)"""


def _limits(t):
    return memberships(t).groupBy("group_id").agg(F.max("level").alias("level")).withColumn("minimum_members", F.when(c("group_id").startswith("l"), F.lit(None)).otherwise(60)).withColumn(
        "maximum_span", F.when(c("group_id") == "q0", 100.0)
    )


@query("density", f"WITH {DENSITY} SELECT group_id, members, round(width, 6) AS width, round(height, 6) AS height, round(crowded, 6) AS crowded, round(sqrt(width * height / members), 6) AS spacing FROM me")
def density(t):
    measured = G.density(points(t), memberships(t), _limits(t))
    return measured.select("group_id", "members", *[F.round(name, 6).alias(name) for name in ("width", "height", "crowded", "spacing")])


ELIGIBLE = f"""{DENSITY}, el AS (SELECT group_id, level, CASE WHEN greatest(width, height) > CASE WHEN group_id = 'q0' THEN 100.0 ELSE 1e300 END * CASE WHEN group_id = 'l1' THEN 1.2 ELSE 1 END
  THEN CASE WHEN crowded >= CASE WHEN group_id = 'l1' THEN 0.4 ELSE 0.65 END THEN 2 END
  WHEN sqrt(width * height / members) <= CASE WHEN group_id = 'l1' THEN 22 ELSE 14 END OR crowded >= CASE WHEN group_id = 'l1' THEN 0.4 ELSE 0.65 END THEN 1 END AS pass FROM me)"""


def _eligible(t):
    measured = G.density(points(t), memberships(t), _limits(t))
    active = _limits(t).filter("group_id = 'l1'").select("group_id")
    return G.eligible_groups(measured, _limits(t), active)


@query("eligible_groups", f"WITH {ELIGIBLE} SELECT group_id, level, pass FROM el WHERE pass IS NOT NULL")
def eligible_groups(t):
    return _eligible(t)


def _owners(t):
    protected = points(t).filter("id % 17 = 0").select("id")
    expanded = _limits(t).filter("group_id = 'l2'").select("group_id")
    manual = points(t).filter("label = 3").select(F.lit("m3").alias("group_id"), "id", F.lit(0).alias("seq"))
    return G.assign_owners(points(t), memberships(t), _eligible(t), protected, expanded, manual)


# Pass 1 serves level 2 then level 1; pass 2 serves level 1 then level 2.
OWNED = f"""{ELIGIBLE}, fr AS (SELECT id, label FROM pt WHERE id % 17 <> 0 AND label <> 3 AND label <> 2),
  cand AS (SELECT fr.id, el.group_id, CASE WHEN pass = 1 THEN 3 - el.level ELSE 2 + el.level END AS turn FROM fr JOIN mb ON mb.id = fr.id JOIN el ON el.group_id = mb.group_id WHERE pass IS NOT NULL AND el.group_id <> 'l2'),
  ow AS (SELECT id, arg_min(group_id, turn) AS g FROM cand GROUP BY id)"""


@query(
    "assign_owners",
    f"""WITH {OWNED} SELECT pt.id, CASE WHEN label = 3 AND pt.id % 17 <> 0 THEN 'manual:m3' WHEN g IS NOT NULL THEN 'automatic:' || g ELSE pt.id::VARCHAR END AS owner,
  CASE WHEN label = 3 AND pt.id % 17 <> 0 THEN 'manual' WHEN g IS NOT NULL THEN 'automatic' ELSE 'individual' END AS mode FROM pt LEFT JOIN ow ON ow.id = pt.id""",
)
def assign_owners(t):
    return _owners(t)


@query(
    "owner_breakdown",
    f"""WITH {OWNED}, r AS (SELECT pt.id, label, CASE WHEN label = 3 AND pt.id % 17 <> 0 THEN 'manual:m3' WHEN g IS NOT NULL THEN 'automatic:' || g END AS owner FROM pt LEFT JOIN ow ON ow.id = pt.id)
  SELECT owner, 'cat' || (label % 3) AS category, count(*) AS members, count(*) FILTER (id % 2 = 0) AS matching FROM r WHERE owner IS NOT NULL GROUP BY ALL""",
)
def owner_breakdown(t):
    return G.owner_breakdown(_owners(t), points(t), points(t).filter("id % 2 = 0"))


@query(
    "aggregation_counts",
    f"""WITH {OWNED}, r AS (SELECT pt.id, CASE WHEN label = 3 AND pt.id % 17 <> 0 THEN 'm' WHEN g IS NOT NULL THEN 'a' ELSE 'i' END AS mode, g FROM pt LEFT JOIN ow ON ow.id = pt.id)
  SELECT count(*) AS scope, count(*) FILTER (mode = 'i') AS individual, count(*) FILTER (mode = 'a') AS automatic_members, count(DISTINCT CASE WHEN mode = 'a' THEN g END) AS automatic_groups,
  count(*) FILTER (mode = 'm') AS manual_members, 1::BIGINT AS manual_groups, count(*) FILTER (mode = 'i') + count(DISTINCT CASE WHEN mode = 'a' THEN g END) + 1 AS representations FROM r""",
)
def aggregation_counts(t):
    return G.aggregation_counts(_owners(t))


@query(
    "closed_groups",
    rf"""WITH {PAGES}, x AS (SELECT page_id, split_part(path, '/', 1) AS h, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS l FROM pg)
  SELECT page_id, CASE WHEN h NOT IN ('blog.tionsh.example.net', 'thther.example.org') THEN h WHEN l <> 'thther.example.org/en' THEN l END AS closed_group FROM x""",
)
def closed_groups(t):
    parts = F.split("path", "/")
    host = F.get(parts, F.lit(0))
    modules = page_paths(t).select("page_id", F.array(host, F.concat_ws("/", host, F.get(parts, F.lit(1)))).alias("region_path"))
    return G.closed_groups(modules, ["blog.tionsh.example.net", "thther.example.org", "thther.example.org/en"]).select("page_id", "closed_group")
