"""View tables composed from facts, relations, evidence and files."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import dir_name
from ..plans import lookup_join, rewritten
from .bundles import degrees
from .filters import edges_for
from .merge import stack_usage
from .owners import nearest_owner, region_nesting
from .tree import chain_groups, compress_chain, directory_tree
from .windows import best_per_key

# Facts and relations of the workspace view, and ranks of scope sources.
WORKSPACE_FACTS = ("project", "workspace-config", "workspace-pattern", "workspace-package")
WORKSPACE_RELATIONS = ("uses-config", "declares", "matches")
SCOPE_RANK = {"root": 6, "services": 6, "deployment": 6, "package": 5, "solution": 4, "config": 3, "runtime": 3, "workspace": 2, "standalone": 1}


def workspace_view(facts: DataFrame, relations: DataFrame, project_root: str = "project:root", by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Workspace nodes and edges, and a warning for projects without a workspace config.

    Containment is shown only from the project to its root packages (``is_root``).
    """
    nodes = facts.filter(F.col("kind").isin(*WORKSPACE_FACTS))
    plain = edges_for(nodes, relations, F.col("kind").isin(*WORKSPACE_RELATIONS), by=by)
    roots = facts.filter("kind = 'workspace-package' and is_root").select(*by, F.col("id").alias("dst"))
    held = relations.filter((F.col("kind") == "contains") & (F.col("src") == project_root)).join(roots, [*by, "dst"], "left_semi")
    edges = plain.unionByName(edges_for(nodes, held.select(*relations.columns), by=by).select(*plain.columns))
    if by:
        warnings = facts.groupBy(*by).agg(F.max(F.col("kind") == "workspace-config").alias("_has")).filter("not _has").select(*by, F.lit("workspace:no-config").alias("id"))
    else:
        warnings = facts.agg(F.max(F.col("kind") == "workspace-config").alias("_has")).filter("not _has").select(F.lit("workspace:no-config").alias("id"))
    return nodes, edges, warnings


# Detectors that only declare, and detectors that show use.
DECLARING_DETECTORS = ("package-dependency", "package-manager")


def evidence_role() -> Column:
    """Role of a piece of evidence for its fact: as recorded, else by detector and fact kind.

    Columns: ``role``, ``detector_id``, ``fact_kind``, ``explicit``.
    """
    detector = F.col("detector_id")
    inferred = (
        F.when(detector.isin(*DECLARING_DETECTORS), "declaration")
        .when((detector == "source-import") | F.contains(detector, F.lit("config")) | F.col("fact_kind").isin("runtime", "resource"), "usage")
        .when((F.col("fact_kind") == "technology") & F.coalesce("explicit", F.lit(False)), "usage")
        .otherwise("declaration")
    )
    return F.coalesce("role", inferred)


class Attribution(NamedTuple):
    """Evidence of facts by scope, without a row per shared declaration and scope.

    A row without an ``evidence_id`` stands for ``n`` pieces of evidence that have no other row; one with an id for itself.
    """

    own: DataFrame  # fact_id, fact_kind, stack_id, scope, evidence_id, role, n: evidence that belongs to one scope
    shared: DataFrame  # fact_id, fact_kind, stack_id, evidence_id, role, n: declarations that count for all usage scopes of the fact
    used: DataFrame  # fact_id, scope: usage scopes


def attribute_evidence(fact_evidence: DataFrame, evidence: DataFrame, scopes: DataFrame, by: Sequence[str] = (), counted: bool = False, stored: bool = True) -> Attribution:
    """Attribute facts to scopes through their evidence; see :func:`attribute_usage` for rules and columns.

    A declaration whose own scope has no usage counts for every usage scope of its fact: it stays one row with the fact.
    ``counted`` merges evidence of one fact only with others of its fact, path and role as soon as it has met its fact: what follows
    moves counts, and ids only of evidence that several facts have.  Without ``stored`` nothing is written before it is asked for.
    """
    joined = lookup_join(fact_evidence, evidence, [*by, "evidence_id"], "inner").withColumn("role", evidence_role())
    places = ["path", "scope_path"] if "scope_path" in evidence.columns else ["path"]
    rows = joined.select(*by, "fact_id", "fact_kind", "stack_id", "evidence_id", "role", *places).withColumn("n", F.lit(1).cast("long"))
    merged = lambda frame, columns: frame.groupBy(*columns).agg(F.when(F.col("evidence_id").isNull(), F.sum("n")).otherwise(1).alias("n"))
    if counted:
        alone = F.count(F.lit(1)).over(Window.partitionBy(*by, "evidence_id")) == 1
        rows = rows.withColumn("_alone", alone).withColumn("evidence_id", F.when(~F.col("_alone"), F.col("evidence_id"))).drop("_alone")
        evidence = rows = rewritten(merged(rows, [name for name in rows.columns if name != "n"]))
    own = nearest_owner(evidence.select(*by, "path").distinct(), scopes, by).select(*by, "path", F.col("owner").alias("_own"))
    placed = lookup_join(rows, own, [*by, "path"])
    if "scope_path" in places:
        named = placed.filter(F.col("scope_path").isNotNull()).select(*by, F.col("scope_path").alias("path")).distinct()
        explicit = nearest_owner(named, scopes, by, is_directory=True).select(*by, F.col("path").alias("scope_path"), F.col("owner").alias("_named"))
        placed = lookup_join(placed, explicit, [*by, "scope_path"]).withColumn("_own", F.coalesce("_named", "_own"))
    cols = [*by, "fact_id", "fact_kind", "stack_id", "scope", "evidence_id", "role"]
    placed = placed.withColumn("scope", F.col("_own")).select(*cols, "n")
    if stored:
        # Four branches below read this table; store it once.
        placed = rewritten(placed)
    usage = placed.filter("role = 'usage' and scope is not null")
    used = usage.select(*by, "fact_id", "scope").distinct()
    facts_used = used.select(*by, "fact_id").distinct().withColumn("_used", F.lit(True))
    declared = lookup_join(placed.filter("role = 'declaration'"), facts_used, [*by, "fact_id"])
    alone = declared.filter("_used is null and scope is not null").select(*cols, "n")
    backed = lookup_join(declared.filter("_used"), used.withColumn("_match", F.lit(True)), [*by, "fact_id", "scope"])
    matched = backed.filter("_match").select(*cols, "n")
    shared = merged(backed.filter("_match is null"), [c for c in cols if c != "scope"])
    settled = merged(usage.unionByName(alone).unionByName(matched), cols)
    support = placed.filter("role = 'scope'").join(settled.select(*by, "fact_id", "scope").distinct(), [*by, "fact_id", "scope"], "left_semi")
    return Attribution(settled.unionByName(merged(support, cols)), shared, used)


def attribute_usage(fact_evidence: DataFrame, evidence: DataFrame, scopes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Attribute facts to scopes through their evidence.

    Usage evidence decides the scopes; declarations count on their own only when there is no usage, otherwise they join
    the usage of their own scope, or of all usage scopes when their own has none.  Scope evidence supports existing ones.

    ``fact_evidence``: ``fact_id``, ``fact_kind``, ``stack_id``, ``explicit``, ``evidence_id``; ``evidence``: ``evidence_id``,
    ``path``, ``role``, ``detector_id``, ``scope_path``; ``scopes``: ``owner_path``, ``owner``.
    """
    return _attributed(attribute_evidence(fact_evidence, evidence, scopes, by), by)


def _attributed(found: Attribution, by: Sequence[str]) -> DataFrame:
    cols = [*by, "fact_id", "fact_kind", "stack_id", "scope", "evidence_id", "role"]
    return found.own.select(*cols).unionByName(found.shared.join(found.used, [*by, "fact_id"]).select(*cols))


def attribution_counts(found: Attribution, by: Sequence[str] = ()) -> DataFrame:
    """Pieces of evidence per fact, scope and role.  Shared declarations are counted once per fact and added to its scopes."""
    key = [*by, "fact_id", "scope", "role"]
    own = found.own.groupBy(*key).agg(F.sum("n").alias("evidence"))
    shared = found.shared.groupBy(*by, "fact_id", "role").agg(F.sum("n").alias("evidence"))
    lent = found.used.join(shared, [*by, "fact_id"])
    return own.unionByName(lent.select(*key, "evidence")).groupBy(*key).agg(F.sum("evidence").alias("evidence"))


def _distinct_evidence(found: Attribution, by: Sequence[str], per: Sequence[str]) -> DataFrame:
    """Distinct pieces of evidence per scope and ``per``.

    Evidence with one row belongs to one fact: it is counted there, and the counts are lent to the scopes of the fact.  Only evidence
    with several rows, which could be counted twice in a scope, meets the scopes piece by piece.
    """
    item, group = [*by, *per, "evidence_id"], [*by, "scope", *per]
    every = found.own.select(*item, "fact_id", "scope", F.lit(False).alias("_shared"), "n")
    every = every.unionByName(found.shared.select(*item, "fact_id", F.lit(None).cast("string").alias("scope"), F.lit(True).alias("_shared"), "n"))
    rows = every.filter("evidence_id is not null").drop("n")
    counted = rows.groupBy(*item).agg(F.count(F.lit(1)).alias("_rows"), F.min(F.struct("_shared", "fact_id", "scope")).alias("_row"))
    single = counted.filter("_rows = 1").groupBy(*by, *per, "_row").agg(F.count(F.lit(1)).alias("evidence")).select(*by, *per, "_row.*", "evidence")
    single = single.unionByName(every.filter("evidence_id is null").groupBy(*by, *per, "_shared", "fact_id", "scope").agg(F.sum("n").alias("evidence")))
    several = rows.join(counted.filter("_rows > 1").select(*item), item, "left_semi")
    lent = lambda frame: frame.filter("not _shared").select(*group, *frame.columns[-1:]).unionByName(frame.filter("_shared").drop("scope").join(found.used, [*by, "fact_id"]).select(*group, *frame.columns[-1:]))
    twice = lent(several.select(*by, *per, "_shared", "fact_id", "scope", "evidence_id")).distinct().groupBy(*group).agg(F.count(F.lit(1)).alias("evidence"))
    return lent(single).unionByName(twice).groupBy(*group).agg(F.sum("evidence").alias("evidence"))


def usage_counts(found: Attribution, by: Sequence[str] = ()) -> DataFrame:
    """:func:`stack_usage` of all attributed evidence, without a row per shared declaration and scope."""
    cols = [*by, "fact_id", "stack_id", F.col("fact_kind").alias("kind"), "role"]
    own = found.own.select("scope", *cols).distinct()
    shared = found.shared.select(*cols).distinct().join(found.used, [*by, "fact_id"])
    facts = stack_usage(own.unionByName(shared.select(*own.columns)).withColumn("evidence_id", F.lit(0)), by).drop("evidence")
    joined = lookup_join(facts, _distinct_evidence(found, by, ["stack_id"]), [*by, "scope", "stack_id"])
    return joined.select(*by, "scope", "stack_id", F.coalesce("evidence", F.lit(0)).alias("evidence"), "facts", "kinds", "used", "declared")


def scope_candidates(candidates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One scope per path: the highest-ranked source wins; desktop kind, explicit boundary and package identity stick.

    ``candidates``: ``path``, ``source``, ``kind``, ``explicit``, ``fact_id``.
    """
    rank = None
    for name, value in SCOPE_RANK.items():
        rank = F.when(F.col("source") == name, value) if rank is None else rank.when(F.col("source") == name, value)
    hidden = (F.col("path") != ".") & F.col("path").rlike(r"(?:^|/)\.")
    rows = candidates.filter(~hidden).withColumn("_rank", F.coalesce(rank, F.lit(0))).withColumn("desktop", F.col("kind") == "desktop")
    best = best_per_key(rows, [*by, "path"], [-F.col("_rank"), F.coalesce("fact_id", F.lit("~"))], flags=["explicit", "desktop"])
    return best.withColumn("kind", F.when(F.col("desktop"), "desktop").otherwise(F.col("kind"))).withColumn("owner", F.concat_ws(":", F.lit("scope"), "source", "path")).drop("_rank", "desktop")


def stack_map(
    fact_evidence: DataFrame, evidence: DataFrame, candidates: DataFrame, by: Sequence[str] = (), project: str | None = None
) -> dict[str, DataFrame]:
    """Technologies per scope: scopes, usages, nested regions and the usages counted per region.

    With ``project``, the id of its node, also the ``edge`` rows from it to the regions that lie in no other one.
    """
    scopes = scope_candidates(candidates, by)
    owners = scopes.select(*by, F.col("path").alias("owner_path"), "owner")
    found = attribute_evidence(fact_evidence, evidence, owners, by, counted=True)
    found = found._replace(own=rewritten(found.own), shared=rewritten(found.shared))
    usage = usage_counts(found, by)
    # Shared declarations count only for scopes that have evidence of their own.
    live = found.own.select(*by, F.col("scope").alias("owner")).distinct()
    shown = scopes.join(live, [*by, "owner"], "left_semi")
    regions = region_nesting(shown.select(*by, F.col("owner").alias("id"), "path"), by)
    counted = usage.groupBy(*by, "scope").agg(F.count(F.lit(1)).alias("stacks"), F.sum("evidence").alias("evidence"))
    out = {"scope": shown, "usage": usage, "region": regions, "count": counted, "attribution": _attributed(attribute_evidence(fact_evidence, evidence, owners, by, stored=False), by)}
    if project is not None:
        behind = _distinct_evidence(found, by, []).withColumnRenamed("scope", "dst")
        top = regions.filter("parent_id is null").select(*by, F.lit(project).alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("kind"))
        out["edge"] = lookup_join(top, behind, [*by, "dst"]).select(*by, F.concat_ws(":", F.lit("view-edge:contains"), "dst").alias("id"), "src", "dst", "kind", "evidence")
    return out


def module_view(modules: DataFrame, imports: DataFrame, by: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Module graph with its folder regions.

    ``modules``: ``path``, ``package_path``; ``imports``: ``path``, ``resolved_path``.  Nodes carry degrees, unresolved imports
    and the terminal folder of their (compressed) region; edges count imports between two modules.
    """
    edges = imports.select(*by, F.col("path").alias("src"), F.col("resolved_path").alias("dst"))
    known = modules.select(*by, F.col("path").alias("dst")).distinct()
    inside = edges.join(known, [*by, "dst"], "left_semi")
    relation = inside.groupBy(*by, "src", "dst").agg(F.count(F.lit(1)).alias("imports"))
    lost = edges.filter(F.col("dst").isNull()).groupBy(*by, F.col("src").alias("path")).agg(F.count(F.lit(1)).alias("unresolved"))
    counted = degrees(inside, by).drop("unresolved").withColumnRenamed("id", "path")
    tree = directory_tree(modules, by)
    chains = compress_chain(tree.drop("package_path"), by)
    regions = chain_groups(chains, by)
    folder = chains.select(*by, F.col("path").alias("_dir"), F.col("terminal").alias("region"))
    nodes = lookup_join(modules.withColumn("_dir", dir_name("path")), folder, [*by, "_dir"]).drop("_dir")
    nodes = lookup_join(lookup_join(nodes, counted, [*by, "path"]), lost, [*by, "path"]).fillna(0, ["in_degree", "out_degree", "unresolved"])
    return {"node": nodes, "edge": relation, "region": regions}


def analysis_stats(files: DataFrame, functions: DataFrame, models: DataFrame, calls: DataFrame, by: Sequence[str] = ("project_id",)) -> DataFrame:
    """Files, functions, models and unresolved calls per project, each counted before they meet."""
    keys = list(by)
    parts = [
        files.groupBy(*keys).agg(F.count(F.lit(1)).alias("files")),
        functions.filter(~F.coalesce("initializer", F.lit(False))).groupBy(*keys).agg(F.count(F.lit(1)).alias("functions")),
        models.groupBy(*keys).agg(F.count(F.lit(1)).alias("models")),
        calls.groupBy(*keys).agg(F.count_if(F.col("target").isNull()).alias("unresolved")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, keys, "full")
    return out.fillna(0)


def file_coverage(files: DataFrame, parsed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per file: parsed, partial (errors), unsupported (no grammar) or skipped (generated); ``parsed`` has ``path``, ``errors``."""
    seen = parsed.groupBy(*by, "path").agg(F.max("errors").alias("_errors"))
    joined = lookup_join(files, seen, [*by, "path"])
    status = (
        F.when(F.coalesce("generated", F.lit(False)), "skipped").when(F.col("language").isNull(), "unsupported")
        .when(F.col("_errors").isNull(), "skipped").when(F.col("_errors") > 0, "partial").otherwise("parsed")
    )
    return joined.withColumn("coverage", status).drop("_errors")
