"""Resolution joins: one match, no match and several matches are three different answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.commands import TOOL_TECHNOLOGY
from ..functions.names import lookup_key, mapped, normalize_identifier, normalize_route
from ..functions.paths import glob_to_regex
from ..plans import cut_lineage, lookup_join, only_value, rewritten
from .filters import glob_join, path_keys, pattern_keys


def unique_lookup(items: DataFrame, dictionary: DataFrame, on: Sequence[str], owner: str = "owner", by: Sequence[str] = ()) -> DataFrame:
    """Attach the owner of a key only when the dictionary names exactly one."""
    single = dictionary.groupBy(*by, *on).agg(only_value(owner).alias(owner)).filter(F.col(owner).isNotNull())
    return lookup_join(items, single, [*by, *on])


def dictionary_keys(entries: DataFrame, *columns: str, owner: str = "id") -> DataFrame:
    """Normalised (``key``, ``owner``) rows from array columns of a dictionary (package names, aliases)."""
    listed = F.flatten(F.array(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in columns]))
    return entries.select(F.explode(listed).alias("_raw"), F.col(owner).alias("owner")).select(
        lookup_key("_raw").alias("key"), "owner"
    ).filter(F.col("key") != "").distinct()


def resolve_dependencies(
    dependencies: DataFrame, packages: DataFrame, dictionary: DataFrame, by: Sequence[str] = (), local_first: bool = False
) -> DataFrame:
    """Target of each declared dependency: workspace package, else known technology, else external package.

    ``dependencies`` has ``name`` and ``version_range``; ``packages`` (``name``, ``package_id``); ``dictionary``
    (``key``, ``owner``).  Workspace packages count only for ``workspace:`` ranges unless ``local_first``.
    ``unmatched_workspace`` marks workspace ranges without a package (a warning).
    """
    local = packages.groupBy(*by, "name").agg(F.min("package_id").alias("_local"))
    known = dictionary.groupBy("key").agg(only_value("owner").alias("_technology"))
    joined = lookup_join(dependencies, local, [*by, "name"])
    joined = lookup_join(joined.withColumn("key", lookup_key("name")), known, ["key"]).drop("key")
    workspace = F.coalesce(F.col("version_range").startswith("workspace:"), F.lit(False))
    use_local = F.col("_local").isNotNull() & (workspace | F.lit(local_first))
    kind = F.when(use_local, "workspace-package").when(F.col("_technology").isNotNull(), "technology").otherwise("external-package")
    target = F.when(use_local, F.col("_local").cast("string")).otherwise(F.coalesce(F.col("_technology").cast("string"), F.col("name")))
    return (
        joined.withColumn("target_kind", kind)
        .withColumn("target", target)
        .withColumn("unmatched_workspace", workspace & F.col("_local").isNull())
        .drop("_local", "_technology")
    )


def match_routes(requests: DataFrame, endpoints: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Link a request (``id``, ``address``, ``method``) to the only endpoint with the same route and method (or ANY)."""
    served = endpoints.select(*by, F.col("id").alias("endpoint_id"), normalize_route("address").alias("_route"), "method")
    per_route = served.groupBy(*by, "_route", "method").agg(F.min("endpoint_id").alias("_low"), F.max("endpoint_id").alias("_high"))
    asked = requests.withColumn("_route", normalize_route("address"))
    wanted = asked.select(*by, "_route", "method").distinct().select(
        *by, "_route", F.col("method").alias("_asked"), F.explode(F.array_distinct(F.array("method", F.lit("ANY")))).alias("method")
    )
    hits = wanted.join(per_route, [*by, "_route", "method"])
    answers = hits.groupBy(*by, "_route", F.col("_asked").alias("method")).agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    answers = answers.select(*by, "_route", "method", F.when(F.col("_low") == F.col("_high"), F.col("_low")).alias("endpoint_id"), F.lit(True).alias("_found"))
    joined = lookup_join(asked, answers, [*by, "_route", "method"])
    status = F.when(F.col("endpoint_id").isNotNull(), "matched").when(F.col("_found"), "ambiguous").otherwise("unmatched")
    return joined.withColumn("match", status).drop("_route", "_found")


def resolve_references(fields: DataFrame, models: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Target model of a reference (``reference``, ``path``): the only model of that label in the same file, else the only
    one anywhere; ``reason`` tells why there is none.  Labels compare case-insensitively."""
    named = models.select(*by, F.lower("label").alias("_key"), F.col("path").alias("path"), F.col("id").alias("_model"))
    local = named.groupBy(*by, "_key", "path").agg(F.min("_model").alias("_l0"), F.max("_model").alias("_l1"))
    anywhere = named.groupBy(*by, "_key").agg(F.min("_model").alias("_g0"), F.max("_model").alias("_g1"))
    joined = lookup_join(fields.withColumn("_key", F.lower("reference")), local, [*by, "_key", "path"])
    joined = lookup_join(joined, anywhere, [*by, "_key"])
    target = F.coalesce(F.when(F.col("_l0") == F.col("_l1"), F.col("_l0")), F.when(F.col("_g0") == F.col("_g1"), F.col("_g0")))
    confidence = F.when(F.col("_l0") == F.col("_l1"), "source").when(F.col("_g0") == F.col("_g1"), "inferred").otherwise("unresolved")
    reason = F.when(F.col("_g0").isNull(), "missing").when(target.isNull(), "ambiguous")
    return (
        joined.withColumn("target", target).withColumn("confidence", confidence).withColumn("reason", reason)
        .drop("_key", "_l0", "_l1", "_g0", "_g1")
    )


# Verbs that make a database call a write.
WRITE_VERB = r"(?i)insert|update|delete|save|create"


def db_edges(calls: DataFrame, models: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Read/write edges between database calls (``id``, ``callee``, ``names``) and the models they name.

    A model is named by an argument or as a receiver segment of the callee.
    """
    receivers = F.filter(F.split("callee", r"\.|::"), lambda part: part != "")
    receivers = F.transform(F.slice(receivers, 1, F.greatest(F.size(receivers) - 1, F.lit(0))), lambda part: F.lower(part))
    keyed = calls.select(*by, "id", "callee", F.explode(F.array_distinct(F.concat(
        F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda n: F.concat(F.lit("="), n)),
        F.transform(receivers, lambda n: F.concat(F.lit("~"), n)),
    ))).alias("_key"))
    named = models.select(*by, F.col("id").alias("model"), F.explode(F.array(F.concat(F.lit("="), "label"), F.concat(F.lit("~"), F.lower("label")))).alias("_key"))
    pairs = keyed.join(named, [*by, "_key"]).select(*by, "id", "callee", "model").distinct()
    writes = F.col("callee").rlike(WRITE_VERB)
    return pairs.select(
        *by,
        F.when(writes, F.col("id")).otherwise(F.col("model")).alias("src"),
        F.when(writes, F.col("model")).otherwise(F.col("id")).alias("dst"),
        F.when(writes, "writes").otherwise("reads").alias("kind"),
    )


def link_types(values: DataFrame, models: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Links between values and the models their annotation names (``symbol``), in both directions."""
    pairs = lookup_join(values.select(*by, F.col("id").alias("value"), "symbol"), models.select(*by, F.col("id").alias("model"), "symbol"), [*by, "symbol"], "inner")
    return pairs.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col("value").alias("id"), F.col("model").alias("linked"), F.lit("type").alias("link")),
                F.struct(F.col("model").alias("id"), F.col("value").alias("linked"), F.lit("value").alias("link")),
            )
        ).alias("_l"),
    ).select(*by, "_l.*")


def resolve_script(fragments: DataFrame, packages: DataFrame, scripts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Script a fragment (``package_id``, ``selector``, ``script_name``) runs: in the package its selector names (by name,
    then by path), else in its own package."""
    named = packages.groupBy(*by, F.col("name").alias("selector")).agg(F.min("package_id").alias("_by_name"))
    placed = packages.groupBy(*by, F.col("package_path").alias("_path")).agg(F.min("package_id").alias("_by_path"))
    clean = F.regexp_replace("selector", r"^\./", "")
    joined = lookup_join(lookup_join(fragments, named, [*by, "selector"]).withColumn("_path", clean), placed, [*by, "_path"])
    target = F.when(F.col("selector").isNotNull(), F.coalesce("_by_name", "_by_path")).otherwise(F.col("package_id"))
    keyed = joined.withColumn("_target", target).drop("_by_name", "_by_path", "_path")
    known = scripts.groupBy(*by, F.col("package_id").alias("_target"), F.col("name").alias("script_name")).agg(F.min("script_id").alias("script_id"))
    return lookup_join(keyed, known, [*by, "_target", "script_name"]).drop("_target")


def navigation_context(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Counterpart of a node in another view, by identity or recorded ownership only.

    Tiers: same id, its owner, the only node it owns, several owned nodes (as members), the only group listing it.
    ``nodes``: ``id``, ``owner``, ``members`` (array or null); ``targets``: ``id``, ``owner``.
    """
    wanted = targets.select(F.col("id").alias("target_id"), F.col("owner").alias("target_owner"))
    ids = nodes.select(F.col("id").alias("match"))
    direct = wanted.join(ids, F.col("target_id") == F.col("match")).select("target_id", "match", F.lit(1).alias("tier"))
    owner = wanted.join(ids, F.col("target_owner") == F.col("match")).select("target_id", "match", F.lit(2).alias("tier"))
    owned = nodes.filter(F.col("owner").isNotNull()).select(F.col("owner").alias("target_id"), F.col("id").alias("match"), F.lit(3).alias("tier"))
    owned = owned.join(wanted.select("target_id"), "target_id", "left_semi")
    listed = nodes.select(F.col("id").alias("match"), F.explode("members").alias("target_id"), F.lit(4).alias("tier"))
    listed = listed.join(wanted.select("target_id"), "target_id", "left_semi").select("target_id", "match", "tier")
    hits = direct.unionByName(owner).unionByName(owned).unionByName(listed)
    per = hits.groupBy("target_id", "tier").agg(F.min("match").alias("_low"), F.max("match").alias("_high"), F.count_distinct("match").alias("n"))
    usable = per.filter((F.col("tier") < 4) | (F.col("n") == 1))
    best = usable.groupBy("target_id").agg(F.min_by(F.struct("tier", "_low", "n"), "tier").alias("_b"))
    joined = lookup_join(wanted.select("target_id"), best, ["target_id"])
    names = F.when(F.col("_b.tier") == 1, "direct").when(F.col("_b.tier") == 2, "owner").when(F.col("_b.tier") == 3, F.when(F.col("_b.n") == 1, "owned").otherwise("members")).when(F.col("_b.tier") == 4, "group")
    return joined.select(
        F.col("target_id").alias("id"),
        F.coalesce(names, F.lit("search")).alias("context"),
        F.when(F.coalesce("_b.n", F.lit(0)) == 1, F.col("_b._low")).alias("match"),
        F.coalesce("_b.n", F.lit(0)).alias("candidates"),
    )


def resource_identity_key(type_: Column, account: Column, identifier: Column) -> Column:
    """Identity key of a configured resource; null when the identifier is masked, missing or not stable on its own."""
    clean = F.when(~identifier.rlike(r"^\**$"), identifier)
    # Types whose identifier is stable alone, and types that also need the account.
    alone, scoped = type_.isin("D1", "KV"), type_.isin("R2", "Service binding")
    usable = F.when(alone | (scoped & (F.coalesce(account, F.lit("")) != "")), clean)
    return F.when(usable.isNotNull(), F.to_json(F.array(type_, F.coalesce(F.when(account != "", account), F.lit("stable-id")), usable)))


def resolve_identity(configurations: DataFrame, key: Column, row_id: str = "id") -> DataFrame:
    """Give each configuration occurrence its entity: equal identity keys share a confirmed one, rows without a key stay
    separate and unconfirmed.  Every occurrence is kept as a row."""
    return configurations.withColumn("_key", key).withColumn(
        "entity", F.coalesce(F.col("_key"), F.concat(F.lit("occurrence:"), F.col(row_id).cast("string")))
    ).withColumn("status", F.when(F.col("_key").isNotNull(), "confirmed").otherwise("unconfirmed")).drop("_key")


def detect_technologies(
    registry: DataFrame,
    files: DataFrame | None = None,
    imports: DataFrame | None = None,
    dependencies: DataFrame | None = None,
    tools: DataFrame | None = None,
) -> DataFrame:
    """Technologies of a corpus as (``path``, ``stack_id``, ``channel``).

    ``registry`` has ``stack_id``, ``ecosystem``, ``identifier``, ``channel`` (extension, config, import, dependency,
    command).  Import prefixes are expanded on the import side so that every channel is an equality join.
    """
    parts = []

    def rows(channel: str) -> DataFrame:
        return registry.filter(F.col("channel") == channel).select("stack_id", "ecosystem", "identifier").distinct()

    if files is not None:
        parts.append(files.select("path", F.col("extension").alias("identifier")).join(rows("extension").drop("ecosystem"), "identifier").select("path", "stack_id", F.lit("extension").alias("channel")))
        parts.append(files.select("path", F.lower("name").alias("identifier")).join(rows("config").drop("ecosystem"), "identifier").select("path", "stack_id", F.lit("config").alias("channel")))
    if imports is not None:
        def prefixes(separator: str, pattern: str) -> Column:
            pieces = F.split("specifier", pattern)
            return F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda n: F.array_join(F.slice(pieces, 1, n), separator))

        expanded = imports.select("path", "ecosystem", "specifier").distinct().withColumn(
            "identifier", F.explode(F.array_distinct(F.concat(prefixes("/", "/"), prefixes(".", r"\."))))
        )
        parts.append(expanded.join(rows("import"), ["ecosystem", "identifier"]).select("path", "stack_id", F.lit("import").alias("channel")))
    if dependencies is not None:
        keyed = dependencies.select("path", "ecosystem", normalize_identifier("ecosystem", "name").alias("identifier")).distinct()
        known = rows("dependency").select("stack_id", "ecosystem", normalize_identifier("ecosystem", "identifier").alias("identifier"))
        parts.append(keyed.join(known, ["ecosystem", "identifier"]).select("path", "stack_id", F.lit("dependency").alias("channel")))
    if tools is not None:
        parts.append(tools.select("path", mapped(F.lower("tool"), TOOL_TECHNOLOGY).alias("stack_id"), F.lit("command").alias("channel")).filter(F.col("stack_id").isNotNull()))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def match_members(patterns: DataFrame, packages: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Workspace members selected by patterns, and positive patterns that matched no package."""
    members = glob_join(packages, patterns, by)
    positive = patterns.filter(~F.col("pattern").startswith("!"))
    keyed = pattern_keys(positive.select(*by, "pattern").distinct(), F.col("pattern")).withColumn("_regex", glob_to_regex("pattern"))
    own = path_keys(packages.select(*by, "path").distinct(), F.col("path"))
    used = own.join(keyed, [*by, "_key", "_part"]).filter(F.rlike(F.col("path"), F.col("_regex"))).select(*by, "pattern").distinct()
    return members, positive.join(used, [*by, "pattern"], "left_anti")


# A released version per ecosystem.
VERSION_RULE = {
    "pypi": r"(?i)^v?(?:\d+!)?\d+(?:\.\d+)*(?:(?:a|b|rc)\d+)?(?:\.post\d+)?(?:\.dev\d+)?(?:\+[\w.]+)?$",
    "composer": r"(?i)^(?:dev-[\w./-]+|v?\d+(?:\.[\dx*]+){0,3}(?:[-.]?(?:dev|alpha|beta|rc|patch)\d*)?)$",
}
VERSION_RULE_OTHER = r"^v?\d+(?:\.\d+){1,3}(?:-[0-9A-Za-z.-]+)?(?:\+[0-9A-Za-z.-]+)?$"


def valid_version(ecosystem: Column, version: Column) -> Column:
    out = None
    for name, rule in VERSION_RULE.items():
        out = F.when(ecosystem == name, version.rlike(rule)) if out is None else out.when(ecosystem == name, version.rlike(rule))
    return out.otherwise(version.rlike(VERSION_RULE_OTHER))


def _own_packages(reach: DataFrame, projects: DataFrame, held: DataFrame, by: Sequence[str]) -> DataFrame:
    """The project's own package (``_own``) in each lock it reaches, where the lock holds exactly one."""
    place = [*by, "project_dir", "ecosystem", "lock_dir"]
    packages = held.filter(F.col("ecosystem").isin("cargo", "pypi")).select(*by, "lock_dir", "ecosystem", F.col("_key").alias("_own"), "importer", F.col("source_identity").alias("_from"))
    at = reach.select(*place).distinct().join(projects, [*by, "project_dir", "ecosystem"])
    # A package is the project's own by its folder; a Cargo package without a source is of this workspace.
    own = at.join(packages, [*by, "lock_dir", "ecosystem", "_own"]).filter((F.col("importer") == F.col("project_dir")) | ((F.col("ecosystem") == "cargo") & F.col("_from").isNull()))
    return cut_lineage(own.groupBy(*place, "_own").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select(*place, "_own"))


def _asked_by_project(hits: DataFrame, alone: DataFrame, asks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Locked rows that the project's own package in the lock asks for; all rows where the lock has no such package or several
    (``_owned`` is null)."""
    place = [*by, "project_dir", "ecosystem", "lock_dir"]
    listed = asks.select(
        *by, "lock_dir", "ecosystem", normalize_identifier("ecosystem", "owner").alias("_own"), normalize_identifier("ecosystem", "name").alias("_key"), F.col("version").alias("_version"), F.col("source_identity").alias("_source")
    )
    asked = listed.join(alone, [*by, "lock_dir", "ecosystem", "_own"]).alias("a")
    free = hits.filter("_owned is null")
    bound = hits.filter("_owned").alias("h")
    same = F.lit(True)
    for column in [*place, "_key"]:
        same = same & (F.col(f"h.{column}") == F.col(f"a.{column}"))
    fits = (F.col("_version").isNull() | (F.col("_version") == F.col("h.version"))) & (F.col("_source").isNull() | (F.col("_source") == F.col("h.source_identity")))
    return free.unionByName(bound.join(asked, same & fits, "left_semi"))


def lock_asks(locks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """What packages of locks ask for, a row each: ``lock_dir``, ``ecosystem``, ``owner``, ``name``, ``version``, ``source_identity``."""
    return locks.select(*by, "lock_dir", "ecosystem", F.col("name").alias("owner"), F.explode("asks").alias("a")).select(*by, "lock_dir", "ecosystem", "owner", "a.*")


def resolve_versions(dependencies: DataFrame, locks: DataFrame, members: DataFrame | None = None, by: Sequence[str] = (), asks: DataFrame | None = None) -> DataFrame:
    """Locked version of each dependency from its nearest applicable lock that knows it.

    ``dependencies``: ``dependency_id``, ``project_dir``, ``ecosystem``, ``name``, ``version_range``; ``locks``:
    ``lock_dir``, ``ecosystem``, ``name``, ``version`` and optional ``descriptor``, ``source_identity``, ``framework``.
    Several versions or sources in that lock are ambiguous, except one per framework for NuGet.

    A lock applies to the project of its own folder and to the projects its root lists: ``members`` (``lock_dir``,
    ``ecosystem``, ``project_dir``, see :func:`match_members`).  Optional columns of ``dependencies``: ``lock_path``, the
    only lock folder to look at, and ``lock_disabled``.

    Where ``dependencies`` has a ``project_name`` and ``locks`` an ``importer``, ``asks`` (see :func:`lock_asks`) tells what packages of
    Cargo and Python locks ask for: a lock that holds the project itself exactly once gives only versions and sources that the
    project asks for there.
    """
    wanted = dependencies.withColumn("_key", normalize_identifier("ecosystem", "name"))
    held = locks.withColumn("_key", normalize_identifier("ecosystem", "name")).withColumn("_bad", ~valid_version(F.col("ecosystem"), F.col("version")))
    chosen = F.col("lock_path") if "lock_path" in wanted.columns else F.lit(None).cast("string")
    disabled = F.coalesce("lock_disabled", F.lit(False)) if "lock_disabled" in wanted.columns else F.lit(False)
    # Read by each of the steps below, and so are the locks.
    wanted = rewritten(wanted.withColumn("_chosen", F.when(disabled, "").otherwise(F.coalesce(chosen, F.lit("*")))))
    held = rewritten(held)
    asked = wanted.select(*by, "project_dir", "ecosystem", "_key", "version_range", "_chosen").distinct()
    reach = asked.filter("_chosen <> ''").withColumn("lock_dir", F.when(F.col("_chosen") == "*", F.col("project_dir")).otherwise(F.col("_chosen")))
    if members is not None:
        listed = members.select(*by, "lock_dir", "ecosystem", "project_dir").filter("lock_dir <> project_dir").distinct()
        reach = reach.unionByName(asked.filter("_chosen = '*'").join(listed, [*by, "project_dir", "ecosystem"]))
    if asks is not None:
        projects = wanted.select(*by, "project_dir", "ecosystem", normalize_identifier("ecosystem", "project_name").alias("_own")).distinct()
        alone = _own_packages(reach, projects, held, by)
        # Marked before a row meets all versions of its name.
        reach = lookup_join(reach, alone.select(*by, "project_dir", "ecosystem", "lock_dir", F.lit(True).alias("_owned")).distinct(), [*by, "project_dir", "ecosystem", "lock_dir"])
    hits = reach.join(held.select(*by, "lock_dir", "ecosystem", "_key", "version", "descriptor", "source_identity", "framework", "_bad"), [*by, "lock_dir", "ecosystem", "_key"])
    hits = hits.filter(F.col("descriptor").isNull() | (F.col("descriptor") == F.col("version_range"))).drop("descriptor")
    if asks is not None:
        hits = _asked_by_project(hits, alone, asks, by)
    # One distinct count only: a second one would write every row three times.
    source = F.coalesce("source_identity", F.lit(""))
    per_lock = hits.groupBy(*by, "project_dir", "ecosystem", "_key", "version_range", "_chosen", "lock_dir").agg(
        F.min("version").alias("_v0"),
        F.max("version").alias("_v1"),
        (F.min(source) != F.max(source)).alias("_sources"),
        F.max("_bad").alias("_bad"),
        F.count(F.lit(1)).alias("_rows"),
        F.count_distinct("framework").alias("_frameworks"),
    )
    depth = F.when(F.col("lock_dir") == ".", 0).otherwise(F.length("lock_dir"))
    nearest = per_lock.groupBy(*by, "project_dir", "ecosystem", "_key", "version_range", "_chosen").agg(
        F.max_by(F.struct("lock_dir", "_v0", "_v1", "_sources", "_bad", "_rows", "_frameworks"), depth).alias("_l")
    )
    joined = lookup_join(wanted, nearest, [*by, "project_dir", "ecosystem", "_key", "version_range", "_chosen"])
    per_framework = (F.col("ecosystem") == "nuget") & (F.col("_l._frameworks") == F.col("_l._rows"))
    one = F.col("_l._v0") == F.col("_l._v1")
    status = (
        F.when(F.col("_l").isNull(), "unlocked")
        .when(F.col("_l._bad"), "unsupported")
        .when((~one & ~per_framework) | F.col("_l._sources"), "ambiguous")
        .when(one, "resolved")
        .otherwise("per-framework")
    )
    return joined.select(
        *dependencies.columns,
        F.col("_l.lock_dir").alias("lock_dir"),
        status.alias("status"),
        F.when(status == "resolved", F.col("_l._v0")).alias("resolved_version"),
    )
