"""Operators on a finished architecture model.

Nodes: ``id``, ``kind``, ``parent_id``, ``environments`` (array), ``auxiliary``, ``purpose``, ``logical_owner``, …
Edges: ``id``, ``src``, ``dst``, ``kind``, ``environment``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import Grown, cut_lineage, lookup_join, only_value, rewritten
from .bundles import bundle_arch
from .filters import with_both_ends
from .traverse import adjacency, reach

# Relation and entity kinds of the model.
RUNTIME_KINDS = (
    "http-request", "service-use", "data-operation", "message", "process-start", "deployment-config", "selects-workload",
    "routes-to-service", "proxy-pass", "upstream-server", "cdn-domain", "delivery-origin",
)
IO_KINDS = (
    "flow-loads", "flow-input", "flow-starts", "flow-deploys", "flow-generates", "flow-applies", "flow-serves", "flow-artifact",
    "build-output", "publishes-artifact",
)
ORDER_KINDS = ("flow-invokes", "flow-precedes")
STRUCTURAL_KINDS = ("flow-definition", "flow-configures")
PATH_PURPOSES = {"start": ("start", "serve"), "publish": ("build", "package", "deploy"), "database": ("generate", "apply")}
DEFINITION_KINDS = ("application", "code-package", "component", "shared-code", "code-definition")
UNIT_KINDS = ("application", "component", "code-package", "shared-code")
LOCATION_ONLY = ("local", "cloud", "build", "deployment")
MAJOR_KINDS = ("application", "component", "shared-code", "code-package", "resource", "external-service", "external-program")
REFERENCE_KINDS = ("code-reference", "declaration-dependency", "calls", "callback", "handles", "registers-event")


def env_filter(nodes: DataFrame, environment: str = "", include_auxiliary: bool = False, ancestors: DataFrame | None = None) -> DataFrame:
    """Nodes that exist in an environment.

    Without environments, and for applications, always; ``except:x`` lists mean every environment but those.  A node is
    auxiliary when it or any ancestor (``id``, ``ancestor``) is.
    """
    if not include_auxiliary:
        marked = nodes.filter("auxiliary").select(F.col("id").alias("ancestor"))
        hidden = ancestors.join(marked, "ancestor", "left_semi").select("id") if ancestors is not None else marked.withColumnRenamed("ancestor", "id")
        nodes = nodes.join(hidden.distinct(), "id", "left_anti")
    if not environment:
        return nodes
    listed = F.coalesce("environments", F.array().cast("array<string>"))
    except_only = F.forall(listed, lambda name: name.startswith("except:")) & ~F.array_contains(listed, f"except:{environment}")
    return nodes.filter((F.size(listed) == 0) | (F.col("kind") == "application") | F.array_contains(listed, environment) | except_only)


def env_edges(edges: DataFrame, nodes: DataFrame, environment: str = "") -> DataFrame:
    """Edges between given nodes that hold in an environment (edges without one hold everywhere)."""
    if environment:
        edges = edges.filter(F.coalesce("environment", F.lit("")).isin("", environment))
    return with_both_ends(edges, nodes)


def environment_meaning(nodes: DataFrame) -> DataFrame:
    """Add ``meaning`` (shared, definition, unknown, explicit, default) and the environment names it is about.

    Optional columns: ``shared_environments`` (array), ``occurrence`` (boolean: only a configuration location).
    """
    empty = F.array().cast("array<string>")
    names = F.filter(F.coalesce("environments", empty), lambda name: ~name.startswith("except:"))
    shared = F.coalesce("shared_environments", empty) if "shared_environments" in nodes.columns else empty
    placed = F.coalesce("occurrence", F.lit(False)) if "occurrence" in nodes.columns else F.lit(False)
    location = placed & (F.size(names) == 1) & F.get(names, F.lit(0)).isin(*LOCATION_ONLY)
    meaning = (
        F.when(F.size(shared) > 1, "shared").when(F.col("kind").isin(*DEFINITION_KINDS), "definition")
        .when(location | (F.size(names) == 0), "unknown").when(F.size(names) > 1, "explicit")
        .when(F.get(names, F.lit(0)) == "default", "default").otherwise("explicit")
    )
    about = F.when(meaning == "shared", F.array_sort(shared)).when(meaning.isin("explicit", "default"), names).otherwise(empty)
    return nodes.withColumn("meaning", meaning).withColumn("names", about)


def content_choices(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Choices a model offers: explicit environments, other partitions, and the path types that occur.

    Columns ``group`` (environment / partition / path), ``choice``, ``nodes``.
    """
    placed = environment_meaning(nodes)
    explicit = placed.filter("meaning = 'explicit'").select(F.lit("environment").alias("group"), F.explode("names").alias("choice"))
    partition = placed.filter("meaning <> 'explicit'").select(F.lit("partition").alias("group"), F.concat_ws(":", "meaning", F.array_join("names", "+")).alias("choice"))
    purposes = None
    for path, allowed in PATH_PURPOSES.items():
        purposes = F.when(F.col("purpose").isin(*allowed), path) if purposes is None else purposes.when(F.col("purpose").isin(*allowed), path)
    by_purpose = nodes.filter("kind = 'tool-operation'").select(F.lit("path").alias("group"), purposes.alias("choice")).filter(F.col("choice").isNotNull())
    apart = nodes.filter("kind <> 'tool-operation'").select("id")
    runtime = with_both_ends(edges.filter(F.col("kind").isin(*RUNTIME_KINDS)), apart).select(F.lit("path").alias("group"), F.lit("runtime").alias("choice"))
    return explicit.unionByName(partition).unionByName(by_purpose).unionByName(runtime).groupBy("group", "choice").agg(F.count(F.lit(1)).alias("nodes"))


def _marks(placed: DataFrame, **marks: Column) -> tuple[DataFrame, dict[str, int]]:
    """One row per id with a bit for every condition that a row of the id meets, and the bit of each condition."""
    bits = {name: 1 << at for at, name in enumerate(marks)}
    found = placed.groupBy("id").agg(*[F.bool_or(condition).alias(f"_{name}") for name, condition in marks.items()])
    summed = F.lit(0)
    for name, bit in bits.items():
        summed = summed + F.when(F.col(f"_{name}"), bit).otherwise(0)
    return found.select("id", summed.alias("marks")), bits


def _with_marks(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """Edges whose two ends have marks, with the marks of both."""
    for end in ("src", "dst"):
        edges = edges.join(marks.withColumnsRenamed({"id": end, "marks": f"{end}_marks"}), end)
    return edges


def content_range(nodes: DataFrame, edges: DataFrame, path: str | None = None, environment: str | None = None, meaning: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Typed slice of a model: by path type (start, publish, database, runtime), explicit environment, or meaning
    (``definition``, ``default``, ``unknown``).

    Returns nodes (``id``, ``role``: core > peer > support) and edge ids.  A slice grows only along command order and
    typed input/output edges; artifacts are the only shared nodes it may cross.  Edges meet what is known of their ends once; the
    rounds move only ids of operations and artifacts, stored once each, so the plan of a round does not grow with the rounds before it.
    An edge's part in the range follows from its ends, so edge ids are read from ``edges`` (which must be the same when read
    again) only when they are asked for.
    """
    kinds = lambda *names: F.col("kind").isin(*names)
    own, io, order, structural = kinds(*RUNTIME_KINDS), kinds(*IO_KINDS), kinds(*ORDER_KINDS), kinds(*STRUCTURAL_KINDS)
    edges = edges.select("id", "src", "dst", "kind", "environment").filter(own | io | order | structural)
    placed = rewritten(environment_meaning(nodes).select("id", "kind", "purpose", "parent_id", "logical_owner", "meaning", "names"))
    op = F.col("kind") == "tool-operation"
    if path and path != "runtime":
        allowed = op & F.col("purpose").isin(*PATH_PURPOSES[path])
    elif environment:
        allowed = op & (F.col("meaning").isin("unknown", "definition") | F.array_contains("names", environment))
    else:
        allowed = op if path is None else F.lit(False)
    fits = (F.col("meaning") == "explicit") & F.array_contains("names", environment) if environment else F.col("meaning") == meaning
    marks, bits = _marks(
        placed, op=op, allowed=allowed, script=op & ((F.col("purpose") == "script") | allowed), artifact=F.col("kind") == "artifact", seed=fits, apart=~op, unit=kinds(*UNIT_KINDS),
        config=F.col("kind") == "execution-config", explained=kinds("application", "code-package", "shared-code", "code-definition"),
    )
    marks = rewritten(marks)
    real = rewritten(_with_marks(edges.drop("id"), marks))
    src = lambda name: F.col("src_marks").bitwiseAND(bits[name]) != 0
    dst = lambda name: F.col("dst_marks").bitwiseAND(bits[name]) != 0
    marked = lambda name: marks.filter(F.col("marks").bitwiseAND(bits[name]) != 0).select("id")
    ends = lambda frame: frame.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    rank = {"support": 0, "peer": 1, "core": 2}
    roles: list[DataFrame] = []

    def add(frame: DataFrame, role: str) -> None:
        roles.append(frame.select("id", F.lit(rank[role]).alias("rank")))

    def final(kept: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Roles with the support of what lies above, and the ids of the edges ``kept``."""
        from .tree import ancestors

        ranked = cut_lineage(merged())
        above = ancestors(placed.select("id", "parent_id")).filter("distance > 0").join(ranked.select("id"), "id", "left_semi").select(F.col("ancestor").alias("id")).distinct()
        every = ranked.unionByName(above.withColumn("rank", F.lit(0))).groupBy("id").agg(F.max("rank").alias("rank"))
        role = F.when(F.col("rank") == 2, "core").when(F.col("rank") == 1, "peer").otherwise("support")
        return every.select("id", role.alias("role")), kept.select("id").distinct()

    def merged() -> DataFrame:
        rows = roles[0]
        for frame in roles[1:]:
            rows = rows.unionByName(frame)
        return rows.groupBy("id").agg(F.max("rank").alias("rank"))

    if meaning == "definition":
        add(marked("unit"), "core")
        defined = kinds("flow-definition", "flow-serves") & (src("unit") | dst("unit")) & (src("config") | dst("config"))
        add(ends(real.filter(defined)), "peer")
        units = marked("unit").select(F.col("id").alias("logical_owner"))
        code = placed.filter("kind = 'code-definition'").join(units, "logical_owner", "left_semi")
        bridge = real.filter("kind = 'flow-configures'").select("src", "dst").join(code.select(F.col("id").alias("src"), F.col("logical_owner").alias("_a")), "src").join(
            placed.filter("kind = 'execution-config'").select(F.col("id").alias("dst"), F.col("logical_owner").alias("_b")), "dst"
        )
        bridge = cut_lineage(bridge.filter("_a = _b").select("src", "dst", "_a").distinct())
        add(bridge.select(F.col("src").alias("id")), "support")
        add(bridge.select(F.col("dst").alias("id")), "peer")
        bridged = edges.filter("kind = 'flow-configures'").join(bridge, ["src", "dst"], "left_semi")
        owned = edges.filter("kind = 'flow-definition'").join(bridge.select(F.col("src").alias("dst"), F.col("_a").alias("src")), ["src", "dst"], "left_semi")
        return final(_with_marks(edges, marks).filter(defined).select("id").unionByName(bridged.select("id")).unionByName(owned.select("id")))

    ids = marks.select("id").limit(0)
    if path == "runtime":
        direct, frontier = own & src("apart") & dst("apart"), ids
        add(ends(real.filter(direct)), "core")
    elif path:
        direct, frontier = F.lit(False), marked("allowed")
        add(frontier, "core")
    else:
        elsewhere = (F.coalesce("environment", F.lit("")) != "") & (F.col("environment") != environment) if environment else F.lit(False)
        barred = (src("op") & ~src("allowed")) | (dst("op") & ~dst("allowed"))
        direct = (own | io | structural) & (src("seed") | dst("seed")) & (own | ~(elsewhere | barred))
        near = cut_lineage(ends(real.filter(direct)))
        add(marked("seed"), "core")
        add(near, "peer")
        seeds = marked("seed").join(marked("op"), "id", "left_semi")
        frontier = seeds.unionByName(near.join(marked("allowed"), "id", "left_semi")).distinct()

    # Input and output of operations: `back` leads from what is shared to operations the range may enter.
    used = real.filter(io & src("op")).select(F.col("src").alias("op"), F.col("dst").alias("other"), dst("artifact").alias("artifact"), (kinds("flow-generates") & src("allowed")).alias("back"))
    used = used.unionByName(real.filter(io & dst("op")).select(F.col("dst").alias("op"), F.col("src").alias("other"), src("artifact").alias("artifact"), (kinds("flow-input") & dst("allowed")).alias("back")))
    called = order & src("op") & (src("script") | (kinds("flow-precedes") if path == "start" else F.lit(False)))
    frontier = cut_lineage(frontier)
    if not frontier.isEmpty():
        used, ordered = rewritten(used), rewritten(real.filter(called).select("src", "dst"))
        links = adjacency(real.filter("kind = 'flow-artifact'"), "both")
    done, shared = Grown(), Grown()
    done.add(frontier)
    shared.add(ids)
    while not frontier.isEmpty():
        done.close_round()
        shared.close_round()
        callers = ordered.join(frontier.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
        met = used.filter("artifact").join(frontier.withColumnRenamed("id", "op"), "op", "left_semi").select(F.col("other").alias("id")).distinct()
        spread = cut_lineage(reach(links, met.join(shared.rows(), "id", "left_anti"), symmetric=True).select("id").distinct())
        shared.add(spread)
        readers = used.filter("back").join(spread.withColumnRenamed("id", "other"), "other", "left_semi").select(F.col("op").alias("id"))
        frontier = cut_lineage(callers.unionByName(readers).distinct().join(done.rows(), "id", "left_anti"))
        done.add(frontier)
    done, shared = done.rows().distinct(), shared.rows().distinct()
    add(done, "peer")
    add(shared, "peer")
    add(used.join(done.withColumnRenamed("id", "op"), "op", "left_semi").select(F.col("other").alias("id")).distinct(), "peer")

    substance = cut_lineage(merged().select("id"))
    served = real.filter("kind = 'flow-serves'").join(substance.withColumnRenamed("id", "src"), "src", "left_semi")
    add(served.select(F.col("dst").alias("id")), "peer")
    for end, other, explains in (("src", "dst", dst("explained")), ("dst", "src", src("explained"))):
        tie = real.filter(structural & explains).join(substance.withColumnRenamed("id", end), end, "left_semi")
        add(tie.select(F.col(other).alias("id")), "support")
    # Every edge between ends of the range, by what the rounds found of the two.
    state = marks
    for name, found in (("done", done), ("shared", shared), ("substance", substance)):
        bits[name] = 1 << len(bits)
        state = lookup_join(state, found.withColumn("_found", F.lit(bits[name])), ["id"]).select("id", (F.col("marks") + F.coalesce("_found", F.lit(0))).alias("marks"))
    kept = (
        direct | (called & dst("done")) | (io & ((src("op") & src("done")) | (dst("op") & dst("done")))) | (kinds("flow-artifact") & (src("shared") | dst("shared")))
        | (kinds("flow-input") & src("shared") & dst("allowed")) | (kinds("flow-generates") & dst("shared") & src("allowed"))
        | (kinds("flow-serves") & src("substance")) | (structural & ((src("substance") & dst("explained")) | (dst("substance") & src("explained"))))
    )
    return final(_with_marks(edges, state).filter(kept))


def scope_projection(nodes: DataFrame, edges: DataFrame, ancestors: DataFrame, scope: str | None = None, environment: str = "") -> tuple[DataFrame, DataFrame]:
    """Owners of a scope view and the relations between them.

    A node is shown as the child of the scope on its own chain, as itself when it is the scope or above it, else as its
    root.  ``ancestors`` includes each node at distance 0.
    """
    chain = ancestors.join(nodes.select("id"), "id", "left_semi")
    root = chain.groupBy("id").agg(F.max_by("ancestor", "distance").alias("_root"))
    if scope is None:
        owners = root.select("id", F.col("_root").alias("owner"))
    else:
        at = chain.filter(F.col("ancestor") == scope).select("id", F.col("distance").alias("_at"))
        below = chain.join(at, "id").filter(F.col("distance") == F.col("_at") - 1).select("id", F.col("ancestor").alias("_child"))
        above = ancestors.filter(F.col("id") == scope).select(F.col("ancestor").alias("id"), F.lit(True).alias("_above"))
        joined = lookup_join(lookup_join(root, below, ["id"]), above, ["id"])
        owners = joined.select("id", F.coalesce("_child", F.when(F.col("_above"), F.col("id")), "_root").alias("owner"))
    owners = owners.join(nodes.select(F.col("id").alias("owner")), "owner", "left_semi").select("id", "owner")
    return owners, bundle_arch(env_edges(edges, nodes, environment), owners)


def ownership(nodes: DataFrame, files: DataFrame, runtime_candidates: DataFrame | None = None) -> DataFrame:
    """Scope chain of each node as rows: (``id``, ``scope``, ``kind``, ``level``).

    project → context (the only runtime candidate, an observed service, or unclassified) → directories → file →
    function; nodes outside known files belong to a group.  ``nodes``: ``id``, ``kind``, ``path``, ``group``, optional
    ``service`` and ``owner``; ``runtime_candidates``: ``id``, ``runtime``.
    """
    from ..functions.paths import path_prefixes

    known = files.select("path").distinct().withColumn("_known", F.lit(True))
    placed = lookup_join(nodes, known, ["path"])
    if runtime_candidates is not None:
        single = runtime_candidates.groupBy("id").agg(only_value("runtime").alias("_runtime"))
        placed = lookup_join(placed, single, ["id"])
        service = F.col("service") if "service" in nodes.columns else F.lit(None).cast("string")
        context = F.coalesce(F.concat(F.lit("context:runtime:"), "_runtime"), F.concat(F.lit("context:service:"), service), F.lit("context:unclassified"))
        contexts = F.array(F.struct(context.alias("scope"), F.lit("context").alias("kind")))
        prefix = context
    else:
        contexts, prefix = F.array().cast("array<struct<scope:string,kind:string>>"), F.lit("")
    local = F.col("_known") & (F.col("kind") != "external")
    folders = F.transform(path_prefixes("path", include_self=False), lambda p: F.struct(F.concat_ws("|", F.lit("directory"), prefix, p).alias("scope"), F.lit("directory").alias("kind")))
    file = F.array(F.struct(F.concat_ws("|", F.lit("file"), prefix, "path").alias("scope"), F.lit("file").alias("kind")))
    steps = F.concat(folders, file)
    if "owner" in nodes.columns:
        fn = F.array(F.struct(F.concat_ws("|", F.lit("function"), "path", "owner").alias("scope"), F.lit("function").alias("kind")))
        steps = F.when(F.col("owner").isNotNull(), F.concat(steps, fn)).otherwise(steps)
    group = F.when(F.col("kind") == "external", "unresolved-calls").otherwise(F.concat(F.lit("membership:"), F.coalesce("group", F.lit(""))))
    outside = F.array(F.struct(F.concat_ws("|", F.lit("group"), prefix, group).alias("scope"), F.lit("group").alias("kind")))
    project = F.array(F.struct(F.lit("project").alias("scope"), F.lit("project").alias("kind")))
    chain = F.concat(project, contexts, F.when(F.coalesce(local, F.lit(False)), steps).otherwise(outside))
    return placed.select("id", F.posexplode(chain).alias("level", "_s")).select("id", "level", "_s.scope", "_s.kind")


def ownership_mode() -> Column:
    """Aggregate over an ownership table: grounded, mixed or fallback."""
    is_context = F.col("kind") == "context"
    grounded = F.max(is_context & (F.col("scope") != "context:unclassified"))
    unknown = F.max(is_context & (F.col("scope") == "context:unclassified"))
    return F.when(grounded & unknown, "mixed").when(grounded, "grounded").otherwise("fallback")


def usage_targets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What each tool operation works for, as (``id``, ``target``) rows.

    In order, the first rule that finds anything: logical owner or resource started / deployed / applied; for other
    purposes the logical owner of an input; for generators the targets of the operation that applies their output;
    a generated artifact.
    """
    return _targets(*_target_rules(nodes, rewritten(_typed_flows(edges))))


def _typed_flows(edges: DataFrame) -> DataFrame:
    """The relations that tell what operations work for and on."""
    typed = edges.filter(F.col("kind").isin("flow-starts", "flow-deploys", "flow-applies", "flow-input", "flow-generates"))
    return typed.select(*[name for name in ("src", "dst", "kind", "environment") if name in edges.columns])


def _targets(kept: DataFrame, pairs: DataFrame, applies: DataFrame) -> DataFrame:
    """Targets from what :func:`_target_rules` found."""
    shared = pairs.join(applies, "_apply").select("id", "target").filter(F.col("target").isNotNull())
    return kept.unionByName(shared).distinct()


def _target_rules(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the best rule of each operation gives it: targets of its own (``id``, ``target``), pairs of generators and operations that
    apply their output (``id``, ``_apply``), and the targets of these (``_apply``, ``target``)."""
    ops = nodes.filter((F.col("kind") == "tool-operation") & (F.coalesce("purpose", F.lit("")) != "script")).select("id", F.coalesce("purpose", F.lit("")).alias("purpose"))
    logical = nodes.select("id", F.coalesce("logical_owner", F.when(F.col("kind").isin("application", "shared-code", "code-package"), F.col("id"))).alias("logical"), F.col("kind").alias("_kind"))
    edges = edges.select("src", "dst", "kind")
    out = edges.filter("kind <> 'flow-input'").join(ops.withColumnRenamed("id", "src"), "src").join(logical.withColumnRenamed("id", "dst"), "dst")
    acted = F.coalesce("logical", F.when(F.col("_kind").isin("resource", "external-service", "external-program"), F.col("dst")))
    made = F.when(F.col("_kind") == "artifact", F.col("dst"))
    generates = F.col("kind") == "flow-generates"
    own = out.select(F.col("src").alias("id"), F.when(generates, made).otherwise(acted).alias("target"), F.when(generates, 3).otherwise(1).alias("tier"))
    into = edges.filter("kind = 'flow-input'").join(ops.filter(~F.col("purpose").isin("generate", "apply")).withColumnRenamed("id", "dst"), "dst").join(logical.withColumnRenamed("id", "src"), "src")
    inputs = into.select(F.col("dst").alias("id"), F.col("logical").alias("target"), F.lit(2).alias("tier"))
    plain = own.unionByName(inputs).filter(F.col("target").isNotNull()).distinct()
    # Generators meet the operations that apply their output as pairs; targets are looked up only for distinct pairs.
    written = edges.filter(generates).join(ops.filter("purpose = 'generate'").withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("_artifact"))
    applies = edges.filter("kind = 'flow-applies'").select(F.col("src").alias("_apply"), F.col("dst").alias("target"))
    taken = edges.filter("kind = 'flow-input'").select(F.col("src").alias("_artifact"), F.col("dst").alias("_apply"))
    pairs = written.join(taken, "_artifact").select("id", "_apply").distinct().join(applies.filter(F.col("target").isNotNull()).select("_apply"), "_apply", "left_semi")
    pairs = rewritten(pairs)
    # The best rule of an operation is known from the plain rows and the pairs, before the pairs are multiplied.
    best = plain.select("id", "tier").unionByName(pairs.select("id", F.lit(1).alias("tier"))).groupBy("id").agg(F.min("tier").alias("_best"))
    return lookup_join(plain, best, ["id"], "inner").filter("tier = _best").select("id", "target"), pairs, applies


def set_fingerprint(*columns: Column | str) -> list[Column]:
    """Order-free fingerprint of a group's distinct rows: two 64-bit mixes and the count, all mergeable.

    Equal sets get equal fingerprints without gathering them; apply it to already distinct rows.
    """
    return [F.bit_xor(F.xxhash64(F.lit("a"), *columns)).alias("print_a"), F.bit_xor(F.xxhash64(F.lit("b"), *columns)).alias("print_b"), F.count(F.lit(1)).alias("print_n")]


def usage_index(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per tool operation: tool, purpose, number of targets, inputs and outputs, ``resolved``, and a ``context`` key that is
    equal for operations with the same settings, inputs and outputs."""
    edges = rewritten(_typed_flows(edges))
    return _usage(nodes, edges, _targets(*_target_rules(nodes, edges))).drop("_prints")


def _usage_units(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per tool operation (``id``) ``same``, the smallest id among the resolved operations with its tool, targets, purpose and context.

    What a generator gets from the operations that apply its output follows from its output, and the context holds all output:
    where contexts are equal, the operations that apply it are, too.  So these stand for their targets, which are not multiplied out.
    """
    edges = _typed_flows(edges)
    own, pairs, _ = _target_rules(nodes, edges)
    aims = own.select("id", F.lit("own").alias("side"), "target").unionByName(pairs.select("id", F.lit("applied by").alias("side"), F.col("_apply").alias("target")))
    blank = F.lit("")
    key = F.concat_ws(":", F.coalesce("tool", blank), F.coalesce("_prints", blank), F.coalesce("purpose", blank), "context")
    usage = cut_lineage(_usage(nodes, edges, aims, "side").select("id", F.when(F.col("resolved"), key).alias("_key")))
    firsts = usage.filter("_key is not null").groupBy("_key").agg(F.min("id").alias("same"))
    return cut_lineage(lookup_join(usage, firsts, ["_key"]).select("id", "same"))


def _usage(nodes: DataFrame, edges: DataFrame, aims: DataFrame, *sides: str) -> DataFrame:
    """:func:`usage_index` over ``aims``, what each operation works for as distinct rows (``id``, ``sides``, ``target``), with ``_prints``,
    their fingerprint (null without any)."""
    logical = nodes.select("id", F.coalesce("logical_owner", F.when(F.col("kind").isin("application", "shared-code", "code-package"), F.col("id")), F.col("id")).alias("logical"))
    ops = nodes.filter((F.col("kind") == "tool-operation") & (F.coalesce("purpose", F.lit("")) != "script"))
    env = F.coalesce("environment", F.lit(""))
    read = edges.filter("kind = 'flow-input'").join(ops.select(F.col("id").alias("dst")), "dst", "left_semi").join(logical.withColumnRenamed("id", "src"), "src")
    inputs = read.select(F.col("dst").alias("id"), F.lit("in").alias("side"), F.col("logical").alias("item"), env.alias("env"))
    written = edges.filter(F.col("kind").isin("flow-generates", "flow-starts", "flow-deploys", "flow-applies")).join(ops.select(F.col("id").alias("src")), "src", "left_semi")
    outputs = written.select(F.col("src").alias("id"), F.col("kind").alias("side"), F.col("dst").alias("item"), env.alias("env"))
    flows = inputs.unionByName(outputs).distinct()
    digest = flows.groupBy("id").agg(
        *set_fingerprint("side", "item", "env"), F.count_distinct(F.when(F.col("side") == "in", F.col("item"))).alias("inputs"), F.count_if(F.col("side") != "in").alias("outputs")
    )
    prints = aims.groupBy("id").agg(*set_fingerprint(*sides, "target"))
    targets = prints.select("id", F.col("print_n").alias("targets"), F.concat_ws(".", F.hex("print_a"), F.hex("print_b")).alias("_prints"))
    joined = lookup_join(lookup_join(ops, digest, ["id"]), targets, ["id"]).fillna(0, ["inputs", "outputs", "targets"])
    settings = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("configuration_path", "working_directory", "arguments") if c in nodes.columns]
    environments = F.array_join(F.array_sort(F.coalesce("environments", F.array().cast("array<string>"))), "+")
    context = F.concat_ws("|", *settings, environments, F.hex("print_a"), F.hex("print_b"), F.col("print_n").cast("string"))
    return joined.select("id", "tool", "purpose", "targets", "inputs", "outputs", ((F.col("targets") > 0) | (F.col("inputs") > 0)).alias("resolved"), context.alias("context"), "_prints")


def structural_groups(configurations: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Group execution configurations of one (owner, configuration, place) per environment set.

    ``configurations``: ``id``, ``owner``, ``configuration_path``, ``place``, ``environments`` (array).  Members without an
    owner or a configuration stay alone; groups in which two members have the same environment set are split.
    With ``edges`` (``src``, ``dst``, ``kind``), configurations that something deploys to are kept apart from those that run:
    ``category`` is ``destination`` or ``runtime`` and leads the group id.
    """
    envs = F.array_join(F.array_sort(F.coalesce("environments", F.array().cast("array<string>"))), "+")
    whole = (F.coalesce("owner", F.lit("")) != "") & (F.coalesce("configuration_path", F.lit("")) != "")
    key = F.when(whole, F.concat_ws("|", "owner", "configuration_path", F.coalesce("place", F.lit("")), envs)).otherwise(F.concat_ws("|", F.lit("original"), F.col("id").cast("string")))
    more = []
    if edges is not None:
        published = edges.filter("kind = 'flow-deploys'").select(F.col("dst").alias("id")).distinct().withColumn("_published", F.lit(True))
        configurations = lookup_join(configurations, published, ["id"]).withColumn("category", F.when(F.col("_published"), "destination").otherwise("runtime"))
        key, more = F.concat_ws("|", "category", key), ["category"]
    keyed = configurations.withColumn("_key", key).withColumn("_envs", envs)
    checked = keyed.groupBy("_key").agg((F.count_distinct("_envs") == F.count(F.lit(1))).alias("_apart"))
    joined = lookup_join(keyed, checked, ["_key"])
    return joined.select("id", F.when(F.col("_apart"), F.col("_key")).otherwise(F.concat_ws(":", "_key", F.col("id").cast("string"))).alias("group_id"), *more)


def unconfirmed_packages(nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Code packages without a parent that nothing shows to be auxiliary, as one group where there are several.

    ``nodes``: ``id``, ``kind``, ``parent_id``, ``auxiliary``.  Returns ``id``, ``group_id``, ``category``.
    """
    loose = nodes.filter((F.col("kind") == "code-package") & F.col("parent_id").isNull() & ~F.coalesce("auxiliary", F.lit(False))).select(*by, "id")
    number = loose.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    kept = loose.join(number.drop("_n"), list(by), "left_semi") if by else loose.join(number.select(F.lit(True).alias("_several")), F.lit(True), "left_semi")
    return kept.select(*by, "id", F.lit("unconfirmed-code-packages").alias("group_id"), F.lit("unconfirmed").alias("category"))


def resource_groups(configurations: DataFrame) -> DataFrame:
    """Resource settings of one role (``type``, ``path``, ``binding``): a group needs at least two members whose
    (``environment``, ``place``) slots all differ.  Returns (``id``, ``group_id``) of grouped members."""
    role = ["type", "path", "binding"]
    rows = configurations.filter(F.coalesce("path", F.lit("")).isNotNull() & (F.coalesce("path", F.lit("")) != "") & (F.coalesce("binding", F.lit("")) != ""))
    slot = F.struct(F.coalesce("environment", F.lit("default")), F.coalesce("place", F.lit("configured")))
    fit = rows.groupBy(*role).agg(F.count_distinct("id").alias("_members"), (F.count_distinct(slot) == F.count(F.lit(1))).alias("_apart")).filter("_members >= 2 and _apart")
    return rows.join(fit, role, "left_semi").select("id", F.concat_ws("|", *role).alias("group_id")).distinct()


def package_usage(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """How each code package is used by others: ``source`` > ``declared`` > ``unconfirmed``, with distinct consumers.

    ``roots`` (``id``, ``root``) lifts ends to their root entity.  A package becomes shared code with source use, or with
    declared use and a library contract (``library`` column).
    """
    packages = nodes.filter("kind = 'code-package'").select("id", F.coalesce("library", F.lit(False)).alias("library"))
    used = edges.filter(F.col("kind").isin("declaration-dependency", "code-reference"))
    for end in ("src", "dst"):
        used = lookup_join(used, roots.select(F.col("id").alias(end), F.col("root").alias(f"_{end}")), [end])
    lifted = used.select(F.coalesce("_src", "src").alias("consumer"), F.coalesce("_dst", "dst").alias("id"), "kind").filter("consumer <> id")
    counts = lifted.groupBy("id").agg(
        F.count_distinct("consumer").alias("consumers"), F.count_if(F.col("kind") == "code-reference").alias("source_uses"), F.count_if(F.col("kind") == "declaration-dependency").alias("declared_uses")
    )
    joined = lookup_join(packages, counts, ["id"]).fillna(0)
    status = F.when(F.col("source_uses") > 0, "source").when(F.col("declared_uses") > 0, "declared").otherwise("unconfirmed")
    shared = (F.col("source_uses") > 0) | ((F.col("declared_uses") > 0) & F.col("library"))
    return joined.select("id", "consumers", "source_uses", "declared_uses", status.alias("status"), shared.alias("shared"))


# Paths whose references only support development.
SUPPORT_PATH = (
    r"(?:^|/)(?:tests?|__tests__|scripts|build-tools)(?:/)|\.(?:test|spec)\.|(?:^|/)(?:vite|vitest|webpack|rollup|eslint|esbuild|drizzle)\.config\."
)


def technology_usage(references: DataFrame, declarations: DataFrame, configured: DataFrame | None = None) -> DataFrame:
    """Technologies of an entity: used in source, only in support code, only declared, or only configured.

    ``references``: ``entity``, ``name``, ``path``, ``type_only``; ``declarations``/``configured``: ``entity``, ``name``.
    """
    support = F.coalesce("type_only", F.lit(False)) | F.col("path").rlike(SUPPORT_PATH)
    rows = references.select("entity", "name", F.when(support, 2).otherwise(1).alias("rank")).unionByName(declarations.select("entity", "name", F.lit(3).alias("rank")))
    if configured is not None:
        rows = rows.unionByName(configured.select("entity", "name", F.lit(4).alias("rank")))
    best = rows.groupBy("entity", "name").agg(F.min("rank").alias("_rank"))
    usage = F.when(F.col("_rank") == 1, "source").when(F.col("_rank") == 2, "support").when(F.col("_rank") == 3, "declared").otherwise("configuration")
    return best.select("entity", "name", usage.alias("usage"))


def content_coverage(groups: DataFrame, allowed: DataFrame) -> DataFrame:
    """How much of each represented set lies inside a content range: inside, partial or outside.

    ``groups``: ``group_id``, ``id``; ``allowed``: ``id``.
    """
    marks = allowed.select("id").distinct().withColumn("_in", F.lit(1))
    joined = lookup_join(groups.select("group_id", "id").distinct(), marks, ["id"])
    counted = joined.groupBy("group_id").agg(F.sum(F.coalesce("_in", F.lit(0))).alias("inside"), F.count(F.lit(1)).alias("total"))
    return counted.withColumn("state", F.when(F.col("inside") == F.col("total"), "inside").when(F.col("inside") > 0, "partial").otherwise("outside"))


def simple_overview(nodes: DataFrame, edges: DataFrame, groups: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Assign every entity to exactly one explanatory unit and re-key the relations between units.

    The first rule that applies gives the unit: structural group (``groups``: ``id``, ``group_id``); auxiliary roots by
    role; an entity of its own; the unit of an auxiliary owner or definition, before any group, for what is its own; the unit of
    the logical owner or nearest anchored parent; a tool usage (same tool, targets, purpose and context); the building unit of
    an artifact with one producer and one consumer; the requester of an unresolved target; the single unit a script invokes;
    else unassigned.

    Returns units (``id``, ``unit``, ``rule``) and relations (``src``, ``dst``, ``kind``, ``confidence``, ``n``, ``internal``); what a folded
    artifact hands on to another unit is an ``artifact-path``.
    """
    from .tree import ancestors

    nodes, edges = cut_lineage(nodes), rewritten(edges.select("src", "dst", "kind", "confidence", "environment"))
    chain = ancestors(nodes.select("id", "parent_id")).filter("distance > 0")
    major = F.col("kind").isin(*MAJOR_KINDS)
    stands = major & ((F.col("kind") != "component") | F.col("parent_id").isNull() | F.coalesce("has_entry", F.lit(False)))
    anchors = cut_lineage(nodes.filter(stands).select("id"))
    above = chain.join(anchors.withColumnRenamed("id", "ancestor"), "ancestor", "left_semi").groupBy("id").agg(F.min_by("ancestor", "distance").alias("anchor_parent"))
    facts = lookup_join(nodes, above, ["id"])
    if groups is not None:
        facts = lookup_join(facts, groups.groupBy("id").agg(F.min("group_id").alias("_group")), ["id"])
    else:
        facts = facts.withColumn("_group", F.lit(None).cast("string"))
    apart = F.col("kind").isin("resource", "external-service", "external-program") | F.coalesce("has_entry", F.lit(False)) | F.col("anchor_parent").isNull()
    # Shared code stays with its parent only when nothing outside that parent uses it.
    uses = edges.filter(F.col("kind").isin("code-reference", "declaration-dependency") & (F.col("src") != F.col("dst")))
    users = lookup_join(uses.select("src", F.col("dst").alias("id")), nodes.select(F.col("id").alias("src"), F.col("logical_owner").alias("_lo")), ["src"])
    users = lookup_join(users, above.select(F.col("id").alias("src"), F.col("anchor_parent").alias("_ap")), ["src"])
    mine = lookup_join(users, above, ["id"])
    inside = (F.col("src") == F.col("anchor_parent")) | F.coalesce(F.col("_lo") == F.col("anchor_parent"), F.lit(False)) | F.coalesce(F.col("_ap") == F.col("anchor_parent"), F.lit(False))
    private = mine.groupBy("id").agg(F.min(F.coalesce(inside, F.lit(False))).alias("_private"))
    facts = lookup_join(facts, private, ["id"])
    folded_in = ~apart & ((F.col("kind") != "shared-code") | F.coalesce("_private", F.lit(False)))
    anchored = stands & ~folded_in
    key = lambda *parts: F.concat_ws(":", F.lit("unit"), *parts)
    role = F.when(F.coalesce("auxiliary", F.lit(False)), "test")
    first = F.when(
        anchored,
        F.when(F.col("_group").isNotNull(), F.struct(key(F.lit("group"), "_group").alias("unit"), F.lit("group").alias("rule")))
        .when(role.isNotNull() & F.col("anchor_parent").isNull(), F.struct(key(F.lit("auxiliary"), role).alias("unit"), F.lit("auxiliary").alias("rule")))
        .otherwise(F.struct(key(F.lit("entity"), "id").alias("unit"), F.lit("entity").alias("rule"))),
    ).when(F.col("_group").isNotNull(), F.struct(key(F.lit("group"), "_group").alias("unit"), F.lit("group").alias("rule")))
    columns = ["id", "kind", "auxiliary", "purpose", "logical_owner", "anchor_parent", "request_owner", "definition_owner", "tool"]
    facts = cut_lineage(facts.select(*columns, first.alias("_first"), F.coalesce(anchored, F.lit(False)).alias("_anchored")))
    # What belongs to an auxiliary owner stays with it, unless something that the owner does not define starts or publishes it.
    placed = facts.filter(F.col("_anchored") & F.coalesce("auxiliary", F.lit(False))).filter("_first.rule = 'auxiliary' or _first.rule = 'entity' and kind = 'code-package'")
    homes = cut_lineage(placed.select("id", "_first.unit"))
    kept = homes.select("id", "unit", F.lit("inside").alias("rule")).limit(0)
    held = facts.filter(~F.col("_anchored")).select("id", "logical_owner").join(homes.select(F.col("id").alias("logical_owner"), "unit"), "logical_owner")
    if not homes.isEmpty() and not (held := cut_lineage(held)).isEmpty():
        sent = edges.filter(F.col("kind").isin("flow-starts", "flow-deploys")).select("src", F.col("dst").alias("id")).join(held.select("id", "logical_owner"), "id")
        sent = lookup_join(sent, nodes.select(F.col("id").alias("src"), "definition_owner"), ["src"]).filter(~F.col("definition_owner").eqNullSafe(F.col("logical_owner")))
        kept = cut_lineage(held.join(sent.select("id").distinct(), "id", "left_anti").select("id", "unit", F.lit("inside").alias("rule")))
        facts = facts.join(kept.select("id"), "id", "left_anti")
    owned = cut_lineage(facts.filter(F.col("_first").isNotNull()).select("id", "_first.unit", "_first.rule").unionByName(kept))
    rest = cut_lineage(facts.filter(F.col("_first").isNull()).select("id", "kind", "purpose", "logical_owner", "anchor_parent", "request_owner", "definition_owner", "tool"))

    def settle(rows: DataFrame) -> None:
        nonlocal owned, rest
        done = cut_lineage(rows.select("id", "unit", "rule"))
        owned = owned.unionByName(done)
        rest = cut_lineage(rest.join(done, "id", "left_anti"))

    def unit_of(column: str, name: str) -> DataFrame:
        return owned.select(F.col("id").alias(column), F.col("unit").alias(name))

    inner = rest.filter(F.col("kind").isin("component", "execution-config", "code-definition", "shared-code"))
    inner = lookup_join(lookup_join(inner, unit_of("logical_owner", "_a"), ["logical_owner"]), unit_of("anchor_parent", "_b"), ["anchor_parent"])
    settle(inner.withColumn("unit", F.coalesce("_a", "_b")).filter("unit is not null").withColumn("rule", F.lit("inside")))
    usage = _usage_units(nodes, edges)
    used = lookup_join(rest.select("id", "definition_owner"), usage, ["id"], "inner")
    if not homes.isEmpty() and not rest.filter("definition_owner is not null").isEmpty():  # operations that an auxiliary entity defines
        defined = unit_of("definition_owner", "unit").join(homes.select("unit").distinct(), "unit", "left_semi")
        defined = defined.join(nodes.filter("auxiliary").select(F.col("id").alias("definition_owner")), "definition_owner", "left_semi")
        settle(lookup_join(used, defined, ["definition_owner"], "inner").withColumn("rule", F.lit("inside")))
        used = lookup_join(rest.select("id"), usage, ["id"], "inner")
    # A unit of equal usages is named by the first of them: relations carry the names of their units.
    settle(used.withColumn("unit", F.when(F.col("same").isNotNull(), key(F.lit("usage"), "same")).otherwise(key(F.lit("usage-unresolved"), "id"))).withColumn("rule", F.lit("usage")))
    # Edges are only counted per end; the few artifacts with one on both sides look theirs up.
    once = lambda end: edges.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select("id")
    between = cut_lineage(rest.filter("kind = 'artifact'").select("id").join(once("dst"), "id", "left_semi").join(once("src"), "id", "left_semi"))
    made = edges.filter("kind = 'flow-generates'").select(F.col("dst").alias("id"), F.col("src").alias("_maker")).join(between, "id")
    taken = edges.filter("kind = 'flow-input'").select(F.col("src").alias("id"), F.col("dst").alias("_taker")).join(between, "id")
    artifact = made.join(taken, "id")
    artifact = artifact.join(nodes.filter("purpose = 'build'").select(F.col("id").alias("_maker")), "_maker", "left_semi").join(usage.select(F.col("id").alias("_taker")), "_taker", "left_semi")
    settle(lookup_join(artifact, unit_of("_maker", "unit"), ["_maker"], "inner").withColumn("rule", F.lit("folded")))
    asked = rest.filter("kind = 'unresolved'").withColumn("_who", F.coalesce("request_owner", "anchor_parent"))
    asked = lookup_join(asked, unit_of("_who", "_u"), ["_who"])
    settle(asked.withColumn("unit", F.coalesce("_u", key(F.lit("requests"), F.coalesce("_who", "id")))).withColumn("rule", F.lit("request")))
    scripts = rest.filter("kind = 'tool-operation' and purpose = 'script'")
    invoked = edges.filter("kind = 'flow-invokes'").select(F.col("src").alias("id"), F.col("dst").alias("_target")).join(scripts.select("id"), "id", "left_semi")
    invoked = lookup_join(invoked, unit_of("_target", "_u"), ["_target"]).groupBy("id").agg(only_value("_u").alias("_one"), F.min(F.col("_u").isNotNull()).alias("_all"))
    scripts = lookup_join(lookup_join(scripts, invoked, ["id"]), unit_of("definition_owner", "_d"), ["definition_owner"])
    settle(scripts.withColumn("unit", F.coalesce(F.when(F.col("_all"), F.col("_one")), F.col("_d"))).filter("unit is not null").withColumn("rule", F.lit("script")))
    settle(rest.withColumn("unit", key(F.lit("unassigned"), "id")).withColumn("rule", F.lit("unassigned")))
    units = cut_lineage(owned)
    linked = edges
    for end in ("src", "dst"):
        linked = lookup_join(linked, units.select(F.col("id").alias(end), F.col("unit").alias(f"_{end}"), (F.col("rule") == "folded").alias(f"_{end}_folded")), [end], "inner")
    passed = (F.col("kind") == "flow-input") & F.col("_src_folded") & (F.col("_src") != F.col("_dst"))
    linked = linked.withColumn("kind", F.when(passed, "artifact-path").when(F.col("kind").isin(*REFERENCE_KINDS), "reference").otherwise(F.col("kind")))
    relations = linked.groupBy(F.col("_src").alias("src"), F.col("_dst").alias("dst"), "kind", "confidence").agg(F.count(F.lit(1)).alias("n"))
    return units, relations.withColumn("internal", F.col("src") == F.col("dst"))


def folded_paths(units: DataFrame, edges: DataFrame) -> DataFrame:
    """Two-step paths through folded artifacts: producer → artifact → consumer, as edge pairs."""
    folded = units.filter("rule = 'folded'").select("id")
    made = edges.filter("kind = 'flow-generates'").select(F.col("dst").alias("id"), F.col("id").alias("first_edge"), F.col("src").alias("producer"))
    taken = edges.filter("kind = 'flow-input'").select(F.col("src").alias("id"), F.col("id").alias("second_edge"), F.col("dst").alias("consumer"))
    return folded.join(made, "id").join(taken, "id").select(F.col("id").alias("artifact"), "producer", "consumer", "first_edge", "second_edge")
