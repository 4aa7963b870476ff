"""Call resolution and data flow over symbol tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import Blocks, cut_lineage, dyadic_blocks, lookup_join

SEPARATOR = r"\.|::|->"
# Method names that run when a class is called.
CONSTRUCTORS = ("constructor", "__init__", "initialize")
IMPLICIT_THIS_EXCEPT = ("javascript", "typescript", "tsx")


def _live_ranges(definitions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Where a definition can be read: from its start to the end of its block, or to the next unconditional one of that block.

    The next one is carried backwards over blocks of rows, so one name may hold any share of the definitions.
    """
    key = [*by, "owner", "name", "scope_end"]
    starts = definitions.groupBy(*key, "start").agg(F.max(~F.col("conditional")).alias("_sure"))
    cut = Blocks(starts, key, [F.desc("start")])
    sure = F.when(F.col("_sure"), F.col("start"))
    local = cut.rows.withColumn("_near", F.last(sure, ignorenulls=True).over(cut.inside.rowsBetween(Window.unboundedPreceding, -1)))
    carried = cut.carry({"_first": F.min(sure)}, {"_far": ("last", "_first")}, rows=local)
    ends = carried.select(*key, "start", F.least("scope_end", F.coalesce("_near", "_far") - 1).alias("_to"))
    return definitions.join(ends, [*key, "start"]).withColumn("_from", F.greatest("start", "scope_start", F.lit(0)))


def reaching_definitions(uses: DataFrame, definitions: DataFrame, scopes: DataFrame, parameters: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Definitions a use may read: from the latest back to the first unconditional one, else the parameter of that name,
    else the enclosing scope.

    ``uses``: ``use_id``, ``owner``, ``name``, ``position``; ``definitions``: ``def_id``, ``owner``, ``name``, ``start``,
    ``scope_start``, ``scope_end``, ``conditional``; ``scopes`` (``id``, ``ancestor``, ``distance``) from tree ancestors;
    ``parameters``: ``def_id``, ``owner``, ``name``.  The stop point is one mergeable minimum per use.  Uses meet only
    definitions whose live range holds them: ranges are cut into aligned blocks, and a use lies in one block per level.
    """
    chain = scopes.select(*by, F.col("id").alias("owner"), F.col("ancestor").alias("_scope"), "distance")
    reach = uses.select(*by, "use_id", "owner", "name", "position").join(chain, [*by, "owner"])
    live = _live_ranges(definitions.select(*by, "owner", "name", "def_id", "start", "scope_start", "scope_end", "conditional"), by)
    blocks = live.withColumn("_b", F.explode(dyadic_blocks(F.col("_from"), F.col("_to"))))
    written = cut_lineage(blocks.select(*by, F.col("owner").alias("_scope"), "name", "def_id", "start", "conditional", "_b.level", "_b.block"))
    levels = sorted(row.level for row in written.select("level").distinct().collect())  # at most one row per bit of a position
    at = F.array(*[F.struct(F.lit(level).alias("level"), F.shiftright(F.col("position").cast("bigint"), level).alias("block")) for level in levels])
    placed = reach.withColumn("_b", F.explode(at)) if levels else reach.withColumn("_b", F.lit(None).cast("struct<level:int,block:bigint>"))
    hits = placed.select("*", "_b.level", "_b.block").drop("_b").join(written, [*by, "_scope", "name", "level", "block"])
    given = parameters.select(*by, F.col("owner").alias("_scope"), "name", "def_id")
    held = reach.join(given, [*by, "_scope", "name"]).withColumn("start", F.lit(-1)).withColumn("conditional", F.lit(False))
    cols = [*by, "use_id", "distance", "start", "def_id", "conditional"]
    ordered = hits.select(*cols).unionByName(held.select(*cols)).withColumn("_at", F.struct("distance", (-F.col("start")).alias("back")))
    stop = ordered.filter(~F.col("conditional")).groupBy(*by, "use_id").agg(F.min("_at").alias("_stop"))
    kept = lookup_join(ordered, stop, [*by, "use_id"]).filter(F.col("_stop").isNull() | (F.col("_at") <= F.col("_stop")))
    return kept.select(*by, "use_id", "def_id", "conditional", "distance")


def resolve_calls(
    calls: DataFrame,
    functions: DataFrame,
    scopes: DataFrame,
    bindings: DataFrame,
    reachable: DataFrame,
    shadowed: DataFrame,
    classes: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Target function of each call, when exactly one candidate exists in the first tier that has any.

    ``calls``: ``call_id``, ``path``, ``owner``, ``callee``; ``functions``: ``fn_id``, ``path``, ``name``, ``class_name``,
    ``parent``, ``default_export``, ``language``; ``bindings``: ``path``, ``local``, ``original``, ``specifier``;
    ``reachable``: ``path``, ``specifier``, ``target`` (see re-export reach), with ``direct`` for plain imports;
    ``shadowed``: ``call_id`` of calls whose receiver is a parameter or local; ``classes``: ``path``, ``name``.  Functions marked
    ``initializer`` (the top level of a file) call but are never called, and methods are not declarations of their scope.
    """
    enclosed = functions
    if "initializer" in functions.columns:
        top = functions.filter("initializer").select(*by, F.col("fn_id").alias("parent"), F.lit(True).alias("_top")).distinct()
        every, functions = functions, functions.filter(~F.coalesce("initializer", F.lit(False)))
        at_top = lookup_join(functions, top, [*by, "parent"])
        enclosed = at_top.filter(F.col("_top").isNull() | (F.coalesce("class_name", F.lit("")) == "")).drop("_top")
    else:
        every = functions

    def per(*keys: str, frame: DataFrame = functions) -> DataFrame:
        """Functions per key as smallest id, largest id and number: enough to tell one candidate from several."""
        return frame.groupBy(*by, *keys).agg(F.min("fn_id").alias("_low"), F.max("fn_id").alias("_high"), F.count(F.lit(1)).alias("_n"))

    parts = F.split("callee", SEPARATOR)
    owner_info = every.select(*by, F.col("fn_id").alias("owner"), F.col("class_name").alias("_class"), F.col("language").alias("_language"))
    asked = calls.select(*by, "call_id", "path", "owner", "callee", F.element_at(parts, -1).alias("name"), F.get(parts, F.lit(0)).alias("_receiver"), (F.size(parts) > 1).alias("_member"), (F.size(parts) == 2).alias("_direct"))
    asked = lookup_join(asked, owner_info, [*by, "owner"])
    asked = cut_lineage(asked.join(shadowed.select(*by, "call_id").distinct(), [*by, "call_id"], "left_anti"))
    plain, member = asked.filter(~F.col("_member")), asked.filter("_member")
    keep = [*by, "call_id", "_low", "_high", "_n", "tier", "confidence"]

    def tier(frame: DataFrame, rank: Column, confidence: Column) -> DataFrame:
        return frame.withColumn("tier", rank.cast("double")).withColumn("confidence", confidence).select(*keep)

    # Tier 1: declarations of the enclosing scopes, nearest first; implicit-this languages see their class next.
    chain = scopes.select(*by, F.col("id").alias("owner"), F.col("ancestor").alias("parent"), "distance")
    places = plain.select(*by, "path", "owner", "name").distinct()
    # Names meet only those scopes above them that declare anything in their file.
    seen = places.select(*by, "path", "owner").distinct().join(chain, [*by, "owner"]).join(enclosed.select(*by, "path", "parent").distinct(), [*by, "path", "parent"], "left_semi")
    nested = places.join(seen, [*by, "path", "owner"]).join(per("path", "name", "parent", frame=enclosed), [*by, "path", "name", "parent"])
    nearest = nested.groupBy(*by, "path", "owner", "name").agg(F.min_by(F.struct("_low", "_high", "_n", "distance"), "distance").alias("_t")).select(*by, "path", "owner", "name", "_t.*")
    tiers = [tier(lookup_join(plain, nearest, [*by, "path", "owner", "name"], "inner"), F.col("distance") * 2, F.lit("source"))]
    by_class = per("path", "name", "class_name").withColumnRenamed("class_name", "_class")
    implicit = plain.filter((F.coalesce("_class", F.lit("")) != "") & ~F.coalesce(F.col("_language").isin(*IMPLICIT_THIS_EXCEPT), F.lit(False)))
    tiers.append(tier(lookup_join(implicit, by_class, [*by, "path", "name", "_class"], "inner"), F.lit(1), F.lit("source")))
    # Tier 2: imported names, limited to files the specifier reaches.
    bound = asked.withColumn("local", F.col("_receiver")).join(bindings.select(*by, "path", "local", "original", "specifier"), [*by, "path", "local"])
    files = reachable.select(*by, "path", "specifier", F.col("target").alias("_file"), "direct")
    bound = bound.join(files, [*by, "path", "specifier"])
    sure = F.when(F.col("_member") | ~F.coalesce("direct", F.lit(False)), "inferred").otherwise("source")
    # The wanted name (and class, for members of a named import) is part of the key.
    wanted = F.when(~F.col("_member") & ~F.col("original").isin("*", "default"), F.col("original")).otherwise(F.col("name"))
    free = ~F.col("_member") | F.col("original").isin("*", "default")
    named = bound.filter(F.col("_member") | (F.col("original") != "default")).withColumn("_name", wanted)
    in_file = functions.withColumnsRenamed({"path": "_file", "name": "_name", "class_name": "_fn_class"})
    tiers.append(tier(named.filter(free).join(per("_file", "_name", frame=in_file), [*by, "_file", "_name"]), F.lit(1e6), sure))
    scoped = named.filter(~free).withColumn("_fn_class", F.col("original"))
    tiers.append(tier(scoped.join(per("_file", "_name", "_fn_class", frame=in_file), [*by, "_file", "_name", "_fn_class"]), F.lit(1e6), sure))
    default = bound.filter(~F.col("_member") & (F.col("original") == "default"))
    tiers.append(tier(default.join(per("_file", frame=in_file.filter("default_export")), [*by, "_file"]), F.lit(1e6), sure))
    built = bound.filter(~F.col("_member") & ~F.col("original").isin("*", "default")).withColumn("_fn_class", F.col("original"))
    makers = per("_file", "_fn_class", frame=in_file.filter(F.col("_name").isin(*CONSTRUCTORS)))
    tiers.append(tier(built.join(makers, [*by, "_file", "_fn_class"]), F.lit(2e6), sure))
    # Tier 3: members of this/self or of a class named in the same file; calls with an import binding stop at tier 2.
    unbound = member.filter("_direct").withColumn("local", F.col("_receiver")).join(bindings.select(*by, "path", "local"), [*by, "path", "local"], "left_anti")
    own = unbound.filter(F.col("_receiver").isin("this", "self", "$this"))
    tiers.append(tier(lookup_join(own, by_class, [*by, "path", "name", "_class"], "inner"), F.lit(3e6), F.lit("source")))
    if classes is not None:
        known = unbound.join(classes.select(*by, "path", F.col("name").alias("_receiver")).distinct(), [*by, "path", "_receiver"], "left_semi")
        known = known.withColumn("_class", F.col("_receiver"))
        tiers.append(tier(lookup_join(known, by_class, [*by, "path", "name", "_class"], "inner"), F.lit(3e6), F.lit("inferred")))
    hits = tiers[0]
    for part in tiers[1:]:
        hits = hits.unionByName(part)
    per_tier = hits.groupBy(*by, "call_id", "tier").agg(
        F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.min_by("confidence", F.when(F.col("confidence") == "inferred", 0).otherwise(1)).alias("_sure"), F.sum("_n").alias("_n")
    )
    first = per_tier.groupBy(*by, "call_id").agg(F.min_by(F.struct("_low", "_high", "_sure", "_n"), "tier").alias("_t"))
    joined = lookup_join(calls, first, [*by, "call_id"])
    one = F.col("_t._low") == F.col("_t._high")
    return joined.select(
        *calls.columns,
        F.when(one, F.col("_t._low")).alias("target"),
        F.when(one, F.col("_t._sure")).otherwise("unresolved").alias("confidence"),
        F.coalesce("_t._n", F.lit(0)).alias("candidates"),
    )


def bind_arguments(
    arguments: DataFrame, targets: DataFrame, parameters: DataFrame, results: DataFrame | None = None, returns: DataFrame | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Data-flow edges of calls.

    ``arguments``: ``call_id``, ``position``, ``value_id``, ``source`` (value / call / receiver / receiver-call),
    ``conditional``; ``targets``: ``call_id``, ``target``, ``confidence``; ``parameters``: ``fn_id``, ``position``,
    ``param_id``; ``results``: ``call_id``, ``assigned_id``; ``returns``: ``fn_id``, ``returned_id``.
    """
    conditional = F.coalesce("conditional", F.lit(False))
    first = (
        F.when(F.col("source") == "value", "argument").when(F.col("source") == "call", "argument-result")
        .when(F.col("source") == "receiver", "receiver").otherwise("receiver-result")
    )
    cols = [*by, "src", "dst", "kind", "confidence"]
    into = arguments.select(*by, F.col("value_id").alias("src"), F.col("call_id").alias("dst"), first.alias("kind"), F.when(conditional & (F.col("source") == "value"), "inferred").otherwise("source").alias("confidence"))
    aimed = lookup_join(arguments.filter(F.col("source").isin("value", "call")), targets.select(*by, "call_id", F.col("target").alias("fn_id"), "confidence"), [*by, "call_id"], "inner")
    passed = lookup_join(aimed.filter(F.col("fn_id").isNotNull()), parameters, [*by, "fn_id", "position"], "inner")
    weaker = F.when(conditional & (F.col("confidence") == "source") & (F.col("source") == "value"), "inferred").otherwise(F.col("confidence"))
    passed = passed.select(*by, F.col("value_id").alias("src"), F.col("param_id").alias("dst"), F.when(F.col("source") == "value", "passes-to").otherwise("passes-result").alias("kind"), weaker.alias("confidence"))
    out = into.select(*cols).unionByName(passed.select(*cols))
    if results is not None:
        out = out.unionByName(results.select(*by, F.col("call_id").alias("src"), F.col("assigned_id").alias("dst"), F.lit("produces").alias("kind"), F.lit("source").alias("confidence")))
        if returns is not None:
            given = lookup_join(results, targets.select(*by, "call_id", F.col("target").alias("fn_id")), [*by, "call_id"], "inner").join(returns, [*by, "fn_id"])
            out = out.unionByName(given.select(*by, F.col("returned_id").alias("src"), F.col("assigned_id").alias("dst"), F.lit("returns").alias("kind"), F.lit("source").alias("confidence")))
    return out.distinct()


def template_slices(template_edges: DataFrame, returns: DataFrame, parameters: DataFrame) -> DataFrame:
    """Part of each function body that its calls need: everything on a way to a return, plus all parameters.

    ``template_edges``: ``fn_id``, ``src``, ``dst``; ``returns``/``parameters``: ``fn_id``, ``id``.  Adds ``returns_it``.
    """
    from .traverse import reach, store_steps

    steps = store_steps(template_edges.select("fn_id", F.col("dst").alias("from"), F.col("src").alias("to")), ["fn_id"])
    needed = reach(steps, returns.select("fn_id", "id"), by=["fn_id"]).select("fn_id", "id", F.lit(True).alias("returns_it"))
    every = needed.unionByName(parameters.select("fn_id", "id", F.lit(False).alias("returns_it")))
    return every.groupBy("fn_id", "id").agg(F.max("returns_it").alias("returns_it"))


def instantiate_calls(
    template_edges: DataFrame, returns: DataFrame, parameters: DataFrame, invocations: DataFrame, arguments: DataFrame, locals_: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Copy the needed slice of a callee into each call site, so that values of different calls do not mix.

    ``invocations``: ``call_id`` (the operation node), ``fn_id`` (callee), ``caller`` (enclosing function or null),
    ``result_id``; ``arguments``: ``call_id``, ``position``, ``value_id``; ``parameters``: ``fn_id``, ``id``, ``position``
    and optional ``rest`` (takes every argument from its position on); ``template_edges``: ``fn_id``, ``src``, ``dst`` and
    optional ``kind``, of which ``parameter-default`` is left out where the call gives that argument.  ``locals_``
    (``fn_id``, ``id``) are the nodes of each function: a value from outside is not copied, its edge leads into the copy.
    Without it every node is local.

    Slices of any size are copied.  A call inside a copied slice becomes one summary node per copy, and recursion stops
    at the call's own boundary.

    Returns nodes (``id``, ``original``, ``call_id``, ``shape``) and edges (``src``, ``dst``, ``kind``, ``call_id``).
    """
    kind = F.col("kind") if "kind" in template_edges.columns else F.lit("flow")
    template = template_edges.select("fn_id", "src", "dst", kind.alias("kind"))
    inner_edges, outer_edges = template, None
    if locals_ is not None:
        own = locals_.select("fn_id", F.col("id").alias("src")).distinct()
        inner_edges, outer_edges = template.join(own, ["fn_id", "src"], "left_semi"), template.join(own, ["fn_id", "src"], "left_anti")
    slices = cut_lineage(template_slices(inner_edges, returns, parameters.select("fn_id", "id")))
    top = invocations.join(slices.select("fn_id").distinct(), "fn_id", "left_semi").withColumn("context", F.col("call_id"))
    # Calls that sit in a copied slice: operation and result are both part of it; they are summarised.
    inner = invocations.select(F.col("caller").alias("fn_id"), F.col("call_id").alias("_op"), F.col("result_id").alias("_res"), F.col("fn_id").alias("_callee"))
    for column in ("_op", "_res"):
        inner = inner.join(slices.select("fn_id", F.col("id").alias(column)), ["fn_id", column], "left_semi")
    inside = top.select("context", "fn_id").join(inner, "fn_id")
    mint = lambda node, context: F.concat_ws(":", node, F.lit("context"), context)
    nested = inside.filter(F.col("_callee") != F.col("fn_id")).select(
        mint(F.col("_op"), F.col("context")).alias("context"), F.col("_op").alias("call_id"), F.col("_callee").alias("fn_id"),
        mint(F.col("_res"), F.col("context")).alias("result_id"), F.col("context").alias("_outer"), F.col("fn_id").alias("_within"),
    )
    nested = nested.join(slices.select("fn_id").distinct(), "fn_id", "left_semi")
    base = ["context", "call_id", "fn_id", "result_id", "_outer", "_within"]
    top = top.withColumn("_outer", F.lit(None).cast("string")).withColumn("_within", F.lit(None).cast(dict(slices.dtypes)["fn_id"]))
    everyone = cut_lineage(top.select(*base).unionByName(nested.select(*base)))
    full, brief = everyone.filter(F.col("_outer").isNull()), everyone.filter(F.col("_outer").isNotNull())

    nodes = full.join(slices.select("fn_id", "id"), "fn_id").select(mint(F.col("id"), F.col("context")).alias("id"), F.col("id").alias("original"), F.col("context").alias("call_id"), F.lit("copy").alias("shape"))
    rest = F.coalesce("rest", F.lit(False)) if "rest" in parameters.columns else F.lit(False)
    params = parameters.select("fn_id", F.col("id").alias("_param"), F.col("position").alias("_at"), rest.alias("_rest"))
    with_params = brief.join(params, "fn_id")
    nodes = nodes.unionByName(with_params.select(mint(F.col("_param"), F.col("context")).alias("id"), F.col("_param").alias("original"), F.col("context").alias("call_id"), F.lit("parameter").alias("shape")))
    returning = returns.select("fn_id").distinct()
    answered = brief.join(returning, "fn_id", "left_semi")
    summary, exit_ = F.concat(F.lit("context-operation:"), F.col("context")), F.concat(F.lit("context-return:"), F.col("context"))
    nodes = nodes.unionByName(answered.select(summary.alias("id"), F.col("fn_id").cast("string").alias("original"), F.col("context").alias("call_id"), F.lit("summary").alias("shape")))
    nodes = nodes.unionByName(answered.select(exit_.alias("id"), F.col("fn_id").cast("string").alias("original"), F.col("context").alias("call_id"), F.lit("return").alias("shape")))

    ins = slices.select("fn_id", F.col("id").alias("dst"))
    body = inner_edges.join(ins, ["fn_id", "dst"], "left_semi").join(ins.withColumnRenamed("dst", "src"), ["fn_id", "src"], "left_semi").withColumn("_local", F.lit(True))
    if outer_edges is not None:
        body = body.unionByName(outer_edges.join(ins, ["fn_id", "dst"], "left_semi").withColumn("_local", F.lit(False)))
    passed = arguments.select("call_id", F.col("position").alias("_given"), "value_id")
    copied = full.join(body.filter("kind <> 'parameter-default'"), "fn_id").select("context", "src", "dst", "kind", "_local")
    if "kind" in template_edges.columns:
        default = body.filter("kind = 'parameter-default'").join(params.select("fn_id", F.col("_param").alias("dst"), "_at"), ["fn_id", "dst"])
        unset = full.join(default, "fn_id").join(passed.select("call_id", F.col("_given").alias("_at")), ["call_id", "_at"], "left_anti")
        copied = copied.unionByName(unset.select("context", "src", "dst", "kind", "_local"))
    source = F.when(F.col("_local"), mint(F.col("src"), F.col("context"))).otherwise(F.col("src"))
    edges = copied.select(source.alias("src"), mint(F.col("dst"), F.col("context")).alias("dst"), "kind", F.col("context").alias("call_id"))
    # An argument of a nested call counts when it was copied along with the slice around it.
    kept = slices.select(F.col("fn_id").alias("_within"), F.col("id").alias("value_id"))
    offered = everyone.join(passed, "call_id")
    offered = offered.filter(F.col("_outer").isNull()).unionByName(offered.filter(F.col("_outer").isNotNull()).join(kept, ["_within", "value_id"], "left_semi").select(*offered.columns))
    single = offered.join(params.filter(~F.col("_rest")).withColumnRenamed("_at", "_given"), ["fn_id", "_given"]).select("context", "_outer", "value_id", "_param")
    spread = offered.join(params.filter(F.col("_rest")), "fn_id").filter(F.col("_given") >= F.col("_at")).select("context", "_outer", "value_id", "_param")
    actual_id = F.when(F.col("_outer").isNull(), F.col("value_id")).otherwise(mint(F.col("value_id"), F.col("_outer")))
    edges = edges.unionByName(
        single.unionByName(spread).select(actual_id.alias("src"), mint(F.col("_param"), F.col("context")).alias("dst"), F.lit("passes-to").alias("kind"), F.col("context").alias("call_id"))
    )
    given = full.join(returns.select("fn_id", "id"), "fn_id")
    edges = edges.unionByName(given.select(mint(F.col("id"), F.col("context")).alias("src"), F.col("result_id").alias("dst"), F.lit("returns").alias("kind"), F.col("context").alias("call_id")))
    used = with_params.join(slices.filter("returns_it").select("fn_id", F.col("id").alias("_param")), ["fn_id", "_param"], "left_semi")
    edges = edges.unionByName(used.select(mint(F.col("_param"), F.col("context")).alias("src"), summary.alias("dst"), F.lit("transform").alias("kind"), F.col("context").alias("call_id")))
    edges = edges.unionByName(answered.select(summary.alias("src"), exit_.alias("dst"), F.lit("returns").alias("kind"), F.col("context").alias("call_id")))
    edges = edges.unionByName(answered.select(exit_.alias("src"), F.col("result_id").alias("dst"), F.lit("returns").alias("kind"), F.col("context").alias("call_id")))
    return nodes.distinct(), edges.distinct()


def expand_fields(models: DataFrame, fields: DataFrame, extends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Own and inherited fields of each model: a nearer definition hides a farther one of the same name.

    ``models`` (``model_id``); ``fields`` (``model_id``, ``name``, ``type``, ``pos``); ``extends`` (``model_id``, ``base_id``).
    Returns the fields with their ``origin`` and ``distance``, and per model ``expansion``: expanded, or partial /
    unexpanded when it or a base extends an unknown model or, over any number of steps, itself.
    """
    known = cut_lineage(models.select("model_id").distinct())
    up = extends.select("model_id", F.col("base_id").alias("origin"), F.lit(1).alias("distance")).distinct()
    up = cut_lineage(up.join(known, "model_id", "left_semi"))
    # Paths double in length each round; once no pair is new, every distance is the shortest one.
    pairs, before = up.count(), -1
    while pairs != before:
        onward = up.select(F.col("model_id").alias("origin"), F.col("origin").alias("_far"), F.col("distance").alias("_more"))
        longer = up.join(onward, "origin").select("model_id", F.col("_far").alias("origin"), (F.col("distance") + F.col("_more")).alias("distance"))
        up = cut_lineage(up.unionByName(longer).groupBy("model_id", "origin").agg(F.min("distance").alias("distance")))
        pairs, before = up.count(), pairs
    real = known.withColumnRenamed("model_id", "origin")
    cyclic = up.filter(F.col("model_id") == F.col("origin")).select("model_id")
    missing = up.join(real, "origin", "left_anti").select("model_id")
    below = up.join(cyclic.withColumnRenamed("model_id", "origin"), "origin", "left_semi").select("model_id")
    above = up.filter(F.col("model_id") != F.col("origin")).join(real, "origin", "left_semi")
    chain = known.select("model_id", F.col("model_id").alias("origin"), F.lit(0).alias("distance")).unionByName(above)
    listed = chain.join(fields.withColumnRenamed("model_id", "origin"), "origin")
    rest = [c for c in listed.columns if c not in ("model_id", "name")]
    nearest = listed.groupBy("model_id", "name").agg(F.min_by(F.struct(*rest), F.struct("distance", "origin")).alias("_f")).select("model_id", "name", "_f.*")
    marked = cyclic.unionByName(missing).unionByName(below).distinct().withColumn("_bad", F.lit(True))
    owned = nearest.groupBy("model_id").agg(F.count(F.lit(1)).alias("fields"))
    state = lookup_join(lookup_join(known, marked, ["model_id"]), owned, ["model_id"])
    expansion = F.when(F.col("_bad").isNull(), "expanded").when(F.coalesce("fields", F.lit(0)) > 0, "partial").otherwise("unexpanded")
    return nearest, state.select("model_id", expansion.alias("expansion"), F.coalesce("fields", F.lit(0)).alias("fields"))


def choice_fields(choices: DataFrame, expanded: DataFrame) -> DataFrame:
    """Fields of each union choice or alias (``model_id``, ``choice_id``, ``target_id``) from its target's expanded fields."""
    target = expanded.withColumnRenamed("model_id", "target_id").select("target_id", F.col("name").alias("field"), F.col("type").alias("field_type"))
    return choices.join(target, "target_id", "left").select("model_id", "choice_id", "target_id", "field", "field_type")
