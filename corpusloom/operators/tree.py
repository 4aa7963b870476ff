"""Trees given as (``id``, ``parent_id``), by pointer doubling: rounds grow with the logarithm of the depth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import rewritten, lookup_join


def ancestors(parents: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(``id``, ``ancestor``, ``distance``) including each node itself at distance 0.

    On a parent cycle every node is listed once, at its shortest distance.
    """
    keys = [*by, "id", "ancestor"]
    links = parents.filter(F.col("parent_id").isNotNull())
    jumps = rewritten(links.select(*by, "id", F.col("parent_id").alias("to")))
    closure = rewritten(parents.select(*by, "id", F.col("id").alias("ancestor"), F.lit(0).alias("distance")))
    step = 1
    while True:
        # A node's ancestors beyond `step` are the ancestors of its `step`-th ancestor.
        further = jumps.join(
            closure.select(*by, F.col("id").alias("to"), "ancestor", "distance"), [*by, "to"]
        ).select(*keys, (F.col("distance") + step).alias("distance"))
        new = further.groupBy(*keys).agg(F.min("distance").alias("distance"))
        new = rewritten(new.join(closure.select(*keys), keys, "left_anti"))
        if new.isEmpty():
            return closure
        closure = closure.unionByName(new)  # pieces stay stored; there are as many as rounds
        active = new.select(*by, "id").distinct()
        hop = jumps.select(*by, F.col("id").alias("to"), F.col("to").alias("_next"))
        jumps = jumps.join(active, [*by, "id"], "left_semi").join(hop, [*by, "to"]).select(*by, "id", F.col("_next").alias("to"))
        jumps = rewritten(jumps)
        step *= 2


def roots(parents: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Root and depth of every node; ``cyclic`` marks chains that run into a parent cycle (no root)."""
    has_parent = F.col("parent_id").isNotNull()
    state = parents.select(
        *by, "id", F.coalesce("parent_id", "id").alias("root"), F.when(has_parent, 1).otherwise(0).alias("depth"), (~has_parent).alias("settled")
    )
    known = parents.select(*by, F.col("id").alias("root"), F.lit(True).alias("_known"))
    state = lookup_join(state, known, [*by, "root"])
    # A parent outside the table ends the chain at the last known node.
    state = state.select(
        *by, "id", F.when(F.col("_known"), F.col("root")).otherwise(F.col("id")).alias("root"),
        F.when(F.col("_known"), F.col("depth")).otherwise(0).alias("depth"), (F.col("settled") | F.col("_known").isNull()).alias("settled"),
    )
    state = rewritten(state)
    open_nodes = state.filter(~F.col("settled")).count()
    covered = 1
    while open_nodes and covered <= open_nodes:
        top = state.select(*by, F.col("id").alias("root"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("settled").alias("_settled"))
        joined = lookup_join(state, top, [*by, "root"])
        move = ~F.col("settled")
        state = rewritten(
            joined.select(
                *by, "id", F.when(move, F.col("_root")).otherwise(F.col("root")).alias("root"),
                F.when(move, F.col("depth") + F.col("_depth")).otherwise(F.col("depth")).alias("depth"),
                F.when(move, F.col("_settled")).otherwise(True).alias("settled"),
            )
        )
        covered *= 2
        left = state.filter(~F.col("settled")).count()
        if left == 0:
            break
    return state.select(
        *by, "id", F.when(F.col("settled"), F.col("root")).alias("root"), F.when(F.col("settled"), F.col("depth")).alias("depth"), (~F.col("settled")).alias("cyclic")
    )


def children(parents: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return parents.filter(F.col("parent_id").isNotNull()).groupBy(*by, F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("children"))


def subtree_totals(parents: DataFrame, weights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(``id``, ``total``): the ``weight`` of every node and of all nodes below it.  ``weights``: ``id``, ``weight``.

    Doubling without a closure: after k rounds a node has the total of its descendants less than 2^k levels below and
    hands it to its ancestor 2^k levels above, so every round is one row per node.  Nodes of a parent cycle are below each
    other and get one total.
    """
    known = parents.select(*by, F.col("id").alias("up"), F.lit(True).alias("_known"))
    up = F.when(F.col("parent_id") != F.col("id"), F.col("parent_id"))
    state = parents.select(*by, "id", up.alias("up")).join(weights.select(*by, "id", "weight"), [*by, "id"], "left")
    state = lookup_join(state, known, [*by, "up"]).select(*by, "id", F.when(F.col("_known"), F.col("up")).alias("up"), F.coalesce("weight", F.lit(0)).alias("total"))
    start = state = rewritten(state)
    most, reach = state.count(), 1
    while reach <= most:
        given = state.filter("up is not null").groupBy(*by, F.col("up").alias("id")).agg(F.sum("total").alias("_given"))
        above = state.select(*by, F.col("id").alias("up"), F.col("up").alias("_up"))
        joined = lookup_join(lookup_join(state, given, [*by, "id"]), above, [*by, "up"])
        state = rewritten(joined.select(*by, "id", F.col("_up").alias("up"), (F.col("total") + F.coalesce("_given", F.lit(0))).alias("total")))
        reach *= 2
        if state.filter("up is not null").isEmpty():
            return state.select(*by, "id", "total")
    # Whoever still points upwards comes to a cycle, and after so many steps stands on it: each cycle becomes one root.
    on_cycle = rewritten(state.filter("up is not null").select(*by, F.col("up").alias("id")).distinct())
    ring = rewritten(start.join(on_cycle, [*by, "id"], "left_semi").select(*by, "id", "up", F.col("id").alias("name")))
    reach = 1
    while reach <= most:
        ahead = ring.select(*by, F.col("id").alias("up"), F.col("up").alias("_up"), F.col("name").alias("_name"))
        ring = rewritten(ring.join(ahead, [*by, "up"]).select(*by, "id", F.col("_up").alias("up"), F.least("name", "_name").alias("name")))
        reach *= 2
    names = ring.select(*by, "id", "name")
    renamed = lookup_join(start, names, [*by, "id"])
    renamed = lookup_join(renamed, names.select(*by, F.col("id").alias("up"), F.col("name").alias("_above")), [*by, "up"])
    merged = renamed.select(*by, F.coalesce("name", "id").alias("id"), F.when(F.col("name").isNull(), F.coalesce("_above", "up")).alias("parent_id"), "total")
    merged = rewritten(merged.groupBy(*by, "id").agg(F.max("parent_id").alias("parent_id"), F.sum("total").alias("weight")))
    totals = subtree_totals(merged, merged, by)
    shared = lookup_join(names, totals.select(*by, F.col("id").alias("name"), "total"), [*by, "name"], "inner").select(*by, "id", "total")
    return totals.join(on_cycle, [*by, "id"], "left_anti").unionByName(shared)


def scope_members(owners: DataFrame, parents: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Nodes counted in every scope above their own: ``owners`` (``id``, ``scope``), ``parents`` (``id``, ``parent_id``) of the scopes.

    Nodes are counted per own scope first; totals are rolled up without a table of ancestors.
    """
    own = rewritten(owners.groupBy(*by, F.col("scope").alias("id")).agg(F.count(F.lit(1)).alias("weight")))
    totals = subtree_totals(parents, own, by).filter("total > 0")
    counted = totals.join(own, [*by, "id"], "left")
    return counted.select(*by, F.col("id").alias("scope"), F.col("total").alias("members"), F.coalesce("weight", F.lit(0)).alias("direct"))


def tree_paths(closure: DataFrame, by: Sequence[str] = (), separator: str = "/") -> DataFrame:
    """Root-to-node path of each node.  The list holds one entry per level, so its size is the tree depth."""
    steps = F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("at"), "ancestor")))
    ordered = closure.groupBy(*by, "id").agg(steps.alias("_steps"), F.max("distance").alias("depth"))
    names = F.transform("_steps", lambda step: step["ancestor"].cast("string"))
    return ordered.select(*by, "id", "depth", F.array_join(names, separator).alias("path"))


def directory_tree(modules: DataFrame, by: Sequence[str] = (), base: str = "package_path", path: str = "path") -> DataFrame:
    """Directories between a package and its modules: depth, direct modules, child directories."""
    from ..functions.paths import dir_name, path_prefixes

    placed = modules.select(*by, base, dir_name(path).alias("_dir"))
    counted = placed.groupBy(*by, base, "_dir").agg(F.count(F.lit(1)).alias("_n"))
    below = F.when(F.col(base) == ".", F.col("_dir") != ".").otherwise(F.col("_dir").startswith(F.concat(base, F.lit("/"))))
    skip = F.when(F.col(base) == ".", 0).otherwise(F.size(F.split(base, "/")))
    prefixes = counted.filter(below).select(
        *by, base, "_dir", "_n", skip.alias("_skip"),
        F.explode(F.filter(path_prefixes("_dir"), lambda p: F.size(F.split(p, "/")) > skip)).alias("path"),
    )
    direct = F.when(F.col("path") == F.col("_dir"), F.col("_n")).otherwise(0)
    rows = prefixes.groupBy(*by, base, "path", "_skip").agg(F.sum(direct).alias("modules"))
    rows = rows.withColumn("depth", F.size(F.split("path", "/")) - F.col("_skip") - 1).withColumn("parent", dir_name("path"))
    per_parent = rows.groupBy(*by, base, F.col("parent").alias("path")).agg(F.count(F.lit(1)).alias("children"))
    joined = lookup_join(rows.drop("_skip"), per_parent, [*by, base, "path"])
    parent = F.when(F.col("depth") > 0, F.col("parent"))
    return joined.withColumn("children", F.coalesce("children", F.lit(0))).withColumn("parent", parent)


def compress_chain(directories: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Merge directories without modules into their only child: each directory gets the ``terminal`` of its chain.

    ``directories``: ``path``, ``parent``, ``modules``, ``children``.
    """
    passing = (F.col("modules") == 0) & (F.col("children") == 1)
    only_child = directories.filter(F.col("parent").isNotNull()).groupBy(*by, F.col("parent").alias("path")).agg(F.min("path").alias("_child"))
    state = lookup_join(directories.select(*by, "path", passing.alias("_pass")), only_child, [*by, "path"])
    links = state.select(*by, F.col("path").alias("id"), F.when(F.col("_pass"), F.col("_child")).alias("parent_id"))
    ends = roots(links, by).select(*by, F.col("id").alias("path"), F.col("root").alias("terminal"))
    return lookup_join(directories, ends, [*by, "path"])


def chain_groups(compressed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per chain: terminal, number of merged directories, and the terminal of the chain above it."""
    top = compressed.groupBy(*by, "terminal").agg(F.count(F.lit(1)).alias("folded"), F.min_by("parent", F.length("path")).alias("_above"))
    lookup = compressed.select(*by, F.col("path").alias("_above"), F.col("terminal").alias("parent_terminal"))
    return lookup_join(top, lookup, [*by, "_above"]).drop("_above")
