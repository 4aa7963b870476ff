"""Command closure and command targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.commands import TOOL_TECHNOLOGY
from ..functions.names import mapped
from ..plans import cut_lineage, lookup_join


def command_closure(entries: DataFrame, fragments: DataFrame, needs: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Expand scripts into command fragments and the scripts those run.

    ``entries``: ``script_id``; ``fragments``: ``script_id``, ``seq`` (from 0), ``text``, ``target`` (script run, or null);
    ``needs``: ``script_id``, ``needs`` (CI prerequisite).  Every script is placed once per entry, at its first position
    in textual order; prerequisites come before the script's own commands.

    Returns scripts (``entry``, ``script_id``, ``rank``, ``depth``, ``branch``, ``lane``), fragments with the same columns, and
    cycles (``entry``, ``script_id``, ``target``).  The place is the lexicographically smallest chain of steps, found by
    relaxation; a chain is as long as the nesting of scripts.
    """
    steps = fragments.filter(F.col("target").isNotNull()).select(
        "script_id", "target", (F.col("seq") + 1).alias("step"), (F.col("seq") + 2).alias("up"), F.concat(F.lit("."), (F.col("seq") + 1).cast("string")).alias("tail")
    )
    if needs is not None:
        steps = steps.unionByName(needs.select("script_id", F.col("needs").alias("target"), F.lit(0).alias("step"), F.lit(-1).alias("up"), F.lit("").alias("tail")).select(*steps.columns))
    steps = cut_lineage(steps)
    first = entries.select(
        F.col("script_id").alias("entry"), "script_id", F.array().cast("array<int>").alias("place"), F.array("script_id").alias("chain"),
        F.lit(1).alias("rank"), F.lit(1).alias("depth"), F.lit("root").alias("branch"),
    )
    best = cut_lineage(first)
    frontier = best
    while not frontier.isEmpty():
        grown = frontier.join(steps, "script_id").filter(~F.array_contains("chain", F.col("target")))
        grown = grown.select(
            "entry", F.col("target").alias("script_id"), F.concat("place", F.array("step")).alias("place"), F.concat("chain", F.array("target")).alias("chain"),
            F.greatest(F.col("rank") + F.col("up"), F.lit(0)).alias("rank"), (F.col("depth") + F.when(F.col("up") < 0, 1).otherwise(2)).alias("depth"), F.concat("branch", "tail").alias("branch"),
        )
        rest = [c for c in best.columns if c not in ("entry", "script_id")]
        candidate = grown.groupBy("entry", "script_id").agg(F.min_by(F.struct(*rest), "place").alias("_c")).select("entry", "script_id", "_c.*")
        old = best.select("entry", "script_id", F.col("place").alias("_place"))
        better = candidate.join(old, ["entry", "script_id"], "left").filter(F.col("_place").isNull() | (F.col("place") < F.col("_place"))).drop("_place")
        frontier = cut_lineage(better)
        kept = best.join(frontier.select("entry", "script_id"), ["entry", "script_id"], "left_anti")
        best = cut_lineage(kept.unionByName(frontier))
    lane = F.when(F.size("place") == 0, "COMMON").otherwise(F.concat(F.lit("lane:"), F.element_at(F.when(F.size("place") > 0, F.col("place")).otherwise(F.array(F.lit(0))), 1).cast("string")))
    scripts = best.select("entry", "script_id", "rank", "depth", "branch", lane.alias("lane"))
    own = best.select("entry", "script_id", "rank", "depth", "branch").join(fragments, "script_id")
    placed = own.select(
        "entry", "script_id", "seq", "text", "target", (F.col("rank") + 1 + F.col("seq")).alias("rank"), (F.col("depth") + 1).alias("depth"), F.concat("branch", F.lit("."), (F.col("seq") + 1).cast("string")).alias("branch")
    )
    cycles = best.select("entry", "script_id", "chain").join(steps, "script_id").filter(F.array_contains("chain", F.col("target"))).select("entry", "script_id", "target").distinct()
    return scripts, placed, cycles


# Executables that only use their technology, and worker subcommands that start the runtime.
USING_TOOLS = ("tsc", "drizzle-kit")
EXTRA_TOOLS = {"vite": "vite", "vitest": "vitest", "tsc": "typescript", "drizzle-kit": "drizzle-orm"}
STARTING_SUBCOMMANDS = ("dev", "deploy")


def command_targets(fragments: DataFrame, technologies: DataFrame, runtimes: DataFrame, databases: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Fact a command works on: (``fragment_id``, ``fact_id``, ``kind``).

    ``fragments``: ``fragment_id``, ``package_id``, ``executable``, ``subcommand``, ``positional`` (array); ``technologies``:
    ``stack_id``, ``fact_id``; ``runtimes``/``databases``: ``fact_id``, ``package_id``, ``seq`` (databases also ``binding``,
    ``database_name``).  Worker commands take the runtime of their package, else the first; database commands take the
    named binding, else the first, of their package, else of all.
    """
    stack = mapped("executable", {**TOOL_TECHNOLOGY, **EXTRA_TOOLS})
    known = technologies.groupBy(*by, "stack_id").agg(F.min("fact_id").alias("fact_id"))
    tools = fragments.filter("executable <> 'wrangler'").withColumn("stack_id", stack)
    plain = lookup_join(tools, known, [*by, "stack_id"], "inner").select(*by, "fragment_id", "fact_id", F.when(F.col("executable").isin(*USING_TOOLS), "uses").otherwise("starts").alias("kind"))

    workers = fragments.filter("executable = 'wrangler'")
    own = runtimes.groupBy(*by, "package_id").agg(F.min_by("fact_id", "seq").alias("_own"))
    # Without partition columns the corpus-wide first is one row; a constant key joins it.
    key = [*by, "_k"]
    one = (lambda frame: frame) if by else F.broadcast  # a single row
    any_ = one(runtimes.withColumn("_k", F.lit(1)).groupBy(*key).agg(F.min_by("fact_id", "seq").alias("_any")))
    served = workers.filter(F.coalesce("subcommand", F.lit("")).isin(*STARTING_SUBCOMMANDS, "types")).withColumn("_k", F.lit(1))
    served = lookup_join(lookup_join(served, own, [*by, "package_id"]), any_, key)
    runtime = served.withColumn("fact_id", F.coalesce("_own", "_any")).filter("fact_id is not null").select(*by, "fragment_id", "fact_id", F.when(F.col("subcommand") == "types", "uses").otherwise("starts").alias("kind"))

    asked = workers.filter("subcommand = 'd1'").withColumn("_k", F.lit(1))
    per_package = databases.groupBy(*by, "package_id").agg(F.min_by("fact_id", "seq").alias("_own"))
    overall = one(databases.withColumn("_k", F.lit(1)).groupBy(*key).agg(F.min_by("fact_id", "seq").alias("_any")))
    names = databases.select(*by, "package_id", "fact_id", "seq", F.explode(F.array_distinct(F.array_compact(F.array(F.lower("binding"), F.lower("database_name"))))).alias("name"))
    words = asked.select(*by, "fragment_id", "package_id", F.posexplode(F.slice("positional", 2, F.greatest(F.size("positional"), F.lit(1)))).alias("_at", "_word")).withColumn("name", F.lower("_word"))
    # Only the first database of a name can be meant, so names are reduced before any word meets them.
    first = [F.min_by("fact_id", "seq").alias("fact_id"), F.min("seq").alias("seq")]
    in_package, anywhere = names.groupBy(*by, "package_id", "name").agg(*first), names.groupBy(*by, "name").agg(*first)
    local = lookup_join(words, in_package, [*by, "package_id", "name"], "inner").groupBy(*by, "fragment_id").agg(F.min_by("fact_id", F.struct("_at", "seq")).alias("_named_own"))
    wide = lookup_join(words, anywhere, [*by, "name"], "inner").groupBy(*by, "fragment_id").agg(F.min_by("fact_id", F.struct("_at", "seq")).alias("_named_any"))
    joined = lookup_join(lookup_join(asked, per_package, [*by, "package_id"]), overall, key)
    joined = lookup_join(lookup_join(joined, local, [*by, "fragment_id"]), wide, [*by, "fragment_id"])
    target = F.when(F.col("_own").isNotNull(), F.coalesce("_named_own", "_own")).otherwise(F.coalesce("_named_any", "_any"))
    database = joined.withColumn("fact_id", target).filter("fact_id is not null").select(*by, "fragment_id", "fact_id", F.lit("uses").alias("kind"))
    return plain.unionByName(runtime).unionByName(database)
