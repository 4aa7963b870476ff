import re

from pyspark.sql import functions as F

from conftest import values
from corpusloom.functions.paths import glob_regex
from corpusloom.operators.filters import glob_join
from corpusloom.operators.lookups import match_members
from corpusloom.plans import Blocks, checkpoint_folder, lookup_join, only_value, positions, store_partitioned


def test_hot_key_is_split_over_blocks(spark):
    rows = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id").alias("at"))
    cut = Blocks(rows, ["k"], ["at"], blocks=8)
    sizes = [r["n"] for r in cut.rows.groupBy("_block").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1500


def test_positions_match_row_number(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"), ((F.col("id") * 7919) % 3001).alias("at"))
    placed = positions(rows, ["k"], ["at"], index="i", count="n", blocks=6)
    from pyspark.sql import Window

    want = rows.withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("at"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("k")))
    assert values(placed, "k", "at", "i", "n") == values(want, "k", "at", "i", "n")


def test_only_value(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2), ("c", None)], "k string, v int")
    assert values(rows.groupBy("k").agg(only_value("v").alias("v"))) == [("a", 1), ("b", None), ("c", None)]


def test_salted_lookup_equals_plain(spark):
    left = spark.range(500).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("k"), "id", F.create_map(F.lit("a"), F.col("id")).alias("m"))
    right = spark.range(300).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    plain, salted = lookup_join(left, right, ["k"]), lookup_join(left, right, ["k"], salt=4)
    assert values(plain, "k", "id", "v") == values(salted, "k", "id", "v")


def test_checkpoint_folder_is_kept(spark):
    first = checkpoint_folder(spark)
    assert checkpoint_folder(spark) == first


def test_stored_side_is_not_moved_again(spark):
    stored = store_partitioned(spark.range(2000).select((F.col("id") % 100).alias("k"), "id"), ["k"])
    joined = spark.range(50).select(F.col("id").alias("k")).join(stored, "k")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1
    assert joined.count() == 1000 and spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_glob_keys_lose_no_match(spark):
    paths = sorted({f"{a}{b}{leaf}" for a in ("", "src/", "lib/x/") for b in ("", "en/", "a+b/c/") for leaf in ("m.ts", "m.d.ts", "README", ".env", "x")})
    globs = ["**", "*", "*/*", "**/x", "*.ts", "**/*.ts", "**.d.ts", "src/**", "src/*", "*/en/*", "R*", "?rc/m.ts", "src/en/x", "./lib/x/*/", "README", "**/.e*", "lib/x/a+b/**", "*b/c/m*"]
    table = spark.createDataFrame([(p,) for p in paths], "path string")
    patterns = spark.createDataFrame([(g, g) for g in globs], "project string, pattern string")
    every = table.crossJoin(patterns.select("project"))  # a fixture of 45 paths
    want = sorted((g, p) for g in globs for p in paths if re.match(glob_regex(g), p, re.S))
    assert values(glob_join(every, patterns, by=["project"]), "project", "path") == want
    rejected = patterns.select("project", F.explode(F.array(F.lit("**"), F.concat(F.lit("!"), "pattern"))).alias("pattern"))
    assert values(glob_join(every, rejected, by=["project"]), "project", "path") == sorted({(g, p) for g in globs for p in paths} - set(want))
    _, unmatched = match_members(spark.createDataFrame([(g,) for g in [*globs, "none/*", "*.nope"]], "pattern string"), table)
    assert values(unmatched) == [("*.nope",), ("none/*",)]


def test_shuffle_partitions_follow_the_rows(spark, monkeypatch):
    from bindings import code, registry
    from corpusloom import session

    monkeypatch.setattr(session, "PARTITION_ROWS", 3)
    lines = spark.createDataFrame([(o, n, (o + n) % 7) for o in range(10) for n in range(1, 4)], "l_orderkey long, l_linenumber int, l_partkey long")
    tables = registry.Tables(spark, "unused")
    tables.lineitem = lines
    found = code.reexport_reach(tables)
    names = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum"), spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert names == ("10", "8m") and found.count() > 0
    registry.Tables(spark, "unused")  # the next query begins without them
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) is None


def test_reexport_counts_do_not_meet_imports_by_component(spark, monkeypatch):
    from corpusloom.operators import imports as IM

    # All files are one component: imports must be joined by their target file, of which there are many.
    rows = [(f"f{n}", f"s{n}", f"f{(n + 1) % 20}", True) for n in range(20)]
    found = IM.reexport_reach(spark.createDataFrame(rows, "path string, specifier string, target string, reexport boolean"))
    joined = []
    plain = IM.lookup_join
    monkeypatch.setattr(IM, "lookup_join", lambda left, right, on, *more: joined.append(list(on)) or plain(left, right, on, *more))
    assert {tuple(r) for r in IM.reexport_counts(found).collect()} == {(f"f{n}", f"s{n}", 20) for n in range(20)}
    assert joined[-1] == ["target"]


def test_locked_rows_are_written_once_per_version(spark):
    from corpusloom.operators import lookups as L

    deps = spark.createDataFrame([("a", "a", n, "cargo", "*") for n in ("x", "y", "z")], "project_dir string, project_name string, name string, ecosystem string, version_range string")
    held = [("x", "1.0.0", "r"), ("x", "1.0.0", "s"), ("y", "1.0.0", "r"), ("y", "2.0.0", "r"), ("z", "1.0.0", "r"), ("a", "0.1.0", None)]
    kind = "lock_dir string, ecosystem string, name string, version string, source_identity string, descriptor string, framework string, importer string"
    locks = spark.createDataFrame([("a", "cargo", n, v, o, None, None, None) for n, v, o in held], kind)
    asks = spark.createDataFrame([("a", "cargo", "a", "x", None, None), ("a", "cargo", "a", "y", "2.0.0", None)], "lock_dir string, ecosystem string, owner string, name string, version string, source_identity string")
    found = L.resolve_versions(deps, locks, asks=asks)
    assert {(r.name, r.status, r.resolved_version) for r in found.collect()} == {("x", "ambiguous", None), ("y", "resolved", "2.0.0"), ("z", "unlocked", None)}
    # Two distinct counts side by side would write every row three times.
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()
