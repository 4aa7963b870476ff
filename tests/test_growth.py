"""Rows that joins make: an operator must not multiply two groups that only meet in an aggregate."""

from __future__ import annotations

from pyspark.sql import functions as F


def joined_rows(df) -> int:
    """Most rows that any one join of the plan of ``df`` made."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if name.endswith("JoinExec"):
                most = max(most, node.metrics().apply("numOutputRows").value())
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return most


def test_command_words_meet_one_database_per_name(spark):
    from corpusloom.operators import commandgraph as CG

    n = 60
    words = F.array(F.lit("d1"), F.lit("execute"), F.lit("DB"))
    fragments = spark.range(n).select(F.col("id").alias("fragment_id"), F.lit(1).alias("package_id"), F.lit("wrangler").alias("executable"), F.lit("d1").alias("subcommand"), words.alias("positional"))
    stacks = spark.createDataFrame([], "stack_id string, fact_id string")
    held = spark.range(n).select(F.concat(F.lit("db"), "id").alias("fact_id"), (F.col("id") % 2).cast("int").alias("package_id"), F.col("id").alias("seq"), F.lit("db").alias("binding"), F.lit(None).cast("string").alias("database_name"))
    got = CG.command_targets(fragments, stacks, held.select("fact_id", "package_id", "seq").limit(0), held)
    assert joined_rows(got) <= n
    assert {(r["fragment_id"], r["fact_id"]) for r in got.collect()} == {(i, "db1") for i in range(n)}


def test_generators_meet_each_applying_operation_once(spark):
    from corpusloom.operators import architecture as A

    blank = F.lit(None).cast("string")
    node = lambda ids, kind, purpose: ids.select(F.col("id"), F.lit(kind).alias("kind"), purpose.alias("purpose"), blank.alias("logical_owner"))
    named = lambda prefix, n: spark.range(n).select(F.concat(F.lit(prefix), "id").alias("id"))
    nodes = node(named("g", 1), "tool-operation", F.lit("generate")).unionByName(node(named("a", 1), "tool-operation", F.lit("apply")))
    nodes = nodes.unionByName(node(named("t", 40), "artifact", blank)).unionByName(node(named("r", 30), "resource", blank))
    edge = lambda ids, src, dst, kind: ids.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"))
    edges = edge(named("t", 40), F.lit("g0"), F.col("id"), "flow-generates").unionByName(edge(named("t", 40), F.col("id"), F.lit("a0"), "flow-input"))
    edges = edges.unionByName(edge(named("r", 30), F.lit("a0"), F.col("id"), "flow-applies"))
    got = A.usage_targets(nodes, edges)
    assert joined_rows(got) <= 110
    assert {(r["id"], r["target"]) for r in got.collect()} == {(op, f"r{i}") for op in ("g0", "a0") for i in range(30)}


def test_units_of_an_overview_do_not_multiply_targets_out(spark, monkeypatch):
    """Generators meet the operations that apply their output, not all that these apply."""
    from corpusloom.operators import architecture as A

    most = [0]
    keep = A.cut_lineage
    monkeypatch.setattr(A, "cut_lineage", lambda df: (most.append(joined_rows(df)), keep(df))[1])
    row = lambda id_, kind, purpose=None: (id_, kind, None, [], False, purpose, None, "t", None, None, False)
    schema = "id string, kind string, parent_id string, environments array<string>, auxiliary boolean, purpose string, logical_owner string, tool string, request_owner string, definition_owner string, has_entry boolean"
    nodes = [row(f"{k}{i}", kind, purpose) for k, kind, purpose in (("g", "tool-operation", "generate"), ("a", "tool-operation", "apply"), ("t", "artifact", None)) for i in range(8)] + [row(f"r{i}", "resource") for i in range(240)]
    edges = [(f"g{i}", f"t{i}", "flow-generates") for i in range(8)] + [(f"t{i}", f"a{k}", "flow-input") for i in range(8) for k in range(8)] + [(f"a{i % 8}", f"r{i}", "flow-applies") for i in range(240)]
    units, _ = A.simple_overview(spark.createDataFrame(nodes, schema), spark.createDataFrame([(*e, "", "source") for e in edges], "src string, dst string, kind string, environment string, confidence string"))
    assert units.filter("rule = 'usage'").select("unit").distinct().count() == 16
    assert max(most) <= len(edges) + len(nodes)


def test_shared_declarations_are_counted_per_fact_not_per_scope(spark):
    """Evidence of one fact, of two facts of one stack and of two stacks, with and without a scope of its own."""
    from corpusloom.operators import views as V
    from corpusloom.operators.merge import stack_usage

    n, scopes = 90, 20
    facts = [("f1", "s1"), ("f2", "s1"), ("f3", "s2")]
    held = [(fact, "technology", stack, False, f"e{i}") for i in range(n) for k, (fact, stack) in enumerate(facts) if i % 3 == k or i % 7 == 0]
    used = [(fact, "technology", stack, False, f"u{fact}{i}") for i in range(scopes) for fact, stack in facts if (i + len(stack + fact) + int(fact[1])) % 3]
    places = [(row[4], f"none/{row[4]}.ts" if i % 11 else "p/d3/a.ts", None, "package-dependency", None) for i, row in enumerate(held)]
    places += [(row[4], f"p/d{row[4][3:]}/a.ts", None, "source-import", None) for row in used]
    evidence = spark.createDataFrame(places, "evidence_id string, path string, role string, detector_id string, scope_path string").dropDuplicates(["evidence_id"])
    fact = spark.createDataFrame(held + used, "fact_id string, fact_kind string, stack_id string, explicit boolean, evidence_id string")
    candidates = spark.createDataFrame([(f"p/d{i}", "package", "application", False, None) for i in range(scopes)], "path string, source string, kind string, explicit boolean, fact_id string")
    out = V.stack_map(fact, evidence, candidates, project="root")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    whole = out["attribution"]
    assert rows(out["usage"]) == rows(stack_usage(whole.withColumnRenamed("fact_kind", "kind")))
    want = {(r["scope"], r["n"]) for r in whole.groupBy("scope").agg(F.count_distinct("evidence_id").alias("n")).collect()}
    assert {(r["dst"], r["evidence"]) for r in out["edge"].collect()} == want
    assert whole.count() > 900 and joined_rows(out["usage"]) < whole.count() * 0.7


def test_evidence_of_one_fact_is_counted_where_it_meets_the_fact(spark, monkeypatch):
    """Only ids of evidence that several facts have are kept; repeated rows, recorded scopes and supporting evidence count as before."""
    import random

    from corpusloom.operators import views as V
    from corpusloom.operators.merge import stack_usage

    draw, n = random.Random(5), 400
    stored, keep = [], V.rewritten
    monkeypatch.setattr(V, "rewritten", lambda df: (stored.append(df.count()), keep(df))[1])
    held = [(f"f{k}", "technology", f"s{k % 2}", False, f"e{i}") for i in range(n) for k in {draw.randint(0, 3)} | ({draw.randint(0, 3)} if i % 20 == 0 else set())]
    held += held[:10]
    places = [(f"e{i}", f"p/d{draw.randint(0, 4)}/a.ts", draw.choice(["usage", "declaration", "scope"]), None, "p/d1" if i % 50 == 0 else None) for i in range(n)]
    fact = spark.createDataFrame(held, "fact_id string, fact_kind string, stack_id string, explicit boolean, evidence_id string")
    evidence = spark.createDataFrame(places, "evidence_id string, path string, role string, detector_id string, scope_path string")
    candidates = spark.createDataFrame([(f"p/d{i}", "package", "application", False, None) for i in range(3)], "path string, source string, kind string, explicit boolean, fact_id string")
    out = V.stack_map(fact, evidence, candidates, project="root")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert max(stored) < n / 2
    whole = V.attribute_usage(fact, evidence, V.scope_candidates(candidates).select(F.col("path").alias("owner_path"), "owner"))
    assert rows(out["attribution"].select(*whole.columns)) == rows(whole) and whole.count() > n / 2
    assert rows(out["usage"]) == rows(stack_usage(whole.withColumnRenamed("fact_kind", "kind")))
    assert {(r["dst"], r["evidence"]) for r in out["edge"].collect()} == {(r["scope"], r["n"]) for r in whole.groupBy("scope").agg(F.count_distinct("evidence_id").alias("n")).collect()}


def test_places_take_one_pass_over_a_long_line(spark):
    import time

    from corpusloom.functions import text as XF

    n = 30_000
    texts = spark.createDataFrame([(1, "x the\n\nthethe ünthe"), (2, ""), (3, None), (4, "the " * n)], "id int, text string")
    begun = time.time()
    rows = texts.select("id", F.explode(XF.places("text", "the")).alias("p")).select("id", "p.line", "p.col").collect()
    assert time.time() - begun < 20
    assert [tuple(r) for r in rows[:4]] == [(1, 1, 3), (1, 3, 1), (1, 3, 4), (1, 3, 10)]
    assert [r["col"] for r in rows[4:]] == list(range(1, 4 * n, 4))


def test_edges_meet_regions_as_counts_of_classes(spark):
    """Edges between nodes of the same regions are one row before any region is met."""
    import random

    from corpusloom.operators import bundles as B

    draw = random.Random(3)
    regions = {f"n{i}": {f"r{i % 3}", "all"} | ({"odd"} if i % 2 else set()) for i in range(40)}
    edges = [(f"n{draw.randint(0, 49)}", f"n{draw.randint(0, 49)}") for _ in range(2000)]
    held = spark.createDataFrame([(region, node) for node, of in regions.items() for region in of], "region string, id string")
    got = B.boundary_stats(spark.createDataFrame(edges, "src string, dst string"), held)
    want = set()
    for region in {"r0", "r1", "r2", "all", "odd"}:
        ends = [(region in regions.get(a, ()), region in regions.get(b, ())) for a, b in edges]
        want.add((region, ends.count((True, True)), ends.count((True, False)), ends.count((False, True))))
    assert {tuple(r) for r in got.collect()} == want
    assert joined_rows(got) <= len(edges)


def test_rows_of_a_small_file_are_dealt_before_costly_work(spark):
    from bindings import QUERIES

    for name in ("name_functions", "ddl_fields", "ddl_constraints", "manifest_forms"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan, name


def test_rounds_of_headers_do_not_compute_the_includes_anew(spark):
    from corpusloom.operators import imports as IM

    n, read = 6, spark.sparkContext.accumulator(0)

    def counted(name):
        read.add(1)
        return name

    names = spark.range(n).select(F.concat(F.lit("d/h"), "id", F.lit(".h")).alias("path"), F.concat(F.lit("h"), F.col("id") + 1, F.lit(".h")).alias("specifier"))
    includes = names.withColumn("specifier", F.udf(counted, "string")("specifier"))
    units = spark.createDataFrame([("d/h0.h", "c", ["x"])], "path string, language string, include_dirs array<string>")
    got = IM.header_languages(units, includes, names.select("path"))
    assert {tuple(r) for r in got.collect()} == {(f"d/h{i}.h", "c") for i in range(n)}
    assert read.value <= 2 * n


def test_imports_of_a_closure_are_computed_once(spark):
    """Unresolved imports have no files; paths of one file, a ring and a tail, counted over two projects with the same names."""
    from corpusloom.operators import imports as IM

    read = spark.sparkContext.accumulator(0)

    def counted(name):
        read.add(1)
        return name

    rows = [(p, f"f{n}", f"s{n}", f"f{(n + 1) % 10}", True) for p in "pq" for n in range(10)] + [("p", "f0", "tail", "t0", False), ("p", "t0", "s", "t1", True), ("q", "f3", "gone", None, True)]
    imports = spark.createDataFrame(rows, "project_id string, path string, specifier string, target string, reexport boolean").withColumn("specifier", F.udf(counted, "string")("specifier"))
    got = IM.reexport_counts(IM.reexport_reach(imports, ["project_id"]), ["project_id"])
    want = {(p, f"f{n}", f"s{n}", 10) for p in "pq" for n in range(10)} | {("p", "f0", "tail", 2), ("p", "t0", "s", 1)}
    assert {tuple(r) for r in got.select("project_id", "path", "specifier", "targets").collect()} == want
    assert read.value <= len(rows)


def test_edges_of_a_range_meet_their_ends_once(spark, monkeypatch):
    """Rounds move ids; the edges of the model are stored with the marks of their ends and as input and output, not again per step."""
    from corpusloom.operators import architecture as A

    stored = []
    for name in ("cut_lineage", "rewritten"):
        keep = getattr(A, name)
        monkeypatch.setattr(A, name, lambda df, keep=keep: (stored.append(df.count()) if {"dst", "other"} & set(df.columns) else None, keep(df))[1])
    n = 30
    node = lambda ids, kind, envs: ids.select("id", F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("parent_id"), envs.cast("array<string>").alias("environments"), F.lit("build").alias("purpose"), F.lit(None).cast("string").alias("logical_owner"))
    named = lambda prefix, size: spark.range(size).select(F.concat(F.lit(prefix), "id").alias("id"))
    nodes = node(named("o", 1), "tool-operation", F.array(F.lit("prod"))).unionByName(node(named("p", 1), "tool-operation", F.array())).unionByName(node(named("t", n), "artifact", F.array()))
    edge = lambda prefix, src, dst, kind: named("t", n).select(F.concat(F.lit(prefix), "id").alias("id"), src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), F.lit("").alias("environment"))
    edges = edge("g", F.lit("o0"), F.col("id"), "flow-generates").unionByName(edge("i", F.col("id"), F.lit("p0"), "flow-input"))
    roles, kept = A.content_range(nodes, edges, environment="prod")
    assert {(r["id"], r["role"]) for r in roles.collect()} == {("o0", "core"), ("p0", "peer")} | {(f"t{i}", "peer") for i in range(n)}
    assert {r["id"] for r in kept.collect()} == {f"{p}t{i}" for p in "gi" for i in range(n)}
    assert sum(stored) <= 2 * 2 * n


def test_names_of_a_scope_meet_only_scopes_that_declare_in_its_file(spark):
    """Forty enclosing scopes of other files, twenty names asked in one function: no row per name and scope."""
    from corpusloom.operators import calls as CA

    depth, names = 40, 20
    functions = [(f"f{i}", "far.ts", f"n{i}", "", f"f{i - 1}" if i else None, False, "typescript") for i in range(depth)]
    functions += [("own", "a.ts", "own", "", f"f{depth - 1}", False, "typescript"), ("n3", "a.ts", "n3", "", f"f{depth - 1}", False, "typescript")]
    functions = spark.createDataFrame(functions, "fn_id string, path string, name string, class_name string, parent string, default_export boolean, language string")
    scopes = [(f"f{i}", f"f{j}", i - j) for i in range(depth) for j in range(i + 1)]
    scopes += [(name, f"f{j}", depth - j) for name in ("own", "n3") for j in range(depth)] + [("own", "own", 0), ("n3", "n3", 0)]
    scopes = spark.createDataFrame(scopes, "id string, ancestor string, distance int")
    calls = spark.createDataFrame([(f"c{i}", "a.ts", "own", f"n{i}") for i in range(names)], "call_id string, path string, owner string, callee string")
    empty = lambda schema: spark.createDataFrame([], schema)
    none = (empty("path string, local string, original string, specifier string"), empty("path string, specifier string, target string, direct boolean"), empty("call_id string"))
    got = CA.resolve_calls(calls, functions, scopes, *none)
    assert joined_rows(got) <= 5 * names
    assert {(r["call_id"], r["target"]) for r in got.collect()} == {(f"c{i}", "n3" if i == 3 else None) for i in range(names)}
