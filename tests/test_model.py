import math
import random

from pyspark.sql import functions as F

from conftest import values
from corpusloom.operators import architecture as A
from corpusloom.operators import commandgraph as CG
from corpusloom.operators import groups as G
from corpusloom.operators import lookups as L
from corpusloom.operators import merge as M
from corpusloom.operators import owners as O
from corpusloom.operators import quality as Q
from corpusloom.operators import search as SE
from corpusloom.operators import spans as S
from corpusloom.operators import views as V
from corpusloom.streaming import bracket_rows, open_brackets, pair_trigger, start_brackets


def test_crowding_matches_brute_force(spark):
    rng = random.Random(5)
    points = [(i, rng.choice([rng.uniform(0, 400), 50 + rng.uniform(0, 3)]), rng.uniform(0, 400)) for i in range(160)]
    frame = spark.createDataFrame(points, "id int, x double, y double")
    want = [(i,) for i, x, y in points if any(j != i and math.hypot(a - x, b - y) < 12 for j, a, b in points)]
    assert values(G.crowded_points(frame)) == sorted(want, key=repr)


def test_ownership_rules(spark):
    # Two dense grids of 40 in one wide parent; one point protected, one group expanded, one manual group first.
    rows = [(f"{g}{i}", g, (i % 8) * 4.0 + (0 if g == "a" else 500), (i // 8) * 4.0) for g in "ab" for i in range(40)]
    points = spark.createDataFrame([(i, x, y, "c") for i, _, x, y in rows], "id string, x double, y double, category string")
    memberships = spark.createDataFrame([(g, i) for i, g, _, _ in rows] + [("all", i) for i, _, _, _ in rows], "group_id string, id string")
    groups = spark.createDataFrame([("a", 1, None, 8), ("b", 1, None, 8), ("all", 2, 100.0, 8)], "group_id string, level int, maximum_span double, minimum_members int")
    metrics = G.density(points, memberships, groups)
    eligible = G.eligible_groups(metrics, groups)
    assert values(eligible, "group_id", "pass") == [("a", 1), ("all", 2), ("b", 1)]
    protected = spark.createDataFrame([("a0",)], "id string")
    owners = dict(values(G.assign_owners(points, memberships, eligible, protected=protected), "id", "owner"))
    assert owners["a0"] == "a0" and owners["a1"] == "automatic:a" and owners["b5"] == "automatic:b" and len(owners) == 80
    opened = spark.createDataFrame([("a",)], "group_id string")
    owners = dict(values(G.assign_owners(points, memberships, eligible, expanded=opened), "id", "owner"))
    assert owners["a1"] == "a1" and owners["b1"] == "automatic:b"
    manual = spark.createDataFrame([("m", "b1", 0), ("m", "b2", 0)], "group_id string, id string, seq int")
    owned = G.assign_owners(points, memberships, eligible, manual=manual)
    assert dict(values(owned, "id", "owner"))["b1"] == "manual:m"
    counts = G.aggregation_counts(owned).first()
    assert (counts["scope"], counts["individual"], counts["manual_members"], counts["automatic_members"]) == (80, 0, 2, 78)


def test_overlapping_groups_of_a_level_match_turns_one_by_one(spark):
    points = spark.createDataFrame([(i,) for i in range(4)], "id int")
    members = spark.createDataFrame([("A", 0), *[("B", i) for i in range(4)]], "group_id string, id int")
    eligible = spark.createDataFrame([("A", 1, 1, 0), ("B", 1, 1, 1)], "group_id string, level int, pass int, seq int")
    assert {r["owner"] for r in G.assign_owners(points, members, eligible).collect()} == {"automatic:B"}
    rng = random.Random(11)
    for _ in range(4):
        groups = [(f"g{g}", rng.choice([1, 2, None]), rng.choice([1, 2]), rng.randrange(6)) for g in range(18)]
        member = sorted({(g[0], rng.randrange(40)) for g in groups for _ in range(rng.randrange(1, 7))})
        free, want = set(range(40)), {i: str(i) for i in range(40)}
        low = float("-inf")
        order = lambda g: (g[2], *((-(low if g[1] is None else g[1]), g[3]) if g[2] == 1 else (low if g[1] is None else g[1], -g[3])), g[0])
        for group, *_ in sorted(groups, key=order):
            mine = [i for g, i in member if g == group and i in free]
            if len(mine) >= 2:
                free -= set(mine)
                want.update({i: f"automatic:{group}" for i in mine})
        got = G.assign_owners(
            spark.createDataFrame([(i,) for i in range(40)], "id int"),
            spark.createDataFrame(member, "group_id string, id int"),
            spark.createDataFrame(groups, "group_id string, level int, pass int, seq int"),
        )
        assert dict(values(got, "id", "owner")) == want


def test_density_history_loosens_limits(spark):
    points = spark.createDataFrame([(i, (i % 4) * 18.0, (i // 4) * 18.0) for i in range(16)], "id int, x double, y double")
    memberships = points.select(F.lit("g").alias("group_id"), "id")
    groups = spark.createDataFrame([("g", 1, None, 8)], "group_id string, level int, maximum_span double, minimum_members int")
    metrics = G.density(points, memberships, groups)
    active = groups.select("group_id")
    # Spacing 13.5: dense both ways; scaled by 1.3 it is only kept by history.
    wide = metrics.withColumn("spacing", F.col("spacing") * 1.3)
    assert G.eligible_groups(metrics, groups).count() == 1
    assert G.eligible_groups(wide, groups).count() == 0 and G.eligible_groups(wide, groups, active).count() == 1


def test_merge_last_wins(spark):
    facts = spark.createDataFrame([("a", 1, "x", ["e1"], {"k": "1", "m": "1"}, False), ("a", 2, "y", ["e1", "e2"], {"k": "2"}, True)], "id string, seq int, label string, evidence_ids array<string>, metadata map<string,string>, explicit boolean")
    assert values(M.merge_facts(facts, flags=["explicit"]), "id", "label", "occurrences", "explicit") == [("a", "x", 2, True)]
    assert values(M.merged_metadata(facts)) == [("a", "k", "2"), ("a", "m", "1")] and values(M.merged_set(facts, "evidence_ids")) == [("a", "e1"), ("a", "e2")]


def test_brackets_with_one_hot_thread(spark):
    rng = random.Random(9)
    events, stack, closed, orphans = [], [], set(), set()
    for i in range(600):
        phase = rng.choice("BBE E".replace(" ", ""))
        events.append(("t", i, i, phase))
        if phase == "B":
            stack.append(i)
        elif stack:
            begin = stack.pop()
            closed.add((begin, i, stack[-1] if stack else None))
        else:
            orphans.add(i)
    frame = spark.createDataFrame(events, "thread string, position int, event_id int, phase string")
    paired = S.bracket_pairs(frame, ["thread"], ["position"])
    assert {r["event_id"] for r in paired.filter("orphan").collect()} == orphans
    spans = S.complete_brackets(paired, ["thread"], ["position"])
    got = {(r["event_id"], r["end_item"], r["parent_item"]) for r in spans.filter("end_item is not null").collect()}
    assert got == closed and spans.filter("end_item is null").count() == len(stack)


def test_stream_pairs_over_triggers_and_a_restart(spark, tmp_path):
    schema = "thread string, position bigint, item bigint, phase string"
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    deliver = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
    go = lambda **more: start_brackets(spark.readStream.option("maxFilesPerTrigger", 1).schema(schema).parquet(source), folder, **more).awaitTermination()
    columns = ("thread", "begin_item", "end_item", "depth", "parent_item", "status")
    deliver(("t", 1, 1, "B"), ("t", 2, 2, "B"), ("u", 1, 9, "E"), ("v", 1, 20, "B"))
    go()
    assert values(bracket_rows(spark, folder), *columns) == [("u", None, 9, None, None, "orphan")]
    # A new query goes on with what the first one left open; rows behind a thread's last position are late.
    deliver(("t", 3, 3, "E"), ("t", 4, 4, "B"))
    deliver(("t", 2, 5, "E"), ("t", 5, 6, "E"), ("t", 6, 7, "E"), ("t", 7, 8, "E"))
    go()
    want = [("t", 1, 7, 1, None, "closed"), ("t", 2, 3, 2, 1, "closed"), ("t", 4, 6, 2, 1, "closed"), ("t", None, 5, None, None, "late"), ("t", None, 8, None, None, "orphan"), ("u", None, 9, None, None, "orphan")]
    assert values(bracket_rows(spark, folder), *columns) == sorted(want, key=repr) and values(open_brackets(spark, folder, 2), "item") == [(20,)]
    # A silent thread is given up.
    deliver(("t", 500, 30, "B"))
    go(patience=100)
    assert values(bracket_rows(spark, folder).filter("status = 'unclosed'"), *columns) == [("v", 20, None, 1, None, "unclosed")]
    assert values(open_brackets(spark, folder, 3), "thread", "item") == [("t", 30)]


def test_triggers_give_what_one_batch_gives(spark):
    """Random events of a hot thread and others, cut into triggers at any place."""
    rng = random.Random(12)
    events = [("hot" if rng.random() < 0.7 else rng.choice("xyz"), i, i, rng.choice("BBE" if i < 200 else "BEE")) for i in range(400)]
    schema = "thread string, position bigint, item bigint, phase string"
    empty = lambda kind: spark.createDataFrame([], kind)
    whole, left, _ = pair_trigger(spark.createDataFrame(events, schema), empty("thread string, position bigint, item bigint"), empty("thread string, last bigint"))
    open_, seen, got = empty("thread string, position bigint, item bigint"), empty("thread string, last bigint"), []
    for a, b in ((0, 90), (90, 230), (230, 400)):
        rows, open_, seen = pair_trigger(spark.createDataFrame(events[a:b], schema), open_, seen)
        got += [tuple(r) for r in rows.collect()]
    assert sorted(got, key=repr) == values(whole, *whole.columns) and values(open_, "item") == values(left, "item")


def test_last_before_crosses_blocks(spark):
    rows = spark.range(500).select(F.lit("hot").alias("k"), F.col("id").alias("at"), (F.col("id") % 100 == 0).alias("d"))
    seen = S.last_before(rows, ["k"], ["at"], F.col("d"), F.col("at"))
    assert seen.filter(F.col("reaching") != F.floor(F.col("at") / 100) * 100).count() == 0 and seen.count() == 500


def test_owner_edge_cases(spark):
    items = spark.createDataFrame([("a/b/c.ts",), ("ab/c.ts",), ("c.ts",)], "path string")
    owners = spark.createDataFrame([("a", "A", 1), ("a/b", "B", 1), ("a/b", "B2", 2), (".", "root", 1)], "owner_path string, owner string, rank int")
    assert values(O.nearest_owner(items, owners, prefer=F.col("rank")), "path", "owner") == [("a/b/c.ts", "B2"), ("ab/c.ts", "root"), ("c.ts", "root")]
    assert values(O.common_ancestor(spark.createDataFrame([("g", "a/bc/x"), ("g", "a/bd/x"), ("h", "a"), ("i", "x/y"), ("i", "z")], "group string, path string"))) == [("g", "a"), ("h", "a"), ("i", ".")]


def test_routes_need_exactly_one(spark):
    endpoints = spark.createDataFrame([("e1", "/u/:id", "GET"), ("e2", "/u/:name", "ANY"), ("e3", "/p/", "POST")], "id string, address string, method string")
    requests = spark.createDataFrame([("r1", "https://h/u/${x}", "GET"), ("r2", "/u/:q", "PUT"), ("r3", "/p?x=1", "POST"), ("r4", "/p", "GET")], "id string, address string, method string")
    assert values(L.match_routes(requests, endpoints), "id", "endpoint_id", "match") == [("r1", None, "ambiguous"), ("r2", "e2", "matched"), ("r3", "e3", "matched"), ("r4", None, "unmatched")]


def test_entity_search_ranks_and_sections(spark):
    rows = spark.createDataFrame([("1", "Order list", "src\\orders.ts", "shop", "total"), ("2", "Order", "x.ts", "shop", ""), ("3", "Orders page", "y.ts", "web", ""), ("4", "List of order", "z.ts", "", "")], "id string, label string, p string, g string, f string")
    entities = rows.withColumn("document", SE.search_document([F.col("label")], [F.col("p")], [F.col("g")], [F.col("f")]))
    assert values(SE.entity_search(entities, " order "), "id", "rank") == [("1", 1), ("2", 0), ("3", 1), ("4", 2)]
    assert values(SE.entity_search(entities, "ORDERS.ts SHOP"), "id", "rank") == [("1", 3)]
    assert SE.entity_search(entities, "  ").count() == 0
    hit = SE.explaining_fields(SE.entity_search(entities, "order total"), "order total").first()
    assert hit["id"] == "1" and hit["matching_fields"] == ["total"]
    assert [r["id"] for r in SE.ranked(SE.entity_search(entities, "order"), path="p").collect()] == ["2", "1", "3", "4"]


def test_command_closure_order_cycle_and_needs(spark):
    fragments = spark.createDataFrame(
        [("dev", 0, "run a", "a"), ("dev", 1, "run b", "b"), ("a", 0, "run b", "b"), ("b", 0, "tsc", None), ("b", 1, "run dev", "dev"), ("pre", 0, "x", None)], "script_id string, seq int, text string, target string"
    )
    needs = spark.createDataFrame([("a", "pre")], "script_id string, needs string")
    entries = spark.createDataFrame([("dev",)], "script_id string")
    scripts, placed, cycles = CG.command_closure(entries, fragments, needs)
    got = {r["script_id"]: (r["rank"], r["branch"]) for r in scripts.collect()}
    # b is reached through a first, as in reading order; prerequisites come one rank before their script.
    assert got == {"dev": (1, "root"), "a": (3, "root.1"), "b": (5, "root.1.1"), "pre": (2, "root.1")}
    assert values(cycles, "script_id", "target") == [("b", "dev")] and placed.count() == 6


ND = "id string, kind string, parent_id string, environments array<string>, auxiliary boolean, purpose string, logical_owner string, tool string, request_owner string, definition_owner string, has_entry boolean"
ED = "id string, src string, dst string, kind string, environment string, confidence string"


def small_model(spark):
    n = lambda id_, kind, parent=None, purpose=None, owner=None, **k: (id_, kind, parent, k.get("env", []), k.get("aux", False), purpose, owner, k.get("tool"), k.get("req"), k.get("defn"), False)
    nodes = [
        n("app", "application"), n("comp", "component", "app"), n("build", "tool-operation", "app", "build", tool="vite"), n("deploy", "tool-operation", "app", "deploy", tool="wr"), n("dist", "artifact"), n("run", "execution-config", None, None, "app"),
        n("scr", "tool-operation", "app", "script", defn="app"), n("req", "unresolved", None, None, None, req="app"), n("tests", "code-package", aux=True), n("lone", "artifact"), n("dev", "tool-operation", "app", "serve", tool="vite", env=["dev"]),
    ]
    edges = [
        ("1", "build", "dist", "flow-generates"), ("2", "dist", "deploy", "flow-input"), ("3", "deploy", "run", "flow-deploys"), ("4", "scr", "build", "flow-invokes"), ("5", "app", "run", "flow-definition"), ("6", "dev", "run", "flow-starts"), ("7", "comp", "app", "calls"),
    ]
    return spark.createDataFrame(nodes, ND), spark.createDataFrame([(*e, "", "source") for e in edges], ED)


def test_content_range_crosses_only_artifacts(spark):
    nodes, edges = small_model(spark)
    roles, ids = A.content_range(nodes, edges, path="publish")
    # The configuration's other starter is an input/output edge of an operation outside the range: it stays out.
    assert dict(values(roles, "id", "role")) == {"build": "core", "deploy": "core", "dist": "peer", "run": "peer", "scr": "peer", "app": "support"}
    assert values(ids, "id") == [("1",), ("2",), ("3",), ("4",), ("5",)]


def test_simple_overview_units(spark):
    nodes, edges = small_model(spark)
    units, relations = A.simple_overview(nodes, edges)
    got = {r["id"]: r["rule"] for r in units.collect()}
    assert got == {
        "app": "entity", "comp": "inside", "run": "inside", "build": "usage", "deploy": "usage", "dev": "usage", "dist": "folded", "scr": "script", "req": "request", "tests": "auxiliary", "lone": "unassigned",
    }
    owner = dict(values(units, "id", "unit"))
    assert owner["dist"] == owner["build"] == owner["scr"] and owner["req"] == owner["app"] == owner["run"]
    assert relations.agg(F.sum("n")).first()[0] == edges.count()
    assert values(A.folded_paths(units, edges), "producer", "artifact", "consumer") == [("build", "dist", "deploy")]


def test_auxiliary_owners_keep_what_is_theirs(spark):
    nodes, edges = small_model(spark)
    n = lambda id_, kind, owner=None, defn=None: (id_, kind, None, [], False, "serve" if kind == "tool-operation" else None, owner, "vite", None, defn, False)
    more = [n("mine", "artifact", "tests"), n("run2", "execution-config", "tests"), n("run3", "execution-config", "tests"), n("op1", "tool-operation", None, "tests"), n("op2", "tool-operation", None, "app")]
    nodes = nodes.unionByName(spark.createDataFrame(more, ND))
    edges = edges.unionByName(spark.createDataFrame([("8", "op1", "run2", "flow-starts", "", "source"), ("9", "op2", "run3", "flow-starts", "", "source")], ED))
    groups = spark.createDataFrame([("run2", "g"), ("run3", "g")], "id string, group_id string")
    units, _ = A.simple_overview(nodes, edges, groups)
    owner = {id_: (unit, rule) for id_, unit, rule in values(units, "id", "unit", "rule")}
    home = owner["tests"][0]
    assert [owner[id_] for id_ in ("mine", "run2", "op1")] == [(home, "inside")] * 3
    # Another operation starts this one, so it is told apart from its owner.
    assert owner["run3"][1] == "group" and owner["op2"][1] == "usage" and units.count() == nodes.count()


def test_folded_artifacts_hand_on_by_a_path(spark):
    nodes, edges = small_model(spark)
    units, relations = A.simple_overview(nodes, edges)
    owner = dict(values(units, "id", "unit"))
    between = values(relations.filter("not internal"), "src", "dst", "kind", "n")
    assert (owner["build"], owner["deploy"], "artifact-path", 1) in between and not any(kind == "flow-input" for *_, kind, _ in between)


def test_usages_with_equal_targets_purpose_and_context_are_one_unit(spark):
    """Partition of the operations of random models against the definition, with targets multiplied out."""
    import random

    draw = random.Random(11)
    purposes = ["generate", "generate", "apply", "build", "serve"]
    op = lambda i: (f"o{i}", "tool-operation", None, [], False, purposes[i % 5], None, draw.choice("vw"), None, None, False)
    plain = lambda id_, kind, owner=None: (id_, kind, None, [], False, None, owner, None, None, None, False)
    nodes = [op(i) for i in range(60)] + [plain(f"a{i}", "artifact") for i in range(4)] + [plain(f"r{i}", "resource") for i in range(3)] + [plain(f"c{i}", "execution-config", f"a{i}") for i in range(2)]
    rows = set()
    for i in range(60):
        for _ in range(draw.randint(0, 2)):
            kind = draw.choice(["flow-generates", "flow-generates", "flow-applies", "flow-input", "flow-input", "flow-starts"])
            other = draw.choice({"flow-generates": ["a0", "a1", "a2"], "flow-applies": ["r0", "r1", "c0"], "flow-input": ["a0", "a1", "c0", "c1"], "flow-starts": ["c0", "r2"]}[kind])
            rows.add((other, f"o{i}", kind) if kind == "flow-input" else (f"o{i}", other, kind))
    nodes = spark.createDataFrame(nodes, ND)
    edges = spark.createDataFrame([(f"e{i}", *row, "", "source") for i, row in enumerate(sorted(rows))], ED)
    targets = {}
    for id_, target in values(A.usage_targets(nodes, edges), "id", "target"):
        targets.setdefault(id_, set()).add(target)
    want = {}
    for id_, tool, purpose, context, resolved in values(A.usage_index(nodes, edges), "id", "tool", "purpose", "context", "resolved"):
        want.setdefault((tool, purpose, context, frozenset(targets.get(id_, ()))) if resolved else id_, set()).add(id_)
    got = {}
    for id_, unit in values(A.simple_overview(nodes, edges)[0].filter("rule = 'usage'"), "id", "unit"):
        got.setdefault(unit, set()).add(id_)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and max(map(len, got.values())) > 1
    assert all(unit.split(":", 2)[2] == min(members) for unit, members in got.items())


def test_the_overview_query_has_groups_and_relations(spark):
    from bindings import QUERIES
    from bindings import model as M
    from bindings.registry import Tables

    folder = "/root/testdata/sf0.001"
    got = QUERIES["simple_overview"](spark, folder)
    tables = Tables(spark, folder)
    nodes, edges = M.model_nodes(tables), M.model_edges(tables)
    units, _ = A.simple_overview(nodes, edges, M.structural_categories(tables).select("id", "group_id"))
    owner = {id_: (unit, rule) for id_, unit, rule in values(units, "id", "unit", "rule")}
    assert values(got.filter("rule is not null"), "rule", "entities", "units") == sorted(
        ((rule, sum(r == rule for _, r in owner.values()), len({u for u, r in owner.values() if r == rule})) for rule in {r for _, r in owner.values()}), key=repr
    )
    assert "group" in {rule for _, rule in owner.values()}
    counted = {}
    for src, dst, kind, confidence in values(edges, "src", "dst", "kind", "confidence"):
        if src in owner and dst in owner:
            (a, rule), (b, _) = owner[src], owner[dst]
            kind = "reference" if kind in A.REFERENCE_KINDS else "artifact-path" if kind == "flow-input" and rule == "folded" and a != b else kind
            seen = counted.setdefault(kind, [0, set(), 0])
            seen[0] += 1
            seen[1] |= {(a, b, confidence)} if a != b else set()
            seen[2] += a == b
    assert values(got.filter("kind is not null"), "kind", "edges", "relations", "internal") == sorted(((kind, n, len(pairs), inside) for kind, (n, pairs, inside) in counted.items()), key=repr)


def test_usage_context_is_order_free(spark):
    nodes = spark.createDataFrame([("o1", "tool-operation", None, [], False, "build", None, "v", None, None, False), ("o2", "tool-operation", None, [], False, "build", None, "v", None, None, False), ("o3", "tool-operation", None, [], False, "build", None, "v", None, None, False), ("x", "artifact", None, [], False, None, None, None, None, None, False), ("y", "artifact", None, [], False, None, None, None, None, None, False)], ND)
    edges = spark.createDataFrame([("1", "o1", "x", "flow-generates", "", "s"), ("2", "o1", "y", "flow-generates", "", "s"), ("3", "o2", "y", "flow-generates", "", "s"), ("4", "o2", "x", "flow-generates", "", "s"), ("5", "o3", "x", "flow-generates", "", "s")], ED)
    context = dict(values(A.usage_index(nodes, edges), "id", "context"))
    assert context["o1"] == context["o2"] != context["o3"]


def test_declarations_join_usage_scopes(spark):
    fact = spark.createDataFrame([("f", "technology", "vite", False, e) for e in ("u1", "u2", "d0", "d1")] + [("g", "technology", "jest", False, "d2")], "fact_id string, fact_kind string, stack_id string, explicit boolean, evidence_id string")
    evidence = spark.createDataFrame(
        [("u1", "a/x.ts", "usage", "source-import"), ("u2", "b/x.ts", "usage", "source-import"), ("d0", "package.json", None, "package-dependency"), ("d1", "a/package.json", None, "package-dependency"), ("d2", "package.json", None, "package-dependency")],
        "evidence_id string, path string, role string, detector_id string",
    )
    scopes = spark.createDataFrame([(".", "root"), ("a", "A"), ("b", "B")], "owner_path string, owner string")
    got = values(V.attribute_usage(fact, evidence, scopes), "fact_id", "scope", "evidence_id")
    assert got == [("f", "A", "d0"), ("f", "A", "d1"), ("f", "A", "u1"), ("f", "B", "d0"), ("f", "B", "u2"), ("g", "root", "d2")]


def test_workspace_without_config_warns(spark):
    facts = spark.createDataFrame([("project:root", "project", False), ("p", "workspace-package", True)], "id string, kind string, is_root boolean")
    relations = spark.createDataFrame([("r", "project:root", "p", "contains")], "id string, src string, dst string, kind string")
    _, edges, warnings = V.workspace_view(facts, relations)
    assert values(edges, "id") == [("r",)] and values(warnings, "id") == [("workspace:no-config",)]


def test_dictionary_report(spark):
    categories = spark.createDataFrame([("web", None, []), ("Bad Id", "web", ["nope"]), ("c1", "c2", []), ("c2", "c1", []), ("web", None, [])], "id string, parent_id string, related_ids array<string>")
    stacks = spark.createDataFrame(
        [("vite", "web", ["v"], ["vite"], ["gone"], [("missing", "related-to", "x")]), ("vitest", "none", ["V "], ["Vite"], [], [])],
        "id string, category_id string, aliases array<string>, package_names array<string>, related_ids array<string>, relationships array<struct<target_id:string,kind:string,label:string>>",
    )
    placed = spark.createDataFrame([("category", "web", None), ("stack", "vite", "c1"), ("stack", "ghost", "web")], "kind string, ref string, parent_ref string")
    rules = {(r["rule"], r["id"]) for r in Q.validate_dictionary(categories, stacks, placed).collect()}
    assert {
        ("duplicate-category", "web"), ("bad-category-id", "Bad Id"), ("missing-related-category", "Bad Id"), ("missing-category", "vitest"), ("missing-related-stack", "vite"), ("missing-relationship-target", "vite"), ("package-owned-twice", "vite"),
        ("alias-owned-twice", "v"), ("parent-cycle", "c1"), ("parent-cycle", "c2"), ("unknown-map-stack", "ghost"), ("category-not-in-map", "c1"), ("stack-not-in-map", "vitest"), ("map-stack-parent", "vite"),
    } <= rules


def test_plans_of_a_range_do_not_grow(spark, monkeypatch):
    """A chain of forty operations takes forty rounds; the stored rounds stay few."""
    from corpusloom.operators import architecture as A
    from corpusloom.plans import Grown

    most = []
    close = Grown.close_round
    monkeypatch.setattr(Grown, "close_round", lambda self: (close(self), most.append(len(self.parts)))[0])
    n = 24
    blank = F.lit(None).cast("string")
    nodes = spark.range(n).select(F.concat(F.lit("o"), "id").alias("id"), F.lit("tool-operation").alias("kind"), blank.alias("parent_id"), F.array().cast("array<string>").alias("environments"), F.lit(False).alias("auxiliary"), F.when(F.col("id") == n - 1, "start").otherwise("script").alias("purpose"), blank.alias("logical_owner"), blank.alias("tool"), F.lit(False).alias("library"))
    edges = spark.range(1, n).select(F.concat(F.lit("e"), "id").alias("id"), F.concat(F.lit("o"), F.col("id") - 1).alias("src"), F.concat(F.lit("o"), "id").alias("dst"), F.lit("flow-invokes").alias("kind"), F.lit("").alias("environment"), F.lit("source").alias("confidence"))
    found, kept = A.content_range(nodes, edges, path="start")
    assert found.count() == n and kept.count() == n - 1 and max(most) < 8 <= len(most)
