"""Graph queries over all followers, against brute force on a small table with a hub."""

import random
from collections import defaultdict
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from bindings import code, graphs
from conftest import values
from corpusloom.operators import chains, scc
from corpusloom.operators import imports as IM
from corpusloom.operators import scc as K
from corpusloom.operators import traverse as T
from corpusloom.operators import tree as R


def lines():
    rng, out = random.Random(4), []
    for order in range(14):
        # Part 1 is followed by another part on every order; later parts lead upwards only now and then.
        parts = [1, 2 + order, *sorted(rng.sample(range(2, 30), 2)), *([1] if order % 5 == 0 else [])]
        out += [(order, i + 1, part, rng.randint(1, 3)) for i, part in enumerate(parts)]
    return out


@pytest.fixture(scope="module")
def tables(spark):
    part = [(k, f"Brand#{k % 4}", k % 12) for k in range(1, 31)]
    return SimpleNamespace(
        lineitem=spark.createDataFrame(lines(), "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long"),
        part=spark.createDataFrame(part, "p_partkey long, p_brand string, p_size int"),
    )


def pairs():
    at = {(order, n): part for order, n, part, _ in lines()}
    return {(part, at[order, n + 1]) for (order, n), part in at.items() if (order, n + 1) in at and at[order, n + 1] != part}


def depths(edges, start):
    ahead = defaultdict(set)
    for a, b in edges:
        ahead[a].add(b)
    found, front = {start: 0}, [start]
    while front:
        front = [b for b in {b for a in front for b in ahead[a]} if b not in found and not found.update({b: found[front[0]] + 1})]
    return found


def test_all_followers(tables):
    assert values(graphs.followers(tables), "src", "dst") == sorted(pairs(), key=repr)
    assert len([1 for a, _ in pairs() if a == 1]) > 2


def test_searches(tables):
    e = pairs()
    back = {(b, a) for a, b in e}
    start, both = min(a for a, _ in e), e | back
    assert values(graphs.bfs_depths(tables), "id", "depth") == sorted(depths(both, start).items(), key=repr)
    out, into = depths(e, start), depths(back, start)
    assert values(graphs.khop_nodes(tables), "id", "depth") == sorted(((n, d) for n, d in out.items() if d <= 3), key=repr)
    near = {n for n, d in depths(both, start).items() if d < 2}
    assert values(graphs.khop_relations(tables), "src", "dst") == sorted(((a, b) for a, b in e if a in near or b in near), key=repr)
    hops = {n: -into[n] if n in into and (n not in out or into[n] <= out[n]) else out[n] for n in {*out, *into}}
    assert values(graphs.signed_hops(tables), "id", "hop") == sorted(hops.items(), key=repr)


def test_emphasis(tables):
    e = pairs()
    degree = defaultdict(int)
    for pair in e:
        for n in pair:
            degree[n] += 1
    far = depths(e | {(b, a) for a, b in e}, max(degree, key=lambda n: (degree[n], -n)))
    name = lambda a, b: None if a not in far or b not in far else ("primary", "primary", "secondary", "deep")[min(3, max(far[a], far[b]))]
    assert values(graphs.edge_emphasis(tables), "src", "dst", "emphasis") == sorted(((a, b, name(a, b)) for a, b in e), key=repr)


def test_components_and_depths(tables):
    e = pairs()
    nodes = {n for pair in e for n in pair}
    reach = {n: set(depths(e, n)) for n in nodes}
    component = {n: max(m for m in reach[n] if n in reach[m]) for n in nodes}
    assert values(graphs.scc_components(tables), "id", "component") == sorted(component.items(), key=repr)
    above = {(component[a], component[b]) for a, b in e if component[a] != component[b]}
    longest = lambda n, edges: max((longest(a, edges) + 1 for a, b in edges if b == n), default=0)
    assert values(graphs.scc_depths(tables), "id", "component", "depth") == sorted(((n, k, longest(k, above)) for n, k in component.items()), key=repr)
    upward = {(min(p, 20 * k), max(p, 20 * k)) for _, _, p, k in lines() if p != 20 * k}
    assert values(graphs.longest_depths(tables), "id", "depth") == sorted(((n, longest(n, upward)) for n in {n for pair in upward for n in pair}), key=repr)


def test_paths(tables):
    e, kept = pairs(), set(range(3, 31, 4))
    back = {(b, a) for a, b in e}
    ahead, behind = {m for n in kept for m in depths(e, n)}, {m for n in kept for m in depths(back, n)}
    inner = {(a, b) for a, b in e if {a, b} <= ahead & behind}
    row = graphs.path_provenance(tables).first()
    assert (row.edges, row.starts) == (len(inner), len({a for a, _ in inner}))
    junctions = {}
    for n in {n for pair in inner for n in pair} - kept:
        i, o = sum(b == n for _, b in inner), sum(a == n for a, _ in inner)
        if i > 1 or o > 1:
            junctions[n] = "branch and merge" if i > 1 and o > 1 else "merge" if i > 1 else "branch"
    assert values(graphs.path_junctions(tables), "id", "junction") == sorted(junctions.items(), key=repr)
    stops, wanted = kept | set(junctions), []
    weak, callback = (lambda n: n % 12 % 11 == 0), (lambda n: n % 12 % 7 == 0)
    for a, b in inner:
        if a in stops:
            way = [a]
            while b not in stops:
                way.append(b)
                b = next(d for s, d in inner if s == b)
            kind = "processing-path" if len(way) > 1 else "callback" if callback(a) else "calls"
            wanted.append((a, b, len(way), kind, "inferred" if any(map(weak, way)) else "source", any(map(callback, way))))
    assert values(graphs.compress_paths(tables), "src", "dst", "hops", "kind", "confidence", "has_callback") == sorted(wanted, key=repr)


def test_header_languages(tables):
    brand = lambda n: f"Brand#{n % 4}"
    near, found = {(a, b) for a, b in pairs() if brand(a) == brand(b)}, defaultdict(set)
    for a in {a for a, _ in pairs() if a % 10 < 4}:
        for n in depths(near, a):
            found[n].add("c" if a % 2 == 0 or brand(a) < "Brand#3" else "cpp")
    wanted = sorted(((f"h/{brand(n)}/p{n}.h", *k) for n, k in found.items() if len(k) == 1), key=repr)
    assert wanted and values(code.header_languages(tables), "path", "language") == wanted


def test_reexports(spark, tables):
    e = pairs()
    on = {(a, b) for a, b in e if a % 3}
    assert values(code.reexport_reach(tables), "path", "specifier", "targets") == sorted(((a, str(b), len(depths(on, b))) for a, b in e), key=repr)
    # Two targets of one specifier, two projects with the same files, and files that re-export each other.
    rows = [("p", "a", "x", "b", True), ("p", "a", "x", "c", True), ("p", "b", "y", "c", True), ("p", "c", "z", "b", True), ("p", "c", "w", "d", False), ("q", "a", "x", "b", True)]
    found = IM.reexport_reach(spark.createDataFrame(rows, "project_id string, path string, specifier string, target string, reexport boolean"), ["project_id"])
    wanted = [("p", "a", "x", "b"), ("p", "a", "x", "c"), ("p", "b", "y", "b"), ("p", "b", "y", "c"), ("p", "c", "w", "d"), ("p", "c", "z", "b"), ("p", "c", "z", "c"), ("q", "a", "x", "b")]
    assert values(IM.reexport_targets(found, found.links, ["project_id"]), "project_id", "path", "specifier", "target") == wanted
    assert values(IM.reexport_counts(found, ["project_id"]), "project_id", "path", "specifier", "targets") == [("p", "a", "x", 2), ("p", "b", "y", 2), ("p", "c", "w", 1), ("p", "c", "z", 2), ("q", "a", "x", 1)]


def edge_table(spark, listed):
    return spark.createDataFrame(sorted(set(listed)), "src long, dst long")


@pytest.mark.parametrize("seed", range(3))
def test_chains_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    listed = {(rng.randrange(12), rng.randrange(12)) for _ in range(13)}
    at = 100
    for _ in range(8):  # chains between junctions, back to the same one, to nowhere, and closed rings
        n, kind = rng.randint(1, 9), rng.randrange(4)
        run = list(range(at, at + n))
        at += n
        listed |= set(zip(run, run[1:]))
        if kind == 0:
            listed.add((run[-1], run[0]))
        else:
            listed.add((rng.randrange(12), run[0]))
            if kind > 1:
                listed.add((run[-1], rng.randrange(12)))
    nodes = {n for pair in listed for n in pair} | {999}
    reach = {n: set(depths(listed, n)) for n in nodes}
    component = {n: max(m for m in reach[n] if n in reach[m]) for n in nodes}
    everyone = spark.createDataFrame([(n,) for n in sorted(nodes)], "id long")
    assert values(K.strong_components(everyone, edge_table(spark, listed)), "id", "component") == sorted(component.items(), key=repr)
    above = {(component[a], component[b]) for a, b in listed if component[a] != component[b]}
    longest = lambda n: max((longest(a) + 1 for a, b in above if b == n), default=0)
    assert values(K.scc_depths(everyone, edge_table(spark, listed)), "id", "component", "depth") == sorted(((n, k, longest(k)) for n, k in component.items()), key=repr)


def test_long_paths_take_few_rounds(spark, monkeypatch):
    n, jobs = 100_000, []
    for module, name in ((chains, "rewritten"), (scc, "rewritten"), (scc, "cut_lineage")):
        monkeypatch.setattr(module, name, lambda df, cut=getattr(module, name): jobs.append(1) or cut(df))
    path = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    depth = K.longest_depths(path)
    assert depth.filter("depth = id").count() == n + 1 and len(jobs) < 40
    jobs.clear()
    ring = path.unionByName(spark.createDataFrame([(n // 2, 10), (n, n + 1)], "src long, dst long"))
    found = K.strong_components(ring.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), ring)
    sizes = found.groupBy("component").count().orderBy(F.desc("count")).limit(2).collect()
    assert [tuple(r) for r in sizes][0] == (n // 2, n // 2 - 9) and sizes[1][1] == 1 and len(jobs) < 60


def test_totals_of_trees(spark):
    # A long chain, bushes on it, two rings with tails, and parents outside the table.
    n = 100_000
    chain = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    weights = spark.range(n).select("id", (F.col("id") % 3).alias("weight"))
    got = R.subtree_totals(chain, weights)
    assert got.filter("id = 0").first().total == sum(i % 3 for i in range(n)) and got.filter(f"id = {n - 5}").first().total == sum(i % 3 for i in range(n - 5, n)) and got.count() == n
    rows = [(1, 2), (2, 3), (3, 1), (4, 3), (5, 4), (6, 5), (7, 7), (8, 7), (9, 10), (10, 9), (11, 99), (12, 11), (13, None)]
    parents, below = spark.createDataFrame(rows, "id long, parent_id long"), defaultdict(set)
    up = {a: b for a, b in rows if a != b}
    for a, _ in rows:
        while a is not None and a in dict(rows) and a not in below[None]:
            below[None].add(a)
            a = up.get(a)
        for seen in below.pop(None):
            below[seen].add(rows[len(below[0])][0])
        below[0].add(len(below[0]))
    below.pop(0)
    got = R.subtree_totals(parents, parents.select("id", F.lit(1).alias("weight")))
    assert values(got, "id", "total") == sorted(((a, len(members)) for a, members in below.items()), key=repr)
    hot = spark.range(20_000).select(F.col("id").alias("id"), F.when(F.col("id") > 0, F.lit(0)).alias("parent_id"))
    assert R.subtree_totals(hot, hot.select("id", F.lit(2).alias("weight"))).filter("id = 0").first().total == 40_000


def test_a_hub_is_spread_by_its_degree(spark, monkeypatch):
    monkeypatch.setattr(T, "PART_STEPS", 50)
    rng = random.Random(1)
    listed = {(0, n) for n in range(1, 700)} | {(rng.randrange(1, 700), rng.randrange(1, 700)) for _ in range(1300)} | {(n, n + 5000) for n in range(0, 700, 50)}
    edges = edge_table(spark, [pair for pair in listed if pair[0] != pair[1]])
    steps = T.adjacency(edges, "outgoing")
    sizes = steps.rows.filter("`from` = 0").groupBy("part").count().collect()
    assert len(sizes) == 14 and max(r["count"] for r in sizes) < 90 and values(steps.hubs, "from") == [(0,)]
    assert steps.rows.filter("`from` <> 0 and part > 0").isEmpty()
    seed = spark.createDataFrame([(0,)], "id long")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    both = {(a, b) for a, b in listed if a != b}
    assert values(T.bfs_depths(nodes, edges, seed), "id", "depth") == sorted(depths(both | {(b, a) for a, b in both}, 0).items(), key=repr)
    reached = {n: set(depths(both, n)) for n in {n for pair in both for n in pair}}
    assert values(K.strong_components(nodes, edges), "id", "component") == sorted(((n, max(m for m in reached[n] if n in reached[m])) for n in reached), key=repr)


@pytest.mark.parametrize("ends", [60, 10**6])
def test_longest_paths_settle_a_block_a_round(spark, monkeypatch, ends):
    # Edges upwards and, for the other half, between nodes named at random, so that paths leave blocks and come back.
    rng = random.Random(ends)
    listed = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(70)}
    name = {n: n if n < 20 else 1000 - (n * 37) % 97 for n in range(40)}
    listed = {(name[a], name[b]) for a, b in listed}
    depth = {n: 0 for pair in listed for n in pair}
    for _ in depth:
        for a, b in listed:
            depth[b] = max(depth[b], depth[a] + 1)
    monkeypatch.setattr(scc, "BLOCK_ENDS", ends)
    assert values(K.longest_depths(edge_table(spark, listed)), "id", "depth") == sorted(depth.items(), key=repr)


def test_edges_between_far_nodes_do_not_make_blocks_smaller(spark, monkeypatch):
    # 20,000 edges between any two of 1,000 nodes: few lie inside a block, so a block may hold many nodes.
    rng, jobs = random.Random(4), []
    listed = {tuple(sorted(rng.sample(range(1000), 2))) for _ in range(20_000)}
    depth = [0] * 1000
    for a, b in sorted(listed):
        depth[b] = max(depth[b], depth[a] + 1)
    monkeypatch.setattr(scc, "BLOCK_ENDS", 2000)
    monkeypatch.setattr(scc, "cut_lineage", lambda df, cut=scc.cut_lineage: jobs.append(1) or cut(df))
    assert values(K.longest_depths(edge_table(spark, listed)), "id", "depth") == sorted(((n, d) for n, d in enumerate(depth)), key=repr)
    assert len(jobs) < 40


def test_junctions_of_one_block_take_one_round(spark, monkeypatch):
    # A path of 300 junctions: every node also leads two nodes on.
    jobs = []
    for module, name in ((chains, "rewritten"), (scc, "rewritten"), (scc, "cut_lineage")):
        monkeypatch.setattr(module, name, lambda df, cut=getattr(module, name): jobs.append(1) or cut(df))
    found = K.longest_depths(edge_table(spark, {(n, n + k) for n in range(300) for k in (1, 2)}))
    assert found.filter("depth = id or id = 301 and depth = 300").count() == 302 and len(jobs) < 30
