import random

import pytest
from pyspark.sql import functions as F

from conftest import values
from corpusloom.operators import bundles as B
from corpusloom.operators import compress as C
from corpusloom.operators import filters as FL
from corpusloom.operators import scc as K
from corpusloom.operators import traverse as T
from corpusloom.operators import tree as R


def frame(spark, pairs):
    return spark.createDataFrame([(f"{a}>{b}", a, b, "calls", "source") for a, b in pairs], "id string, src string, dst string, kind string, confidence string")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


PAIRS = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "y")]


def test_bfs_and_khop(spark):
    edges = frame(spark, PAIRS)
    nodes = ids(spark, *"abcdexy")
    assert values(T.bfs_depths(nodes, edges, ids(spark, "a")), "id", "depth") == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)]
    assert T.bfs_depths(nodes, edges, ids(spark, "zz")).count() == 0
    assert values(T.neighbours(edges, ids(spark, "a"), 1, "incoming"), "id") == [("a",), ("c",)]
    assert values(T.khop_relations(edges, ids(spark, "c"), 1, "outgoing"), "id") == [("c>a",), ("c>d",)]
    assert values(T.signed_hops(edges, ids(spark, "a")), "id", "hop") == [("a", 0), ("b", 1), ("c", -1), ("d", 3), ("e", 4)]


def test_emphasis_needs_four_neighbours(spark):
    star = frame(spark, [("h", "a"), ("h", "b"), ("h", "c"), ("d", "h"), ("a", "e"), ("e", "f")])
    nodes = ids(spark, *"habcdef")
    got = dict(values(T.edge_emphasis(nodes, star, ids(spark, "h")), "id", "emphasis"))
    assert got["h>a"] == "primary" and got["a>e"] == "secondary" and got["e>f"] == "deep"
    assert {v for _, v in values(T.edge_emphasis(nodes, star, ids(spark, "a")), "id", "emphasis")} == {None}


def reachable(pairs, start):
    seen, queue = set(), [start]
    while queue:
        here = queue.pop()
        for a, b in pairs:
            if a == here and b not in seen:
                seen.add(b)
                queue.append(b)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_depths_match_brute_force(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(24)]
    pairs = list({(rng.choice(names), rng.choice(names)) for _ in range(34)})
    pairs = [(a, b) for a, b in pairs if a != b]
    reach = {n: reachable(pairs, n) for n in names}
    want = {n: max([m for m in names if m == n or (m in reach[n] and n in reach[m])]) for n in names}
    got = {r["id"]: r for r in K.scc_depths(ids(spark, *names), frame(spark, pairs)).collect()}
    assert {n: got[n]["component"] for n in names} == want
    links = {(want[a], want[b]) for a, b in pairs if want[a] != want[b]}

    def depth(component):
        return max([depth(a) + 1 for a, b in links if b == component], default=0)

    assert {n: got[n]["depth"] for n in names} == {n: depth(want[n]) for n in names}


def brute_paths(pairs, kept):
    """Collapsed paths by walking, as the meaning of the operator."""
    ahead = set(kept) | {n for k in kept for n in reachable(pairs, k)}
    back = set(kept) | {n for k in kept for n in reachable([(b, a) for a, b in pairs], k)}
    relevant = ahead & back
    inner = [(a, b) for a, b in pairs if a in relevant and b in relevant]
    junction = {n for n in relevant - set(kept) if sum(b == n for _, b in inner) > 1 or sum(a == n for a, _ in inner) > 1}
    stops = set(kept) | junction
    out = set()
    for a, b in inner:
        if a in stops:
            hops, here = 1, b
            while here not in stops:
                here = next(d for s, d in inner if s == here)
                hops += 1
            out.add((a, here, hops))
    return out, junction


@pytest.mark.parametrize("seed", [3, 4])
def test_path_compression_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(20)]
    pairs = list({(rng.choice(names), rng.choice(names)) for _ in range(26)})
    pairs = [(a, b) for a, b in pairs if a != b]
    kept = names[:4]
    junctions, relations, provenance = C.compress_paths(frame(spark, pairs), ids(spark, *kept))
    want, stops = brute_paths(pairs, kept)
    assert {(r["src"], r["dst"], r["hops"]) for r in relations.collect()} == want
    assert {r["id"] for r in junctions.collect()} == stops
    assert provenance.count() == provenance.select("id").distinct().count() == sum(h for _, _, h in want)


def test_path_compression_confidence_and_callback(spark):
    edges = spark.createDataFrame(
        [("1", "in", "h", "calls", "source"), ("2", "h", "g", "callback", "inferred"), ("3", "g", "out", "calls", "source"), ("4", "in", "dead", "calls", "source")],
        "id string, src string, dst string, kind string, confidence string",
    )
    _, relations, _ = C.compress_paths(edges, ids(spark, "in", "out"))
    assert values(relations, "src", "dst", "hops", "kind", "confidence", "has_callback") == [("in", "out", 3, "processing-path", "inferred", True)]


def test_runtime_kept(spark):
    nodes = spark.createDataFrame([("a", "entry", False), ("b", "function", True), ("c", "function", False), ("d", "function", False)], "id string, kind string, entry boolean")
    edges = spark.createDataFrame([("1", "c", "d", "http", "source"), ("2", "a", "c", "calls", "source")], "id string, src string, dst string, kind string, confidence string")
    assert values(C.runtime_kept(nodes, edges)) == [("a",), ("b",), ("c",), ("d",)]


def test_trees_and_cycles(spark):
    parents = spark.createDataFrame([("r", None), ("a", "r"), ("b", "a"), ("x", "y"), ("y", "x"), ("z", "x"), ("q", "gone")], "id string, parent_id string")
    got = {r["id"]: (r["root"], r["depth"], r["cyclic"]) for r in R.roots(parents).collect()}
    assert got == {"r": ("r", 0, False), "a": ("r", 1, False), "b": ("r", 2, False), "x": (None, None, True), "y": (None, None, True), "z": (None, None, True), "q": ("q", 0, False)}
    closure = R.ancestors(parents)
    assert ("b", "r", 2) in values(closure, "id", "ancestor", "distance")
    assert [v for v in values(closure, "id", "ancestor", "distance") if v[0] == "z"] == [("z", "x", 1), ("z", "y", 2), ("z", "z", 0)]
    assert dict(values(R.tree_paths(closure.filter("id in ('r', 'a', 'b')")), "id", "path"))["b"] == "r/a/b"


def test_bundle_passthrough_and_unowned(spark):
    edges = frame(spark, [("a", "b"), ("a", "b"), ("a", "c"), ("b", "zz")]).withColumn("id", F.concat("id", F.monotonically_increasing_id().cast("string")))
    owners = spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "G"), ("d", "G")], "id string, owner string")
    got = values(B.bundle_relations(edges, owners), "src_owner", "dst_owner", "n", "aggregated", "internal")
    assert got == [("a", "G", 1, True, False), ("a", "b", 1, False, False), ("a", "b", 1, False, False)]
    members = B.bundle_members(edges, owners)
    assert members.count() == 3


def test_lift_edges_uses_nearest_visible(spark):
    parents = spark.createDataFrame([("R", None), ("P", "R"), ("a", "P"), ("b", "P"), ("c", "R")], "id string, parent_id string")
    edges = frame(spark, [("a", "b"), ("a", "c"), ("b", "c")])
    lifted = B.lift_edges(edges, R.ancestors(parents), ids(spark, "P", "c"))
    assert values(lifted, "src", "dst", "n") == [("P", "c", 2)]


def test_layers_and_views(spark):
    nodes = spark.createDataFrame([("f", "function", "source"), ("s", "span", "observed"), ("v", "value", "observed")], "id string, kind string, confidence string")
    edges = spark.createDataFrame([("1", "s", "f", "observed-at", ["runtime-flow"]), ("2", "v", "s", "observed-data", ["data-flow"])], "id string, src string, dst string, kind string, views array<string>")
    source = (nodes.filter("id = 'f'"), edges.limit(0))
    seen = (nodes.filter("id <> 'f'"), edges)
    shown, links = FL.apply_layer(source, seen, "combined", "runtime-flow")
    assert values(shown, "id") == [("f",), ("s",)] and values(links, "id") == [("1",)]
    shown, links = FL.apply_layer(source, seen, "observed", "runtime-flow")
    assert values(shown, "id") == [("s",)] and links.count() == 0
    shown, links = FL.apply_layer(source, seen, "observed", "data-flow")
    assert values(shown, "id") == [("s",), ("v",)] and values(links, "id") == [("2",)]


def test_selected_edge_comes_last(spark):
    edges = frame(spark, PAIRS)
    got = FL.foreground_edges(edges, edge="c>d", node="a").orderBy("layer", "id").select("id").collect()
    assert [r[0] for r in got] == ["a>b", "c>a", "c>d"]
    assert values(B.edge_end_roles(edges, "c>d")) == [("c", "source"), ("d", "target")]
