"""Definitions that reach a use, against brute force; aligned blocks of ranges."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import values
from corpusloom.operators import calls as CA
from corpusloom.operators import tree as TR
from corpusloom.plans import dyadic_blocks


def test_blocks_cover_a_range_once(spark):
    ranges = [(a, b) for a in range(0, 20) for b in range(a - 1, 20)] + [(1, 1 << 40), ((1 << 50) - 3, (1 << 50) + 5)]
    rows = spark.createDataFrame(ranges, "a long, b long").select("a", "b", dyadic_blocks(F.col("a"), F.col("b")).alias("f")).collect()
    for a, b, found in rows:
        spans = sorted((x.block << x.level, ((x.block + 1) << x.level) - 1) for x in found)
        if b < a:
            assert not spans
        else:
            assert spans[0][0] == a and spans[-1][1] == b and all(y[0] == x[1] + 1 for x, y in zip(spans, spans[1:])) and len(spans) <= 2 * (b - a + 1).bit_length()


def brute(uses, definitions, parents, parameters):
    out = []
    for use, owner, name, at in uses:
        scope, distance, done = owner, 0, False
        while scope is not None and not done:
            seen = sorted((d for d in definitions if d[1] == scope and d[2] == name and d[3] <= at and d[4] <= at <= d[5]), key=lambda d: -d[3])
            stop = max((d[3] for d in seen if not d[6]), default=None)
            out += [(use, d[0], d[6], distance) for d in seen if stop is None or d[3] >= stop]
            done = stop is not None
            if not done:
                given = [p for p in parameters if p[1] == scope and p[2] == name]
                out += [(use, p[0], False, distance) for p in given]
                done = bool(given)
            scope, distance = parents.get(scope), distance + 1
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    parents = {"f": None, "g": "f", "h": "g", "k": "f"}
    blocks = [(0, 400), (10, 200), (20, 90), (100, 150), (210, 390), (220, 230)]
    definitions = []
    for i in range(150):
        low, high = rng.choice(blocks)
        definitions.append((f"d{i}", rng.choice("fgh"), rng.choice("xxxy"), rng.randint(low, high), low, high, rng.random() < 0.6))
    # A definition at the same place, one that is never visible, and a block that starts behind its definition.
    definitions += [("same", "f", "x", definitions[0][3], 0, 400, True), ("never", "f", "x", 50, 60, 40, False), ("late", "g", "y", 5, 30, 300, False)]
    uses = [(f"u{i}", rng.choice("fghk"), rng.choice("xyz"), rng.randint(0, 420)) for i in range(200)]
    parameters = [("px", "f", "x"), ("pz", "g", "z")]
    scopes = TR.ancestors(spark.createDataFrame(list(parents.items()), "id string, parent_id string"))
    got = CA.reaching_definitions(
        spark.createDataFrame(uses, "use_id string, owner string, name string, position long"),
        spark.createDataFrame(definitions, "def_id string, owner string, name string, start long, scope_start long, scope_end long, conditional boolean"),
        scopes, spark.createDataFrame(parameters, "def_id string, owner string, name string"),
    )
    assert values(got, "use_id", "def_id", "conditional", "distance") == brute(uses, definitions, parents, parameters)


def test_a_hot_name_is_no_product(spark):
    # Thirty thousand uses and definitions of one name in one block: every use reads what stands right before it.
    n = 30_000
    rows = spark.range(n)
    definitions = rows.select((F.col("id") * 2).alias("def_id"), F.lit("f").alias("owner"), F.lit("x").alias("name"), (F.col("id") * 2).alias("start"), F.lit(0).cast("long").alias("scope_start"), F.lit(10**9).cast("long").alias("scope_end"), (F.col("id") % 4 != 0).alias("conditional"))
    uses = rows.select(F.col("id").alias("use_id"), F.lit("f").alias("owner"), F.lit("x").alias("name"), (F.col("id") * 2 + 1).alias("position"))
    scopes = spark.createDataFrame([("f", "f", 0)], "id string, ancestor string, distance int")
    got = CA.reaching_definitions(uses, definitions, scopes, definitions.limit(0).select("def_id", "owner", "name"))
    assert got.count() == sum(i % 4 + 1 for i in range(n)) and got.filter("def_id > 2 * use_id or def_id < 2 * use_id - 6").isEmpty()
    assert CA.reaching_definitions(uses, definitions.limit(0), scopes, definitions.limit(0).select("def_id", "owner", "name")).isEmpty()
