"""Architecture queries against their SQL on a table where one supplier is on most lines."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from bindings import ORACLES, model
from conftest import values

TABLES = "region nation supplier part lineitem".split()
NAMES = "env_edges content_range content_range_runtime scope_projection usage_targets usage_index overview_conservation package_usage".split()


@pytest.fixture(scope="module")
def tables(spark):
    """Few suppliers and parts; supplier 1 is on most lines."""
    pairs = [(1 if i % 3 else 1 + i % 9, 1 + i * 7 % 40, "ANR"[i % 3], "OF"[i // 3 % 2]) for i in range(150)]
    return SimpleNamespace(
        region=spark.range(5).select(F.col("id").alias("r_regionkey")),
        nation=spark.range(25).select(F.col("id").alias("n_nationkey"), (F.col("id") % 5).alias("n_regionkey")),
        supplier=spark.range(1, 10).select(F.col("id").alias("s_suppkey"), (F.col("id") * 3 % 25).alias("s_nationkey")),
        part=spark.range(1, 41).select(F.col("id").alias("p_partkey")),
        lineitem=spark.createDataFrame(pairs, "l_suppkey long, l_partkey long, l_returnflag string, l_linestatus string"),
    )


@pytest.fixture(scope="module")
def duck(tables):
    con = pytest.importorskip("duckdb").connect()
    for name in TABLES:
        con.register(name, getattr(tables, name).toArrow())
    return con


def test_all_relations_of_a_hot_supplier(tables):
    flows = model.model_edges(tables).filter("kind not in ('flow-precedes', 'flow-invokes') and (src = 's1' or dst = 's1')")
    assert flows.count() == tables.lineitem.filter("l_suppkey = 1").distinct().count() > 24


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql_with_a_hot_supplier(tables, duck, name):
    df = getattr(model, name)(tables)
    result = duck.execute(ORACLES[name])
    listed = [d[0] for d in result.description]
    assert values(df, *sorted(df.columns)) == sorted((tuple(row[listed.index(c)] for c in sorted(df.columns)) for row in result.fetchall()), key=repr)
