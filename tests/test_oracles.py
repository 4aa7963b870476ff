"""Registered queries next to their SQL oracles at the smallest scale.

A spread of queries by default; CORPUSLOOM_ALL_ORACLES=1 runs them all (tools/check.py does so at any scale).
"""

import math
import os
from pathlib import Path

import pytest

import __spark_entry__ as entry
from bindings import ORACLES, QUERIES

FOLDER = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(ORACLES)
CHOSEN = NAMES if os.environ.get("CORPUSLOOM_ALL_ORACLES") else NAMES[::6]

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="driver tables not present")


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(value, 6) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    got = sorted((tuple(cell(row[c]) for c in columns) for row in df.collect()), key=repr)
    result = duck.execute(ORACLES[name])
    listed = [d[0] for d in result.description]
    assert sorted(listed) == columns
    want = sorted((tuple(cell(row[listed.index(c)]) for c in columns) for row in result.fetchall()), key=repr)
    assert got == want


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    flagship = entry.entry(spark)
    assert flagship.columns == ["src_owner", "dst_owner", "kind", "confidence", "n", "internal"] and flagship.count() > 0
