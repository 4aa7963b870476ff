"""Reader queries on rows that the driver tables do not have, against their SQL."""

from types import SimpleNamespace

import pytest

from bindings import ORACLES, readers
from conftest import values

ADDRESSES = ["a.org", "a.org/", "a.org/x.html", "a.org/en", "a.org/en/x.html", "a.org/de/x.html#top", "a.org/de/y/z.tar.GZ", "a.org/en/y/z.md?q=1", "a.org/english/x.py", "a.org/de/1/2/3/4.html"]


def test_path_functions_of_any_depth(spark):
    duckdb = pytest.importorskip("duckdb")
    pages = spark.createDataFrame([(i, f"https://{a}") for i, a in enumerate(ADDRESSES)], "page_id long, url string")
    con = duckdb.connect()
    con.register("pages", pages.toArrow())
    result = con.execute(ORACLES["path_functions"])
    listed = [d[0] for d in result.description]
    df = readers.path_functions(SimpleNamespace(pages=pages))
    assert values(df, *sorted(df.columns)) == sorted((tuple(row[listed.index(c)] for c in sorted(df.columns)) for row in result.fetchall()), key=repr)
