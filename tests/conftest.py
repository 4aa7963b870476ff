import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from corpusloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("corpusloom-tests", cores=4, shuffle_partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Build a DataFrame from tuples and a schema, or read one back as a sorted list of tuples."""

    def make(data, schema):
        return spark.createDataFrame(data, schema)

    return make


def values(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(row) for row in picked.collect()), key=repr)
