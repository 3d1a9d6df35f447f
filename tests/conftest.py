from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fieldwise.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=4, app="fieldwise-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session


@pytest.fixture()
def frame(spark):
    """Rows from a list of tuples and a DDL schema."""

    def build(rows, ddl):
        return spark.createDataFrame(rows, ddl)

    return build


@pytest.fixture()
def rows_of():
    def collect(df, *names):
        picked = df.select(*names) if names else df
        return sorted((tuple(r) for r in picked.collect()), key=repr)

    return collect
