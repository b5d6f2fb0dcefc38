"""Every registered query against its SQL on the smallest test tables."""

import os

import pytest

import __spark_entry__ as entry
from assay.checks.registry import ORACLE, QUERIES
from tests.compare import compare, database

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="test tables absent")


@pytest.fixture(scope="module")
def con():
    return database(ROOT)


# No pair of tables is ever multiplied out, and no row passes through Python.
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    def run(session, root):
        df = QUERIES[name](session, root)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not [word for word in FORBIDDEN if word in plan], plan
        return df

    ok, note = compare(spark, con, ROOT, name, run, ORACLE.get(name))
    assert ok, note


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 3
