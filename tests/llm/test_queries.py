"""Registered queries on the smallest test tables: against their SQL, else one row per document."""

import os

import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from assay.llm.queries import ORACLE, QUERIES
from tests.compare import compare, database

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="test tables absent")


def test_all_are_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    ok, note = compare(spark, database(ROOT), ROOT, name, QUERIES[name], ORACLE[name])
    assert ok, note


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_one_row_per_document(spark, name):
    ids = pq.read_table(f"{ROOT}/documents.parquet", columns=["doc_id"]).column(0).to_pylist()
    assert sorted(r.doc_id for r in QUERIES[name](spark, ROOT).select("doc_id").collect()) == sorted(ids)
