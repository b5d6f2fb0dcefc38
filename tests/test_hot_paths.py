"""The registered queries again with every limit lowered, so that splitting and shuffle joins are exercised on real tables."""

import os

import pytest

import __spark_entry__ as entry
from assay.operators import ordered
from tests.compare import compare, database

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="test tables absent")

ORDERED = ["a3_chunk_plan", "b3_exact_quantiles", "e5_scd2_history", "h2_lags", "h8_temporal", "h10_readmission", "h17_days_covered",
           "h22_alert_bursts", "i10_monthly_limit", "i15_running_balance", "i16_illegal_transitions", "k2_completed_stages", "k5_run_segments"]
SIZED = ["a8_quarantined_rows", "f0c_quarantine_summary", "e1_impute_group_mean", "e21_outliers", "e35_promotion"]


@pytest.fixture
def low_limits(monkeypatch):
    monkeypatch.setattr(ordered, "HOT_ROWS", 6)
    monkeypatch.setattr(ordered, "BROADCAST_BYTES", 0)


@pytest.mark.parametrize("name", ORDERED + SIZED)
def test_query_with_low_limits(spark, low_limits, name):
    ok, note = compare(spark, database(ROOT), ROOT, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, note
