"""Headline queries against their SQL text on the smallest data folder."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

FOLDER = "/root/testdata/sf0.001"
NAMES = ["appointments_collapse", "maintenance_events", "due_windows", "features_counts", "features_intervals", "features_fleet", "roc_auc", "lift_table", "gains_curve", "calibration_table",
         "contact_candidates", "contact_summary", "fold_dedup", "asof_nearest", "eda_followup_bands", "retention_life_year", "identity_patterns", "quality_rules", "percentile_table", "spearman", "information_value"]


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    status, n, _, _, detail = compare(spark, con, FOLDER, name, entry.queries()[name], entry.oracle_sql()[name])
    assert status == "ok", detail


def test_entry_and_registry(spark):
    assert entry.entry(spark).columns[0] == "window_id"
    assert set(entry.oracle_sql()) <= set(entry.queries())
