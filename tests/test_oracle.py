"""Registered queries against their SQL on the smallest tables.

ORACLE_ALL=1 runs every query; the default is one per family.
"""

import os

import pytest

import catalog
from oracle_check import check, duck

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
catalog.load()
SAMPLE = (
    "baseline_accuracy",
    "prior_drift_strict",
    "neighbor_event_count",
    "sector_cohort_return",
    "canonical_urls",
    "document_mentions",
    "news_features",
    "strategy_metrics",
    "barrier_outcomes",
    "sessions_cap_weight",
    "confidence_thresholds",
    "permuted_globally",
    "bootstrap_null",
    "sector_summary",
    "annual_events",
    "account_state",
    "bars_from_ticks",
    "backfilled_documents",
)
NAMES = sorted(catalog.ORACLES) if os.environ.get("ORACLE_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    message, _, _ = check(spark, con, SF, name, catalog.QUERIES[name], catalog.ORACLES[name])
    assert message is None, message


def test_known_counts(spark, con):
    row = catalog.QUERIES["baseline_accuracy"](spark, "/root/testdata/sf0.001").first()
    assert (row["events"], row["scored"], row["correct"]) == (276, 266, 126)
