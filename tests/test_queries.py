"""Registered queries against their checking SQL on the smallest tables.

A few per area run by default; ``TABLEGAUGE_ALL=1`` runs every one.
"""

import os

import pytest

from oracle import compare, connect
from tablegauge.plans import catalog

FOLDER = "/root/testdata/sf0.001"
SOME = (
    "prf_02_column_types", "prf_18_warnings", "lkg_06_strongest_binary", "drf_07_psi_excess", "drf_17_windowed_drift",
    "evl_06_auc", "evl_20_holdout_score", "src_04_tracker_history", "met_09_all_findings", "met_10_follow", "run_09_suggestions",
    "evd_07_record_scores", "evd_08_unified_scores", "evd_16_rejudged", "sta_06_heterogeneity", "sta_09_contrasts", "prp_02_group_split",
    "prp_08_script_scan", "src_11_model_inventory", "led_04_transcripts",
)
NAMES = list(catalog.QUERIES) if os.environ.get("TABLEGAUGE_ALL") else SOME
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_checking_sql(spark, con, name):
    equal, message, _ = compare(spark, con, FOLDER, catalog.QUERIES[name], catalog.ORACLES.get(name))
    assert equal, message


def test_entry_and_registry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
