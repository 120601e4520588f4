"""Registered queries against DuckDB; a cross-section by default, everything with TALLY_ALL=1."""

import os

import pytest
from oracle import compare, connect

from tallyspark.catalog.index import ORACLES, QUERIES

FOLDER = os.environ.get("TALLY_SF_DIR", "/root/testdata/sf0.001")
SAMPLE = [
    "a02_spend_by_category", "a06_trend_monthly", "a09_category_explorer", "a11_insights", "w08_number_parts", "n01_parse_minor", "n06_normalize_item",
    "o01_generate_occurrences", "o04_commitment_summary", "o14_late_charge", "j07_debt_detail", "x25_attention", "x28_eligible_reminders",
    "w06_rank_merchants", "w11_monotone_mileage", "m01_fold_confirmations", "m05_payment_overrides", "m19_merge", "dq03_check_checkpoints",
    "w04_topk_with_gap", "n17_topk_json", "e06_threshold_sweep", "e18_gap_summary", "r04_money_tokens", "r16_repair_targets", "st02_stream_payments",
]
NAMES = sorted(ORACLES) if os.environ.get("TALLY_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    assert compare(name, QUERIES[name](spark, FOLDER), con, ORACLES[name]) == ""


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
