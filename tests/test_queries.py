"""A part of the registered queries beside their check SQL; `check_queries.py` runs all."""

import pytest

import __spark_entry__ as entry
from check_queries import compare, duck
from conftest import SF_DIR

CHECKED = [
    "A01_summary_kpis", "A03_sentiment_breakdown", "A09_top_categories", "A10_categories_overview", "A11_share_of_total",
    "A13_trend_comparison", "A14_products_daily", "A16_queue_distribution_weighted", "A17_repeat_caller_buckets", "A21_churn_accuracy",
    "A23_churn_by_score_range", "A24_churn_trend", "A28_churned_customers", "A29_churn_recall", "A31_transcript_text", "J10_churner_calls",
    "J19_match_keywords", "K01_apply_alert_actions", "K02_apply_rule_changes", "K05_evaluate_alerts", "L15_high_risk_calls",
    "L16_call_details", "L19_customer_journey", "L20_customer_lookup_call", "M13_affected_subscribers", "S08_replace_categories",
    "T16_validate_categories", "T25_structure_result", "W06_rank_rows", "X02_classify", "X03_detect_churn", "R08_historical_replay",
    "R11_alerts_stream",
]


@pytest.fixture(scope="session")
def connection():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, connection, name):
    ok, note = compare(spark, connection, entry.queries()[name], entry.oracle_sql()[name], SF_DIR)
    assert ok, note


def test_every_query_has_check_sql():
    """Names of the queries of the operator inventory begin with a capital."""
    own = {name for name in entry.queries() if name[0].isupper()}
    assert own == {name for name in entry.oracle_sql() if name[0].isupper()} and len(own) > 250


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "call_date"
