"""Pages behind a row: together they are the whole list, also with ties and NULLs."""

import random

import pytest

from dialoglens.operators import calls
from dialoglens.session import fresh_path


@pytest.mark.parametrize("order", [calls.NEWEST, calls.RISKIEST])
def test_pages_make_the_whole_list(spark, order):
    draw = random.Random(3)
    rows = [(draw.choice([None, 1.0, 2.5, 70.0]), draw.choice([None, "2024-01-01", "2024-01-02"]), f"c{k}", draw.choice(["CALL", "WAPP"])) for k in range(23)]
    path = fresh_path(spark, "pages")
    spark.createDataFrame(rows, "churn_score double, t string, source_id string, source_type string").selectExpr(
        "churn_score", "CAST(t AS timestamp) AS conversation_time", "source_id", "source_type"
    ).write.parquet(path)
    stored = spark.read.parquet(path)
    whole = [r.asDict() for r in calls.page_behind(stored, order, None, 1000).collect()]
    pages, last = [], None
    while True:
        page = [r.asDict() for r in calls.page_behind(stored, order, last, 7).collect()]
        if not page:
            break
        pages += page
        last = page[-1]
    assert pages == whole and len(whole) == 23


def test_the_bound_reaches_the_scan(spark):
    path = fresh_path(spark, "pages")
    spark.range(100).selectExpr("CAST(id AS double) AS churn_score", "timestamp_seconds(id) AS conversation_time", "CAST(id AS string) AS source_id", "'CALL' AS source_type").write.parquet(path)
    last = {"churn_score": 50.0, "conversation_time": None, "source_id": "50", "source_type": "CALL"}
    made = calls.page_behind(spark.read.parquet(path), calls.RISKIEST, last, 5)
    assert "LessThanOrEqual(churn_score,50.0)" in made._jdf.queryExecution().executedPlan().toString().replace(" ", "")
    assert [r.churn_score for r in made.collect()] == [49.0, 48.0, 47.0, 46.0, 45.0]
