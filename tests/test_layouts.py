"""Plans over stored buckets, and the joins of churners."""

import re

import pytest
from pyspark.sql import functions as F

from dialoglens.operators import joins
from dialoglens.operators.assemble import assemble_conversations
from dialoglens.session import fresh_path
from dialoglens.sources import writers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def buckets(spark, db):
    path = fresh_path(spark, "buckets")
    writers.write_bucketed(db.segments, "bucketed_segments", path, buckets=4)
    yield spark.table("bucketed_segments")
    spark.sql("DROP TABLE bucketed_segments")


def test_grouping_by_call_needs_no_shuffle(spark, db, buckets):
    rows = lambda df: sorted(map(str, df.collect()))
    kinds = joins.call_kinds(buckets, db.sales_queue)
    shuffles = re.findall(r"Exchange \w+\(([^)]*)", plan(kinds))
    assert not [s for s in shuffles if "call_id" in s]
    assert rows(kinds) == rows(joins.call_kinds(db.segments, db.sales_queue))
    made = lambda segments: assemble_conversations(segments, ("A", "C"), 3, "CALL", db.as_of)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in plan(made(buckets)) and "Exchange hashpartitioning(call_id" in plan(made(db.segments))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows(made(buckets)) == rows(made(db.segments))


def test_few_churners_are_sent_to_the_segments(spark, db):
    churners = joins.recent_churners(db.subscriber, ["C"], 30, db.as_of)
    few = joins.calls_of(churners, db.segments)
    text = plan(few)
    # what is shuffled comes from behind the join: no exchange between it and the scan of the segments
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    many = joins.calls_of(churners, db.segments, sent=0)
    assert "_salt" in plan(many)
    same = lambda df: sorted(map(str, df.collect()))
    assert same(few) == same(many.select(few.columns)) and few.count() > 0


def test_scores_of_calls_without_a_summary_are_null(spark):
    sub = spark.createDataFrame([("s1 ", "C", "2024-01-20"), ("s2", "A", "2024-01-20")], "subscriber_no string, sub_status string, d string").withColumn("sub_status_date", F.col("d").cast("timestamp"))
    seg = spark.createDataFrame([("1", "s1", "2024-01-02"), ("1", "s1", "2024-01-03"), ("2", "s1", "2024-01-25"), ("3", "s1", "2024-01-04"), ("4", "s2", "2024-01-04")], "call_id string, subscriber_no string, d string").withColumn("call_time", F.col("d").cast("timestamp"))
    cs = spark.createDataFrame([("1", 5.0), ("1", 7.0), ("9", 9.0)], "source_id string, churn_score double")
    found = joins.churner_calls(sub, seg, cs, ["C"], 30, "2024-01-31 00:00:00")
    assert sorted((r.call_id, str(r.call_time), r.churn_score) for r in found.collect()) == [("1", "2024-01-03 00:00:00", 7.0), ("3", "2024-01-04 00:00:00", None)]
    assert joins.churner_calls(sub.limit(0), seg, cs, ["C"], 30, "2024-01-31 00:00:00").count() == 0
