"""Subscribers who called several times within a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dialoglens.functions.numbers import null_to_zero
from dialoglens.functions.text import not_blank
from dialoglens.functions.timing import MINUTE, fmt_ts
from dialoglens.operators.categories import top_n
from dialoglens.operators.filters import HIGH_CHURN
from dialoglens.operators.joins import conversations
from dialoglens.tables import Tables

REPEAT_DAYS = 1
REPEAT_FROM = 2
LAST_BUCKET = 6
TOP_FROM = 7


def caller_counts(db: Tables, call_type: str = "service", days: float = REPEAT_DAYS) -> DataFrame:
    callers = conversations(db, days, call_type).filter(not_blank(F.col("subscriber_no")))
    return callers.groupBy("subscriber_no", "ban").agg(
        F.count(F.lit(1)).alias("call_count"),
        F.max("churn_score").alias("max_churn_score"),
        fmt_ts(F.max("conversation_time"), MINUTE).alias("last_call"),
    )


def _label(size: Column) -> Column:
    return F.concat(size.cast("string"), F.when(size == LAST_BUCKET, "+").otherwise(""), F.lit(" calls"))


def repeat_caller_buckets(db: Tables, call_type: str = "service", days: float = REPEAT_DAYS) -> DataFrame:
    """Subscribers per number of calls: 2, 3, 4, 5, 6+. Every bucket has a row."""
    size = F.least("call_count", F.lit(LAST_BUCKET)).cast("int").alias("size")
    counted = (
        caller_counts(db, call_type, days)
        .filter(F.col("call_count") >= REPEAT_FROM)
        .groupBy(size)
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.count_if(F.col("max_churn_score") >= HIGH_CHURN).alias("high_risk"),
        )
    )
    buckets = db.spark.range(REPEAT_FROM, LAST_BUCKET + 1, numPartitions=1).select(F.col("id").cast("int").alias("size"))
    return buckets.join(counted, "size", "left").select(
        F.col("size").alias("bucket_order"),
        _label(F.col("size")).alias("label"),
        null_to_zero(F.col("count")).alias("count"),
        null_to_zero(F.col("high_risk")).alias("high_risk"),
    )


def bucket_low_risk(buckets: DataFrame) -> DataFrame:
    return buckets.withColumn("low_risk", F.col("count") - F.col("high_risk"))


def repeat_caller_list(
    db: Tables,
    min_calls: int = 1,
    max_calls: int = 999,
    high_risk_only: bool = False,
    limit: int = 100,
    call_type: str = "service",
    days: float = REPEAT_DAYS,
) -> DataFrame:
    callers = caller_counts(db, call_type, days).filter(F.col("call_count").between(min_calls, max_calls))
    if high_risk_only:
        callers = callers.filter(F.col("max_churn_score") >= HIGH_CHURN)
    order = [F.desc("call_count"), F.desc_nulls_last("max_churn_score"), F.asc("subscriber_no"), F.asc("ban")]
    return top_n(callers, limit, *order)


def top_repeat_callers(
    db: Tables, limit: int = 10, call_type: str = "service", min_calls: int = TOP_FROM, days: float = REPEAT_DAYS
) -> DataFrame:
    callers = caller_counts(db, call_type, days).filter(F.col("call_count") >= min_calls)
    return top_n(callers, limit, F.desc("call_count"), F.asc("subscriber_no"), F.asc("ban"))
