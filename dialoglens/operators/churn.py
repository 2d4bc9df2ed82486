"""Churn predictions against real churn."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from dialoglens.functions.numbers import null_to_zero, safe_percent
from dialoglens.functions.text import pad_free
from dialoglens.functions.timing import since
from dialoglens.operators.filters import HIGH_CHURN
from dialoglens.operators.joins import churned_flagged, conversations, subscriber_keys
from dialoglens.tables import Tables


@dataclass(frozen=True)
class Band:
    label: str
    low: int
    high: int


# fixed values: score bands of the reports
BANDS = [Band("95-100 (Critical)", 95, 100), Band("90-95 (High)", 90, 94), Band("0-90 (Other)", 0, 89)]
BANDS_4 = [
    Band("90-100 (Critical)", 90, 100),
    Band("70-90 (High)", 70, 89),
    Band("40-70 (Medium)", 40, 69),
    Band("0-40 (Low)", 0, 39),
]


def _flagged() -> Column:
    return F.col("churn_score") >= HIGH_CHURN


def calls_of_accounts(cs: DataFrame, *extra: str) -> DataFrame:
    """Number of conversations of each account: what reports on flagged calls and on subscribers start from."""
    return cs.groupBy(pad_free(F.col("subscriber_no")).alias("_sub"), F.col("ban").alias("_ban"), *extra).agg(F.count(F.lit(1)).alias("calls"))


def with_churns(accounts: DataFrame, churned: DataFrame) -> DataFrame:
    """Add `churns`, the number of churned subscribers of each account."""
    left = subscriber_keys(churned).groupBy("_sub", "_ban").agg(F.count(F.lit(1)).alias("churns"))
    return accounts.join(left, ["_sub", "_ban"], "left")


def churn_accuracy(db: Tables, days: float = 180, call_type: str = "service") -> DataFrame:
    """Predictions are calls, churns are subscribers; `flagged_subscribers` is the like-for-like count."""
    flagged = with_churns(calls_of_accounts(conversations(db, days, call_type).filter(_flagged())), db.subscriber.filter("sub_status = 'C'"))
    counts = flagged.agg(
        null_to_zero(F.sum("calls")).alias("total_predictions"),
        null_to_zero(F.sum("churns")).alias("actual_churns"),
        F.count(F.lit(1)).alias("flagged_subscribers"),
    )
    return counts.withColumns(
        {
            "accuracy_rate": safe_percent(F.col("actual_churns"), F.col("total_predictions")),
            "false_positives": F.col("total_predictions") - F.col("actual_churns"),
        }
    )


def churn_by_product(db: Tables, days: float = 180, call_type: str = "service") -> DataFrame:
    churned = churned_flagged(db.subscriber, conversations(db, days, call_type), _flagged())
    return (
        churned.groupBy("product_code").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "product_code")
    )


def band_of(score: Column, bands: list[Band], strict: bool) -> Column:
    """Index of the band of a score, NULL outside all of them.

    Bands run up to the next one, so 94.5 counts; `strict` keeps their printed whole limits
    and leaves the gaps.
    """
    index = F.lit(None).cast("int")
    upper = None
    for position, band in sorted(enumerate(bands), key=lambda x: -x[1].low):
        inside = score >= band.low
        inside = inside & ((score <= band.high) if strict or upper is None else (score < upper))
        index = F.when(inside, position).otherwise(index)
        upper = band.low
    return index


def churn_by_score_range(
    db: Tables,
    days: float = 180,
    call_type: str = "service",
    bands: list[Band] = BANDS,
    strict: bool = False,
    churned_within_days: float | None = None,
) -> DataFrame:
    """Predictions and churns per band, all bands in one pass."""
    cs = conversations(db, days, call_type).withColumn("band", band_of(F.col("churn_score"), bands, strict))
    churned = db.subscriber.filter("sub_status = 'C'")
    if churned_within_days is not None:
        churned = since(churned, "sub_status_date", churned_within_days, db.as_of)
    accounts = with_churns(calls_of_accounts(cs.filter("band is not null"), "band"), churned)
    found = accounts.groupBy("band").agg(F.sum("calls").alias("predictions"), F.sum("churns").alias("actual_churns"))

    rows = [(i, b.label, f"{b.low}-{b.high}", b.low, b.high) for i, b in enumerate(bands)]
    listed = db.spark.createDataFrame(rows, "band int, label string, range string, min_score int, max_score int")
    joined = listed.join(found, "band", "left")
    n, c = null_to_zero(F.col("predictions")), null_to_zero(F.col("actual_churns"))
    return joined.select(
        "label",
        "range",
        "min_score",
        "max_score",
        n.alias("predictions"),
        c.alias("actual_churns"),
        safe_percent(c, n).alias("accuracy"),
        (n - c).alias("false_positives"),
    )
