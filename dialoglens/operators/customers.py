"""Views of one customer, answered for whole frames of customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dialoglens.functions.text import pad_free, preview
from dialoglens.functions.timing import MINUTE, SECOND, fmt_ts, since
from dialoglens.operators.joins import TRANSCRIPT_DAYS, attach_categories, subscriber_keys
from dialoglens.tables import Tables

JOURNEY_CALLS = 50
LOOKUP_CALLS = 10


def subscriber_status(subscriber: DataFrame, keys: DataFrame) -> DataFrame:
    """Status of each `subscriber_no, ban` in `keys`; UNKNOWN where there is no such subscriber."""
    side = subscriber_keys(subscriber).select("_sub", "_ban", "sub_status", "product_code")
    wanted = keys.select("subscriber_no", "ban").distinct()
    on = (pad_free(wanted["subscriber_no"]) == side["_sub"]) & (wanted["ban"] == side["_ban"])
    return wanted.join(side, on, "left").select(
        "subscriber_no",
        "ban",
        F.coalesce("sub_status", F.lit("UNKNOWN")).alias("status"),
        F.coalesce(F.col("sub_status") == "A", F.lit(False)).alias("is_active"),
        "product_code",
    )


def _known(db: Tables, customers: DataFrame) -> DataFrame:
    """Conversations of the customers in the last year, with canonical ids."""
    cs = since(db.conversation_summary, "conversation_time", TRANSCRIPT_DAYS, db.as_of)
    cs = cs.withColumn("subscriber_no", pad_free(F.col("subscriber_no")))
    return cs.join(customers, ["subscriber_no", "ban"], "left_semi")


def _latest(calls: DataFrame, limit: int, *keys: str) -> DataFrame:
    """The newest calls per key. Spark keeps `limit` rows per key before the shuffle as well."""
    newest = Window.partitionBy(*keys).orderBy(
        F.desc_nulls_last("conversation_time"), F.asc("source_id"), F.asc("source_type")
    )
    return calls.withColumn("position", F.row_number().over(newest)).filter(F.col("position") <= limit)


def avg_churn(calls: DataFrame, *keys: str) -> DataFrame:
    """Mean of the scores that are known, themselves rounded to one place."""
    return calls.groupBy(*keys).agg(F.round(F.avg(F.round("churn_score", 1)), 1).alias("avg_churn_score"))


def journey_timeline(db: Tables, customers: DataFrame, limit: int = JOURNEY_CALLS, summary_chars: int | None = 200) -> DataFrame:
    """The last interactions of each customer of the last year, newest first."""
    wanted = _canonical(customers)
    latest = _latest(_known(db, wanted), limit, "subscriber_no", "ban")
    shown = latest.select("source_id").distinct()
    categories = db.conversation_category.join(shown, "source_id", "left_semi")
    return attach_categories(latest, categories).select(
        "subscriber_no",
        "ban",
        "position",
        "source_id",
        "source_type",
        fmt_ts(F.col("conversation_time"), SECOND).alias("call_date"),
        "sentiment",
        F.round("churn_score", 1).alias("churn_score"),
        "satisfaction",
        preview("summary", summary_chars),
        "products",
        "categories",
    )


def customer_journey(db: Tables, customers: DataFrame, limit: int = JOURNEY_CALLS) -> DataFrame:
    """Header of each journey: status, number of shown interactions and their average score."""
    wanted = _canonical(customers)
    latest = _latest(_known(db, wanted), limit, "subscriber_no", "ban")
    counted = latest.groupBy("subscriber_no", "ban").agg(
        F.count(F.lit(1)).alias("total_interactions"),
        F.round(F.avg(F.round("churn_score", 1)), 1).alias("avg_churn_score"),
    )
    status = subscriber_status(db.subscriber, wanted)
    joined = status.join(counted, ["subscriber_no", "ban"], "left")
    return joined.select(
        "subscriber_no",
        "ban",
        _shown_status().alias("status"),
        "product_code",
        F.coalesce("total_interactions", F.lit(0)).alias("total_interactions"),
        "avg_churn_score",
    )


def _shown_status() -> Column:
    return F.coalesce(F.nullif("status", F.lit("UNKNOWN")), F.lit("Unknown"))


def _canonical(customers: DataFrame) -> DataFrame:
    return customers.select(pad_free(F.col("subscriber_no")).alias("subscriber_no"), "ban").distinct()


def resolve_customers(db: Tables, values: DataFrame, by: str) -> DataFrame:
    """Customer behind each searched `value`, a phone number or a call id.

    A phone number used on several accounts resolves to the account of its latest call.
    """
    key = F.col("source_id") if by == "source_id" else pad_free(F.col("subscriber_no"))
    wanted = values.select(F.trim("value").alias("value")).filter("value != ''").distinct()
    cs = db.conversation_summary.select(
        key.alias("value"),
        F.struct("conversation_time", "source_id", "source_type").alias("_when"),
        F.struct(pad_free(F.col("subscriber_no")).alias("subscriber_no"), "ban").alias("_who"),
    )
    found = cs.join(wanted, "value", "left_semi").groupBy("value").agg(F.max_by("_who", "_when").alias("_who"))
    return wanted.join(found, "value", "left").select("value", "_who.subscriber_no", "_who.ban")


def _matching_calls(db: Tables, resolved: DataFrame) -> DataFrame:
    """Calls per searched value: both ids must match; where one is unknown, the other alone."""
    cs = since(db.conversation_summary, "conversation_time", TRANSCRIPT_DAYS, db.as_of)
    cs = cs.withColumn("subscriber_no", pad_free(F.col("subscriber_no")))
    both = resolved.filter("subscriber_no is not null and ban is not null")
    by_number = resolved.filter("subscriber_no is not null and ban is null").drop("ban")
    by_account = resolved.filter("subscriber_no is null and ban is not null").drop("subscriber_no")
    columns = ["value", *[c for c in cs.columns if c not in ("subscriber_no", "ban")]]
    return (
        cs.join(both, ["subscriber_no", "ban"]).select(*columns)
        .unionByName(cs.join(by_number, "subscriber_no").select(*columns))
        .unionByName(cs.join(by_account, "ban").select(*columns))
    )


def customer_lookup(db: Tables, values: DataFrame, by: str = "phone") -> DataFrame:
    """Found flag, ids, status and the number of interactions of the last year per searched value."""
    resolved = resolve_customers(db, values, by)
    totals = _matching_calls(db, resolved).groupBy("value").agg(F.count(F.lit(1)).alias("total_interactions"))
    status = subscriber_status(db.subscriber, resolved.filter("subscriber_no is not null and ban is not null"))
    return (
        resolved.join(totals, "value", "left")
        .join(status, ["subscriber_no", "ban"], "left")
        .select(
            "value",
            (F.col("subscriber_no").isNotNull() | F.col("ban").isNotNull()).alias("found"),
            "subscriber_no",
            "ban",
            _shown_status().alias("status"),
            "product_code",
            F.coalesce("total_interactions", F.lit(0)).alias("total_interactions"),
        )
    )


def lookup_recent_calls(
    db: Tables, values: DataFrame, by: str = "phone", limit: int = LOOKUP_CALLS, summary_chars: int | None = 80
) -> DataFrame:
    """The newest calls of each searched customer."""
    latest = _latest(_matching_calls(db, resolve_customers(db, values, by)), limit, "value")
    return latest.select(
        "value",
        "position",
        "source_id",
        "source_type",
        fmt_ts(F.col("conversation_time"), MINUTE).alias("call_date"),
        "sentiment",
        F.round("churn_score", 1).alias("churn_score"),
        "satisfaction",
        preview("summary", summary_chars),
    )
