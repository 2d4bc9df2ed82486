"""Joins between conversations, segments, categories and subscribers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dialoglens.functions.text import pad_free
from dialoglens.functions.timing import since
from dialoglens.operators.skew import collect_in_parts, small_side
from dialoglens.session import materialize
from dialoglens.tables import Tables

TRANSCRIPT_DAYS = 365
LOOKUP_DAYS = 90


# ---- ledger ------------------------------------------------------------------------------


def handled_calls(processed: DataFrame, source_type: str) -> DataFrame:
    """Ids that the ledger holds for a feed: a chat may have the id of a call."""
    return processed.filter((F.col("source_type") == source_type) & F.col("call_id").isNotNull()).select("call_id").distinct()


def unprocessed(
    segments: DataFrame, processed: DataFrame, lookback_days: float, ledger_days: float, as_of, source_type: str = "CALL"
) -> DataFrame:
    """Recent segments of calls the ledger does not hold for their feed. Ledger rows beyond the window do not count."""
    done = handled_calls(since(processed, "text_time", ledger_days, as_of), source_type)
    return since(segments, "call_time", lookback_days, as_of).join(done, "call_id", "left_anti")


# ---- service and sales calls ----------------------------------------------------------------


def call_kinds(segments: DataFrame, sales_queue: DataFrame) -> DataFrame:
    """Per call the latest segment time in a service and in a sales queue.

    Store this once per load: with it every report filters by call type without
    touching the segments, for any number of days.
    """
    sales = _listed(sales_queue).withColumn("_sales", F.lit(True))
    tagged = segments.filter("queue_name is not null").join(sales, "queue_name", "left")
    return tagged.groupBy(F.col("call_id").alias("source_id")).agg(
        F.max(F.when(F.col("_sales").isNull(), F.col("call_time"))).alias("service"),
        F.max(F.when(F.col("_sales"), F.col("call_time"))).alias("sales"),
    )


def _listed(sales_queue: DataFrame) -> DataFrame:
    return sales_queue.filter("queue_name is not null").select("queue_name").distinct()


def kind_times(db: Tables, kind: str, days: float, as_of) -> DataFrame:
    """`source_id, last_time` of the calls with a segment of that kind within `days`."""
    if "call_kinds" in db:
        return since(db.call_kinds.select("source_id", F.col(kind).alias("last_time")), "last_time", days, as_of)
    recent = since(db.segments, "call_time", days, as_of).filter("queue_name is not null")
    matched = recent.join(_listed(db.sales_queue), "queue_name", "left_semi" if kind == "sales" else "left_anti")
    # one row per call before the join: a call with very many segments combines map-side
    return matched.groupBy(F.col("call_id").alias("source_id")).agg(F.max("call_time").alias("last_time"))


def call_type_filter(cs: DataFrame, db: Tables, call_type: str | None, days: float, as_of) -> DataFrame:
    """Keep conversations with a recent segment in a service (or sales) queue; `all` keeps every one."""
    if call_type in (None, "all"):
        return cs
    if call_type not in ("service", "sales"):
        raise ValueError(f"unknown call type {call_type!r}")
    return cs.join(kind_times(db, call_type, days, as_of), "source_id", "left_semi")


def conversations(db: Tables, days: float, call_type: str | None, time_col: str = "conversation_time") -> DataFrame:
    """Conversations of the last `days`, by call type: the base of most reports."""
    return call_type_filter(since(db.conversation_summary, time_col, days, db.as_of), db, call_type, days, db.as_of)


# ---- categories ------------------------------------------------------------------------------


def category_join(categories: DataFrame, cs: DataFrame, how: str = "inner") -> DataFrame:
    return categories.select("source_id", "source_type", "category_code").join(
        cs, ["source_id", "source_type"], how
    )


def attach_categories(calls: DataFrame, categories: DataFrame, key: str = "source_id") -> DataFrame:
    """Sorted distinct categories per call, `[]` where there are none.

    The set of one call is no larger than the list of categories, whatever the row count.
    """
    per_call = categories.groupBy(F.col("source_id").alias("_key")).agg(
        F.sort_array(F.collect_set("category_code")).alias("categories")
    )
    return (
        calls.join(per_call, calls[key] == per_call["_key"], "left")
        .withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))
        .drop("_key")
    )


# ---- subscribers -------------------------------------------------------------------------------


def subscriber_keys(subscriber: DataFrame) -> DataFrame:
    return subscriber.withColumns(
        {"_sub": pad_free(F.col("subscriber_no")), "_ban": F.col("customer_ban")}
    ).drop("subscriber_no", "customer_ban")


def with_subscriber(cs: DataFrame, subscriber: DataFrame) -> DataFrame:
    """Add `sub_status` and `product_code`, NULL for unknown subscribers."""
    side = subscriber_keys(subscriber).select("_sub", "_ban", "sub_status", "product_code")
    on = (pad_free(cs["subscriber_no"]) == side["_sub"]) & (cs["ban"] == side["_ban"])
    return cs.join(side, on, "left").drop("_sub", "_ban")


def flagged_keys(cs: DataFrame, predicate: Column, *extra: str) -> DataFrame:
    return (
        cs.filter(predicate)
        .select(pad_free(F.col("subscriber_no")).alias("_sub"), F.col("ban").alias("_ban"), *extra)
        .distinct()
    )


def churned_flagged(
    subscriber: DataFrame, cs: DataFrame, predicate: Column, within_days: float | None = None, as_of=None
) -> DataFrame:
    """Churned subscribers that a conversation had flagged, optionally churned lately."""
    churned = subscriber.filter("sub_status = 'C'")
    if within_days is not None:
        churned = since(churned, "sub_status_date", within_days, as_of)
    churned = churned.withColumns({"_sub": pad_free(F.col("subscriber_no")), "_ban": F.col("customer_ban")})
    return churned.join(flagged_keys(cs, predicate), ["_sub", "_ban"], "left_semi").drop("_sub", "_ban")


def product_filter(cs: DataFrame, subscriber: DataFrame, product: str) -> DataFrame:
    """Conversations of the accounts that own a product."""
    owners = subscriber.filter(F.col("product_code") == product).select(F.col("customer_ban").alias("ban")).distinct()
    return cs.join(owners, "ban", "left_semi")


CHURNER_SALTS = 32
#: Churners that are sent to the segments; more of them meet the segments by a shuffle.
SENT_CHURNERS = 1_000_000


def recent_churners(subscriber: DataFrame, statuses: list[str], days: float, as_of) -> DataFrame:
    return since(subscriber.filter(F.col("sub_status").isin(statuses)), "sub_status_date", days, as_of).select(
        pad_free(F.col("subscriber_no")).alias("subscriber_no"),
        F.col("sub_status").alias("churn_status"),
        F.col("sub_status_date").alias("churn_date"),
    )


def calls_of(churners: DataFrame, segments: DataFrame, sent: int = SENT_CHURNERS) -> DataFrame:
    """One row per churner and call before the churn date, with the call's last time.

    Few churners are sent to the segments, of which only those found are shuffled. With many, the key carries a
    salt taken from the call id: the segments of one subscriber spread over many tasks, those of one call stay together.
    """
    before = segments.filter(F.col("call_time") < churners.agg(F.max("churn_date")).scalar())
    spoken = before.select("call_id", pad_free(F.col("subscriber_no")).alias("subscriber_no"), "call_time")
    if churners.limit(sent + 1).count() <= sent:
        found = spoken.join(F.broadcast(churners), "subscriber_no")
    else:
        salts = F.sequence(F.lit(0), F.lit(CHURNER_SALTS - 1)).cast("array<bigint>")
        salted = spoken.withColumn("_salt", F.pmod(F.xxhash64("call_id"), F.lit(CHURNER_SALTS)))
        found = salted.join(churners.withColumn("_salt", F.explode(salts)), ["subscriber_no", "_salt"])
    per_call = found.filter("call_time < churn_date").groupBy("subscriber_no", "churn_status", "churn_date", "call_id")
    return per_call.agg(F.max("call_time").alias("call_time"))


def churner_calls(
    subscriber: DataFrame, segments: DataFrame, cs: DataFrame, statuses: list[str], days: float, as_of, sent: int = SENT_CHURNERS
) -> DataFrame:
    """Calls a churner made before leaving, one row per churner and call, with the churn score.

    The calls found are written once; scores are looked up for them alone.
    """
    churners = recent_churners(subscriber, statuses, days, as_of)
    per_call = materialize(calls_of(churners, segments, sent), "churner-calls")
    found = small_side(per_call.select("call_id").distinct(), sent)
    wanted = cs.select(F.col("source_id").alias("call_id"), "churn_score").join(found, "call_id", "left_semi")
    scores = wanted.groupBy("call_id").agg(F.max("churn_score").alias("churn_score"))
    return per_call.join(scores, "call_id", "left").select("call_id", "subscriber_no", "churn_status", "churn_date", "call_time", "churn_score")


# ---- queues ------------------------------------------------------------------------------------


def queue_join(segments: DataFrame, cs: DataFrame) -> DataFrame:
    """Segments with the summary of their call. Ids are compared as text."""
    return segments.join(cs, segments["call_id"].cast("string") == cs["source_id"], "left")


def calls_in_queue(cs: DataFrame, segments: DataFrame, queue_name: str, days: float, as_of) -> DataFrame:
    ids = (
        since(segments, "call_time", days, as_of)
        .filter(F.col("queue_name") == queue_name)
        .select(F.col("call_id").alias("source_id"))
        .distinct()
    )
    return cs.join(ids, "source_id", "left_semi")


def one_row_per_call(segments: DataFrame, *columns: str, key: str = "call_id") -> DataFrame:
    """Columns of the earliest segment of each call."""
    first = F.min_by(F.struct(*columns), F.struct("call_time", "seq", "owner"))
    return segments.groupBy(key).agg(first.alias("_first")).select(key, "_first.*")


def attach_queue(calls: DataFrame, segments: DataFrame, as_of, key: str = "source_id") -> DataFrame:
    recent = since(segments, "call_time", TRANSCRIPT_DAYS, as_of)
    queues = one_row_per_call(recent, "queue_name").withColumnRenamed("call_id", "_call")
    return calls.join(queues, calls[key] == queues["_call"], "left").drop("_call")


def lookup_customer(results: DataFrame, segments: DataFrame, as_of, days: float = LOOKUP_DAYS) -> DataFrame:
    """Per result the account, subscriber and time of its call."""
    first = one_row_per_call(since(segments, "call_time", days, as_of), "ban", "subscriber_no", "call_time")
    first = first.toDF("_call", "ban", "subscriber_no", "conversation_time")
    return results.join(first, results["call_id"] == first["_call"], "left").drop("_call")


def latest_call_per_churner(calls: DataFrame) -> DataFrame:
    return calls.groupBy("subscriber_no").agg(
        F.max_by("call_id", F.struct("call_time", "call_id")).alias("call_id")
    )


# ---- alerts --------------------------------------------------------------------------------------

RULE_COLUMNS = ["alert_id", "alert_name", "alert_name_he", "metric_source", "metric_name", "filter_product"]


def alert_history_join(history: DataFrame, rules: DataFrame) -> DataFrame:
    return history.join(small_side(rules.select(*RULE_COLUMNS)), "alert_id")


def suppress_open(triggered: DataFrame, history: DataFrame) -> DataFrame:
    """Flag rules that already have an open alert."""
    is_open = (
        history.filter("status = 'ACTIVE'").select("alert_id").distinct().withColumn("already_active", F.lit(True))
    )
    return triggered.join(is_open, "alert_id", "left").withColumn(
        "already_active", F.coalesce("already_active", F.lit(False))
    )


def affected_subscribers(history: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per subscriber behind an alert; an alert without any keeps one row."""
    joined = alert_history_join(history, rules)
    return joined.select(
        "history_id",
        "alert_name",
        "metric_source",
        "filter_product",
        "affected_count",
        F.explode_outer("affected_subscribers").alias("s"),
    ).select("history_id", "alert_name", "metric_source", "filter_product", "affected_count", "s.*")


# ---- transcripts ------------------------------------------------------------------------------------


def transcripts(segments: DataFrame, keys: list[str] = ["call_id"], **limits) -> DataFrame:
    """Segment texts of a call joined by blanks, in time order; parts for very long calls."""
    spoken = segments.filter("text is not null")
    parts = collect_in_parts(spoken, list(keys), ["call_time", "seq", "owner"], F.col("text"), **limits)
    return parts.select(*keys, "part", "parts", F.array_join("items", " ").alias("transcript"))
