"""Lists of calls, drill-downs and call details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dialoglens.functions.text import pad_free, preview
from dialoglens.functions.timing import MINUTE, SECOND, fmt_ts, since
from dialoglens.operators.categories import top_n
from dialoglens.operators.filters import (
    call_columns,
    hour_cell,
    product_equals,
    risk_level_filter,
    risk_level_filter_3,
    score_range,
    sentiment_filter,
    sentiment_text_filter,
    status_filter,
    with_speaker,
)
from dialoglens.operators.joins import (
    TRANSCRIPT_DAYS,
    alert_history_join,
    attach_categories,
    attach_queue,
    call_type_filter,
    calls_in_queue,
    category_join,
    conversations,
    with_subscriber,
)
from dialoglens.operators.skew import small_side
from dialoglens.tables import Tables

# every order ends in the id, so that equal times give one result


def _newest(time_col: str = "conversation_time") -> list[Column]:
    return [F.desc_nulls_last(time_col), F.asc("source_id"), F.asc("source_type")]


def _riskiest() -> list[Column]:
    return [F.desc_nulls_last("churn_score"), *_newest()]


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of `df` with the row total and the number of pages on each row."""
    total = df.agg(F.count(F.lit(1))).scalar()
    rows = df.orderBy(*order).offset(offset).limit(limit)
    return rows.withColumn("total", total).withColumn("pages", F.ceil(F.col("total") / limit))


#: Column and whether it descends; NULLs come last.
Order = list[tuple[str, bool]]
NEWEST: Order = [("conversation_time", True), ("source_id", False), ("source_type", False)]
RISKIEST: Order = [("churn_score", True), *NEWEST]


def behind(order: Order, last: dict) -> Column:
    """Rows behind the row `last` in `order`. The bound of the first column reaches the scan."""
    found, equal = F.lit(False), F.lit(True)
    for name, descends in order:
        value = last[name]
        if value is not None:
            further = F.col(name) < F.lit(value) if descends else F.col(name) > F.lit(value)
            found = found | (equal & (further | F.col(name).isNull()))
        equal = equal & F.col(name).eqNullSafe(F.lit(value))
    name, descends = order[0]
    if last[name] is None:
        return F.col(name).isNull() & found
    return ((F.col(name) <= F.lit(last[name]) if descends else F.col(name) >= F.lit(last[name])) | F.col(name).isNull()) & found


def page_behind(df: DataFrame, order: Order, last: dict | None, limit: int) -> DataFrame:
    """The page behind the last row of the page before it (None: the first one).

    Only the rows behind are looked at and only `limit` leave a task, however far the page is. `order` has to tell rows apart.
    """
    columns = [F.desc_nulls_last(name) if descends else F.asc_nulls_last(name) for name, descends in order]
    return top_n(df if last is None else df.filter(behind(order, last)), limit, *columns)


def order_by_severity(df: DataFrame) -> DataFrame:
    rank = F.when(F.col("severity") == "CRITICAL", 1).when(F.col("severity") == "WARNING", 2).otherwise(3)
    return df.orderBy(rank, F.desc_nulls_last("triggered_at"), "history_id")


def recent_conversations(
    db: Tables, days: float = 7, limit: int = 50, call_type: str = "service", time_col: str = "conversation_time",
    summary_chars: int = 150,
) -> DataFrame:
    latest = top_n(conversations(db, days, call_type, time_col), limit, *_newest(time_col))
    return latest.select(*call_columns(False, summary_chars))


def recent_errors(db: Tables, days: float = 7, limit: int = 100, message_chars: int | None = 200) -> DataFrame:
    errors = since(db.error_log, "error_timestamp", days, db.as_of)
    latest = top_n(errors, limit, F.desc_nulls_last("error_timestamp"), F.asc("error_id"))
    return latest.select(
        "error_type",
        preview("error_message", message_chars),
        "call_id",
        fmt_ts(F.col("error_timestamp"), SECOND).alias("timestamp"),
    )


def calls_by_category(
    db: Tables, category: str, days: float = 7, limit: int = 50, call_type: str = "service"
) -> DataFrame:
    chosen = db.conversation_category.filter(F.col("category_code") == category)
    # the time condition on the right side makes the left join an inner one
    joined = since(category_join(chosen, db.conversation_summary, "left"), "conversation_time", days, db.as_of)
    scoped = call_type_filter(joined, db, call_type, days, db.as_of)
    return top_n(scoped, limit, *_newest()).select(*call_columns())


def calls_by_sentiment(
    db: Tables, kind: str, days: float = 7, limit: int = 50, call_type: str = "service"
) -> DataFrame:
    return top_n(sentiment_filter(conversations(db, days, call_type), kind), limit, *_newest()).select(*call_columns())


def calls_by_sentiment_text(db: Tables, kind: str, days: float = 7, limit: int = 50) -> DataFrame:
    scoped = conversations(db, days, "all", "creation_date")
    return top_n(sentiment_text_filter(scoped, kind), limit, *_newest("creation_date")).select(*call_columns())


def calls_by_risk(db: Tables, label: str, days: float = 7, limit: int = 50, call_type: str = "service") -> DataFrame:
    return top_n(risk_level_filter(conversations(db, days, call_type), label), limit, *_riskiest()).select(*call_columns())


def calls_by_risk_3(db: Tables, label: str, days: float = 7, limit: int = 50) -> DataFrame:
    scoped = conversations(db, days, "all", "creation_date")
    return top_n(risk_level_filter_3(scoped, label), limit, *_riskiest()).select(*call_columns())


def calls_by_heatmap_cell(
    db: Tables, day_of_week: int, hour: int, days: float = 30, limit: int = 50, call_type: str = "service"
) -> DataFrame:
    cell = hour_cell(conversations(db, days, call_type), day_of_week, hour)
    return top_n(cell, limit, *_newest()).select(*call_columns(False))


def calls_by_product(db: Tables, name: str, days: float = 7, limit: int = 50, call_type: str = "service") -> DataFrame:
    return top_n(product_equals(conversations(db, days, call_type), name), limit, *_newest()).select(*call_columns(False))


def calls_by_queue(db: Tables, queue_name: str, days: float = 1, limit: int = 100, call_type: str = "service") -> DataFrame:
    cs = calls_in_queue(db.conversation_summary, db.segments, queue_name, days, db.as_of)
    scoped = call_type_filter(cs, db, call_type, days, db.as_of)
    return top_n(scoped, limit, *_newest()).select(*call_columns(False))


def calls_by_score_range(
    db: Tables, low: float = 0, high: float = 100, days: float = 180, limit: int = 50, call_type: str = "service"
) -> DataFrame:
    return top_n(score_range(conversations(db, days, call_type), low, high), limit, *_riskiest()).select(*call_columns())


def high_risk_calls(
    db: Tables,
    low: float = 70,
    high: float = 100,
    days: float = 7,
    offset: int = 0,
    limit: int = 25,
    call_type: str = "service",
    summary_chars: int | None = 100,
) -> DataFrame:
    """One page of risky calls with subscriber status.

    The subscriber join only adds rows, so the leading `offset + limit` calls suffice for it.
    """
    scoped = score_range(conversations(db, days, call_type), low, high)
    total = scoped.agg(F.count(F.lit(1))).scalar()
    leading = top_n(scoped, offset + limit, *_riskiest())
    rows = (
        with_subscriber(leading, db.subscriber)
        .orderBy(*_riskiest(), F.asc("sub_status"), F.asc("product_code"))
        .offset(offset)
        .limit(limit)
    )
    return rows.select(
        F.col("source_id").alias("call_id"),
        F.col("source_type").alias("type"),
        fmt_ts(F.col("conversation_time"), MINUTE).alias("created"),
        "churn_score",
        pad_free(F.col("subscriber_no")).alias("subscriber_no"),
        "ban",
        preview("summary", summary_chars),
        "sub_status",
        "product_code",
        total.alias("total"),
        F.ceil(total / limit).alias("pages"),
    )


def call_details(db: Tables, ids: DataFrame) -> DataFrame:
    """Everything about a set of calls: `ids` has a column `source_id`."""
    wanted = ids.select("source_id").distinct()
    chosen = db.conversation_summary.join(wanted, "source_id", "left_semi")
    categories = db.conversation_category.join(wanted, "source_id", "left_semi")
    segments = db.segments.join(wanted.withColumnRenamed("source_id", "call_id"), "call_id", "left_semi")
    detailed = attach_queue(
        attach_categories(with_subscriber(chosen, db.subscriber), categories), segments, db.as_of
    )
    return detailed.select(
        F.col("source_id").alias("call_id"),
        F.col("source_type").alias("type"),
        fmt_ts(F.col("conversation_time"), SECOND).alias("created"),
        "summary",
        "sentiment",
        "satisfaction",
        F.round("churn_score", 1).alias("churn_score"),
        "products",
        "action_items",
        "unresolved_issues",
        "ban",
        pad_free(F.col("subscriber_no")).alias("subscriber_no"),
        "sub_status",
        "product_code",
        "categories",
        "queue_name",
    )


def call_conversation(db: Tables, ids: DataFrame) -> DataFrame:
    """Transcript lines of a set of calls with speaker labels and the line count of the call.

    Lines come in order per call; the count is an aggregate joined back, not a window.
    """
    wanted = ids.select(F.col("source_id").alias("call_id")).distinct()
    lines = since(db.segments, "call_time", TRANSCRIPT_DAYS, db.as_of).join(wanted, "call_id", "left_semi")
    counts = lines.groupBy("call_id").agg(F.count(F.lit(1)).alias("message_count"))
    labelled = with_speaker(lines.join(counts, "call_id"))
    return labelled.orderBy("call_id", "call_time", "seq", "owner", "text").select(
        "call_id",
        F.col("owner").alias("speaker"),
        fmt_ts(F.col("call_time"), SECOND).alias("timestamp"),
        "seq",
        "text",
        "speaker_label",
        "speaker_class",
        "message_count",
    )


# ---- alerts, ledger, results ------------------------------------------------------------------

HISTORY_COLUMNS = [
    "history_id",
    "alert_id",
    "alert_name",
    "metric_source",
    "filter_product",
    "metric_value",
    "threshold_value",
    "severity",
    "status",
    "triggered_at",
    "affected_count",
    "acknowledged_by",
    "resolved_by",
]


def alert_history(
    db: Tables, days: float = 7, status: str | None = None, offset: int = 0, limit: int = 50
) -> DataFrame:
    recent = status_filter(since(db.alert_history, "triggered_at", days, db.as_of), status)
    joined = alert_history_join(recent, db.alert_rules)
    paged = page(joined, [F.desc_nulls_last("triggered_at"), F.asc("history_id")], offset, limit)
    shown = [c for c in HISTORY_COLUMNS if c != "triggered_at"]
    return paged.select(*shown, fmt_ts(F.col("triggered_at"), MINUTE).alias("triggered_at"), "total", "pages")


def active_alerts(db: Tables) -> DataFrame:
    active = alert_history_join(db.alert_history.filter("status = 'ACTIVE'"), db.alert_rules)
    return order_by_severity(active).select(*HISTORY_COLUMNS)


def list_alert_rules(rules: DataFrame) -> DataFrame:
    return rules.orderBy(F.desc_nulls_last("created_at"), "alert_id")


def read_enabled_rules(rules: DataFrame) -> DataFrame:
    return small_side(rules.filter("is_enabled"))


def recent_processed(ledger: DataFrame, limit: int = 20) -> DataFrame:
    latest = top_n(ledger, limit, F.desc_nulls_last("processed_at"), F.asc("call_id"))
    return latest.select("call_id", "processed_at", "sqs_message_id")


def recent_results(call_summary: DataFrame, limit: int = 20) -> DataFrame:
    latest = top_n(call_summary, limit, F.desc_nulls_last("processed_at"), F.asc("call_id"))
    return latest.select("call_id", "sentiment", "classification_primary", "confidence_score", "processed_at")


def status_report(status: DataFrame) -> DataFrame:
    return status.select("table_name", "total_processed", "last_processed_timestamp", "is_enabled")
