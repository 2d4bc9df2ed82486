"""Row filters of the reports and drill-downs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dialoglens.functions.text import (
    NEGATIVE_WORDS,
    POSITIVE_WORDS,
    mentions,
    normalize_product,
    not_blank,
    pad_free,
    speaker_class,
    speaker_label,
)
from dialoglens.functions.timing import MINUTE, bound, clock, day_of_week0, fmt_ts, hour24, interval_days

# fixed values: score limits and the labels that select them
CRITICAL, HIGH, HIGH_CHURN, MEDIUM_CHURN = 95, 90, 70, 40
NEGATIVE_MAX, POSITIVE_MIN, NEUTRAL_SCORE = 2, 4, 3
UNKNOWN_PRODUCT = "Unknown"

_COMPARE = {
    "gt": lambda v, t: v > t,
    "gte": lambda v, t: v >= t,
    "lt": lambda v, t: v < t,
    "lte": lambda v, t: v <= t,
    "eq": lambda v, t: v == t,
}


def is_negative(sentiment: Column) -> Column:
    return sentiment <= NEGATIVE_MAX


def is_positive(sentiment: Column) -> Column:
    return sentiment >= POSITIVE_MIN


def is_neutral(sentiment: Column) -> Column:
    return (sentiment == NEUTRAL_SCORE) | sentiment.isNull()


def sentiment_filter(df: DataFrame, kind: str, sentiment: str = "sentiment") -> DataFrame:
    s = F.col(sentiment)
    return df.filter(is_negative(s) if kind == "Negative" else (s > NEGATIVE_MAX) | s.isNull())


def sentiment_text_class(text: Column) -> Column:
    return (
        F.when(mentions(text, POSITIVE_WORDS), "Positive")
        .when(mentions(text, NEGATIVE_WORDS), "Negative")
        .otherwise("Neutral")
    )


def sentiment_text_filter(df: DataFrame, kind: str, sentiment: str = "sentiment_text") -> DataFrame:
    text = F.col(sentiment)
    positive, negative = mentions(text, POSITIVE_WORDS), mentions(text, NEGATIVE_WORDS)
    return df.filter({"Positive": positive, "Negative": negative}.get(kind, ~positive & ~negative))


def risk_level_filter(df: DataFrame, label: str) -> DataFrame:
    score = F.col("churn_score")
    if "Critical" in label or "95" in label:
        return df.filter(score >= CRITICAL)
    if "High" in label or "90" in label:
        return df.filter((score >= HIGH) & (score < CRITICAL))
    return df.filter(score >= HIGH)


def risk_level_filter_3(df: DataFrame, label: str) -> DataFrame:
    score = F.col("churn_score")
    if "High" in label or "70" in label:
        return df.filter(score >= HIGH_CHURN)
    if "Medium" in label or "40" in label:
        return df.filter((score >= MEDIUM_CHURN) & (score < HIGH_CHURN))
    return df.filter((score < MEDIUM_CHURN) | score.isNull())


def risk_class_3(score: Column) -> Column:
    return F.when(score >= HIGH_CHURN, "High").when(score >= MEDIUM_CHURN, "Medium").otherwise("Low")


def score_range(df: DataFrame, low: float, high: float) -> DataFrame:
    return df.filter(F.col("churn_score").between(low, high))


def product_equals(df: DataFrame, name: str) -> DataFrame:
    products = F.col("products")
    return df.filter(products.isNull() if name == UNKNOWN_PRODUCT else products == name)


def has_products(df: DataFrame) -> DataFrame:
    return df.filter(not_blank(F.col("products")))


def hour_cell(df: DataFrame, day_of_week: int, hour: int, time_col: str = "conversation_time") -> DataFrame:
    ts = F.col(time_col)
    return df.filter((day_of_week0(ts) == day_of_week) & (hour24(ts) == hour))


def _customer_terms(subscriber_no: str | None, ban: str | None) -> list[Column]:
    terms = []
    if subscriber_no:
        terms.append(pad_free(F.col("subscriber_no")) == subscriber_no.rstrip())
    if ban:
        terms.append(F.col("ban") == ban)
    if not terms:
        raise ValueError("subscriber_no or ban is required")
    return terms


def customer_filter(df: DataFrame, subscriber_no: str | None = None, ban: str | None = None) -> DataFrame:
    for term in _customer_terms(subscriber_no, ban):
        df = df.filter(term)
    return df


def customer_filter_any(df: DataFrame, subscriber_no: str | None = None, ban: str | None = None) -> DataFrame:
    first, *rest = _customer_terms(subscriber_no, ban)
    return df.filter(first | rest[0] if rest else first)


def chat_base_filter(df: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Chats of the last days that today's export run contains."""
    today = F.date_trunc("day", clock(as_of))
    oldest = bound(df, "case_date", today - interval_days(days))
    return df.filter(
        (F.col("channel_code") != 2)
        & (F.col("last_run_date") > bound(df, "last_run_date", today))
        & (F.col("channel_desc") == "WhatsApp")
        & F.col("text").isNotNull()
        & (F.col("case_date") > oldest)
    )


def check_condition(value: Column, operator: Column, threshold: Column) -> Column:
    """One column for all rules; NULL values and unknown operators do not trigger."""
    met = F.lit(False)
    for name, compare in _COMPARE.items():
        met = F.when(operator == name, compare(value, threshold)).otherwise(met)
    return F.coalesce(met, F.lit(False))


def status_filter(df: DataFrame, status: str | None = None) -> DataFrame:
    return df.filter(F.col("status") == status) if status else df


def success_gate(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Enriched conversations that go on, and those that do not."""
    ok = F.coalesce(F.col("success"), F.lit(False))
    return results.filter(ok), results.filter(~ok)


def call_columns(with_products: bool = True, summary_chars: int | None = None) -> list[Column]:
    """Columns of one line in a list of calls."""
    summary = F.col("summary") if summary_chars is None else F.substring("summary", 1, summary_chars)
    columns = [
        F.col("source_id").alias("call_id"),
        F.col("source_type").alias("type"),
        fmt_ts(F.col("conversation_time"), MINUTE).alias("created"),
        summary.alias("summary"),
        "sentiment",
        "satisfaction",
        F.round("churn_score", 1).alias("churn_score"),
    ]
    return columns + ["products", "action_items"] if with_products else columns


def preview_columns(cs: DataFrame, summary_chars: int = 150) -> DataFrame:
    return cs.select(*call_columns(False, summary_chars))


def with_speaker(df: DataFrame, owner: str = "owner") -> DataFrame:
    return df.withColumns(
        {"speaker_label": speaker_label(F.col(owner)), "speaker_class": speaker_class(F.col(owner))}
    )


def with_display_product(df: DataFrame) -> DataFrame:
    name = F.col("products")
    return df.withColumn("display_name", F.coalesce(normalize_product(name), name))
