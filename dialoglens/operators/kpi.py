"""Key figures, distributions, trends and period comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dialoglens.functions.numbers import delta, null_to_zero
from dialoglens.functions.text import NEGATIVE_WORDS, POSITIVE_WORDS, mentions
from dialoglens.functions.timing import DATE, ago, bound, day_of_week0, fmt_ts, hour24, since, trunc_day
from dialoglens.operators.filters import (
    CRITICAL,
    HIGH,
    HIGH_CHURN,
    MEDIUM_CHURN,
    is_negative,
    is_neutral,
    is_positive,
    risk_class_3,
    sentiment_text_class,
)
from dialoglens.operators.joins import conversations, kind_times
from dialoglens.tables import Tables


def rounded_avg(column: str, places: int) -> Column:
    return F.round(F.avg(column), places)


def _volume() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("source_type") == "CALL").alias("calls"),
        F.count_if(F.col("source_type") == "WAPP").alias("whatsapp"),
    ]


def summary_kpis(db: Tables, days: float = 7, call_type: str = "service") -> DataFrame:
    s = F.col("sentiment")
    return conversations(db, days, call_type).agg(
        *_volume(),
        rounded_avg("satisfaction", 2).alias("avg_satisfaction"),
        rounded_avg("churn_score", 2).alias("avg_churn_score"),
        F.count_if(is_positive(s)).alias("positive"),
        F.count_if(is_negative(s)).alias("negative"),
        F.count_if(is_neutral(s)).alias("neutral"),
    )


def summary_kpis_text(db: Tables, days: float = 7, time_col: str = "creation_date") -> DataFrame:
    """Form for tables whose sentiment is text; a text may count as positive and negative."""
    positive = mentions(F.col("sentiment_text"), POSITIVE_WORDS)
    negative = mentions(F.col("sentiment_text"), NEGATIVE_WORDS)
    return conversations(db, days, "all", time_col).agg(
        *_volume(),
        rounded_avg("satisfaction", 2).alias("avg_satisfaction"),
        rounded_avg("churn_score", 2).alias("avg_churn_score"),
        F.count_if(positive).alias("positive"),
        F.count_if(negative).alias("negative"),
        F.count_if(~positive & ~negative).alias("neutral"),
    )


def _counted(df: DataFrame, label: Column, name: str) -> DataFrame:
    return df.groupBy(label.alias(name)).agg(F.count(F.lit(1)).alias("count"))


def sentiment_breakdown(db: Tables, days: float = 7, call_type: str = "service") -> DataFrame:
    label = F.when(is_negative(F.col("sentiment")), "Negative").otherwise("Other")
    return _counted(conversations(db, days, call_type), label, "sentiment")


def sentiment_breakdown_3(db: Tables, days: float = 7, time_col: str = "creation_date") -> DataFrame:
    label = sentiment_text_class(F.col("sentiment_text"))
    return _counted(conversations(db, days, "all", time_col), label, "sentiment")


def churn_distribution(db: Tables, days: float = 7, call_type: str = "service") -> DataFrame:
    score = F.col("churn_score")
    label = F.when(score >= CRITICAL, "Critical (95-100)").otherwise("High Risk (90-94)")
    return _counted(conversations(db, days, call_type).filter(score >= HIGH), label, "risk_level").orderBy(
        F.desc("risk_level")
    )


def churn_distribution_3(db: Tables, days: float = 7, time_col: str = "creation_date") -> DataFrame:
    return _counted(conversations(db, days, "all", time_col), risk_class_3(F.col("churn_score")), "risk_level")


def satisfaction_distribution(db: Tables, days: float = 7, call_type: str = "service") -> DataFrame:
    rated = conversations(db, days, call_type).filter("satisfaction is not null")
    return _counted(rated, F.col("satisfaction"), "rating").orderBy("rating")


def _by_day(df: DataFrame, *aggregates: Column) -> DataFrame:
    day = trunc_day(F.col("conversation_time")).alias("_day")
    daily = df.groupBy(day).agg(*aggregates).orderBy("_day")
    return daily.select(fmt_ts(F.col("_day"), DATE).alias("call_date"), *[c for c in daily.columns if c != "_day"])


def daily_trend(db: Tables, days: float = 30, call_type: str = "service") -> DataFrame:
    return _by_day(
        conversations(db, days, call_type),
        F.count(F.lit(1)).alias("count"),
        rounded_avg("satisfaction", 2).alias("avg_satisfaction"),
        rounded_avg("churn_score", 2).alias("avg_churn"),
    )


def churn_trend(db: Tables, days: float = 30, call_type: str = "service") -> DataFrame:
    score = F.col("churn_score")
    return _by_day(
        conversations(db, days, call_type),
        F.count(F.lit(1)).alias("total_calls"),
        F.count_if(score >= HIGH_CHURN).alias("high_risk"),
        F.count_if((score >= MEDIUM_CHURN) & (score < HIGH_CHURN)).alias("medium_risk"),
        F.count_if((score < MEDIUM_CHURN) | score.isNull()).alias("low_risk"),
        rounded_avg("churn_score", 1).alias("avg_score"),
    )


def call_heatmap(db: Tables, days: float = 30, call_type: str = "service") -> DataFrame:
    """Calls per day of week and hour, with the largest cell: at most 168 rows."""
    ts = F.col("conversation_time")
    cells = (
        conversations(db, days, call_type)
        .groupBy(day_of_week0(ts).alias("day_of_week"), hour24(ts).alias("hour"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return cells.withColumn("max_count", cells.agg(F.max("count")).scalar()).orderBy("day_of_week", "hour")


def trend_comparison(
    db: Tables, current_days: float = 7, compare_days: float = 7, call_type: str = "service"
) -> DataFrame:
    """Figures of both periods and their changes, from one scan.

    The call type of the current period looks at segments of that period, that of the
    previous one at segments of both.
    """
    both, as_of, ts = current_days + compare_days, db.as_of, F.col("conversation_time")
    cs = db.conversation_summary
    limit = lambda days: bound(cs, "conversation_time", ago(as_of, days))
    scoped = cs.filter(ts >= limit(both))
    now, before = ts > limit(current_days), ts <= limit(current_days)
    if call_type not in (None, "all"):
        scoped = scoped.join(kind_times(db, call_type, both, as_of), "source_id")
        now = now & (F.col("last_time") > ago(as_of, current_days))

    s = F.col("sentiment")
    figures = {
        "total_calls": lambda inside: F.count_if(inside),
        "avg_satisfaction": lambda inside: F.round(F.avg(F.when(inside, F.col("satisfaction"))), 2),
        "avg_churn_score": lambda inside: F.round(F.avg(F.when(inside, F.col("churn_score"))), 1),
        "positive": lambda inside: F.count_if(inside & is_positive(s)),
        "negative": lambda inside: F.count_if(inside & is_negative(s)),
        "neutral": lambda inside: F.count_if(inside & is_neutral(s)),
        "high_risk_count": lambda inside: F.count_if(inside & (F.col("churn_score") >= HIGH_CHURN)),
        "start": lambda inside: F.min(F.when(inside, fmt_ts(ts, DATE))),
        "end": lambda inside: F.max(F.when(inside, fmt_ts(ts, DATE))),
    }
    periods = {"current": now, "previous": before}
    totals = scoped.agg(
        *[build(inside).alias(f"{p}_{name}") for p, inside in periods.items() for name, build in figures.items()]
    )
    for period in periods:
        share = F.col(f"{period}_positive") * 100 / F.nullif(F.col(f"{period}_total_calls"), F.lit(0))
        totals = totals.withColumn(f"{period}_positive_percent", F.round(share, 1))
    dated = ("start", "end")
    numbers = [name for name in [*figures, "positive_percent"] if name not in dated]
    changes = {
        f"delta_{name}": delta(F.col(f"current_{name}"), F.col(f"previous_{name}")) for name in numbers
    }
    shown = [F.col(f"{p}_{d}") for p in periods for d in dated]
    shown += [null_to_zero(F.col(f"{p}_{name}")).alias(f"{p}_{name}") for p in periods for name in numbers]
    return totals.select(*shown, *[c.alias(name) for name, c in changes.items()])


def flat_deltas(comparison: DataFrame) -> DataFrame:
    """Changes as plain columns, one per part."""
    parts = ("value", "percent", "direction")
    structs = [c for c in comparison.columns if c.startswith("delta_")]
    plain = [c for c in comparison.columns if c not in structs]
    return comparison.select(*plain, *[F.col(f"{c}.{p}").alias(f"{c}_{p}") for c in structs for p in parts])


def source_stats(segments: DataFrame) -> DataFrame:
    return segments.agg(F.count(F.lit(1)).alias("total_segments"), F.countDistinct("call_id").alias("total_calls"))


def period_volume(db: Tables, days: float, as_of=None) -> DataFrame:
    return since(db.conversation_summary, "conversation_time", days, as_of or db.as_of).agg(
        F.count(F.lit(1)).alias("count")
    )


