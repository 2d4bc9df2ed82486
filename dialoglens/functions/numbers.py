"""Small numeric expressions used by the reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: observed range of the best prototype similarity
SIMILARITY_FLOOR = 0.50
SIMILARITY_CEILING = 0.82


def null_to_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def safe_percent(part: Column, whole: Column, places: int = 1) -> Column:
    """Percentage, 0 where there is nothing to divide by."""
    return F.coalesce(F.round(part * 100.0 / F.nullif(whole, F.lit(0)), places), F.lit(0.0))


def safe_ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def delta(current: Column, previous: Column) -> Column:
    """Change between two periods: value (2 dp), percent (1 dp), direction."""
    now, before = null_to_zero(current).cast("double"), null_to_zero(previous).cast("double")
    diff = now - before
    no_base = before == 0
    return F.struct(
        F.when(no_base, now).otherwise(F.round(diff, 2)).alias("value"),
        F.when(no_base, F.when(now > 0, 100.0).otherwise(0.0))
        .otherwise(F.round(diff * 100 / before, 1))
        .alias("percent"),
        F.when(diff > 0, "up").when((diff < 0) & ~no_base, "down").otherwise("same").alias("direction"),
    )


def rescale_score(similarity: Column, threshold: float = 70) -> Column:
    """Best prototype similarity → 0–100 score, flag and confidence; no vector scores 0."""
    similarity = F.coalesce(similarity, F.lit(0.0))
    span = SIMILARITY_CEILING - SIMILARITY_FLOOR
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (similarity - SIMILARITY_FLOOR) / span * 100))
    return F.struct(
        (score >= threshold).alias("is_churn"),
        F.round(score / 100, 3).alias("churn_confidence"),
        F.floor(score).cast("int").alias("churn_score"),
        F.round(similarity, 4).alias("raw_similarity"),
    )


def churn_score_100(confidence: Column) -> Column:
    return F.coalesce(confidence, F.lit(0.0)) * 100
