"""The weekly evaluation as one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dialoglens.operators import evaluation
from dialoglens.operators.joins import churner_calls
from dialoglens.session import materialize
from dialoglens.tables import Tables


def weekly_evaluation(
    db: Tables,
    statuses: list[str] = evaluation.CHURNED_STATUSES,
    keywords: list[str] = evaluation.CHURN_KEYWORDS,
    days: float = evaluation.EVALUATION_DAYS,
) -> dict[str, DataFrame]:
    """Frames of an evaluation run: `metrics, keywords, phrases, recommendations, history, errors`.

    Churners are written once, as four branches start from them. Without any churner there
    is one error row and no history.
    """
    calls = churner_calls(db.subscriber, db.segments, db.conversation_summary, statuses, days, db.as_of)
    churned = materialize(evaluation.churned_customers(calls), "churned")
    missed = evaluation.missed_churners(churned)
    texts = materialize(evaluation.missed_transcripts(missed, db.segments), "missed")
    metrics = evaluation.churn_recall(churned)
    found = evaluation.missed_keywords(texts, missed, keywords)
    phrases = evaluation.sample_phrases(texts, keywords)
    missed_count = missed.agg(F.count(F.lit(1))).scalar()
    own = evaluation.generate_recommendations(metrics.filter("total_churned > 0"), found, phrases, missed_count)
    fixes = evaluation.classification_recommendation(evaluation.misclassifications(db.feedback, db.as_of))
    recommendations = evaluation.recommendation_rows(own.unionByName(fixes), db.as_of)
    return {
        "churned": churned,
        "metrics": metrics,
        "keywords": evaluation.top_keywords(found),
        "phrases": phrases,
        "recommendations": recommendations,
        "history": evaluation.evaluation_row(metrics.filter("total_churned > 0"), recommendations, db.as_of),
        "errors": metrics.filter("total_churned = 0").select(
            F.lit(f"no customer has left within {days} days").alias("error")
        ),
    }
