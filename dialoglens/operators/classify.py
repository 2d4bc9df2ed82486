"""Categories, keywords and churn prototypes against texts and vectors.

Categories, keywords and prototypes are configuration: a checked number of them becomes part
of the plan, more are stored and met in the tasks. Each text keeps one row.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from dialoglens.functions.numbers import rescale_score, safe_percent
from dialoglens.functions.vectors import similarity_to
from dialoglens.operators.categories import top_n
from dialoglens.operators.keyword_search import with_matches
from dialoglens.operators.references import stored_references, with_best, with_scores
from dialoglens.operators.skew import config_rows

# fixed values: weights and limits of the scoring
STRONG_BOOST, WEAK_BOOST, WEAK_NEEDED = 0.15, 0.05, 2
STRONG_WEIGHT, WEAK_WEIGHT, SCORE_NEEDED = 3, 1, 2
TOP_K, SIMILARITY_NEEDED, FUZZY_NEEDED = 2, 0.35, 0.85
CHURN_THRESHOLD = 70
UNCLASSIFIED = "לא מסווג"
FEWEST_CATEGORIES = 5
#: References that become part of the plan; more are met block by block.
PLAN_REFERENCES = 10_000


# ---- keywords ----------------------------------------------------------------------------------


def match_keywords(texts: DataFrame, keywords: DataFrame, text: str = "text") -> DataFrame:
    """Add `matches`: the keywords that occur in the text, case ignored, in their order.

    Each has its category, the category's place among all, its strength and the keyword. No row is multiplied.
    """
    return with_matches(texts, keywords.select("category", "strength", "keyword"), text)


def _matched(matches: Column, category: Column, strength: str) -> Column:
    return F.size(F.filter(matches, lambda m: (m["category"] == category) & (m["strength"] == strength)))


def keyword_boost(matches: Column, category: Column) -> Column:
    """Boost of one category: once for any strong keyword, once for two weak ones."""
    strong = F.when(_matched(matches, category, "strong") > 0, STRONG_BOOST).otherwise(0.0)
    weak = F.when(_matched(matches, category, "weak") >= WEAK_NEEDED, WEAK_BOOST).otherwise(0.0)
    return strong + weak


def keyword_category(matched: DataFrame) -> DataFrame:
    """Add `keyword_category, keyword_score`: most points, first category on ties, at least 2 points."""
    met = F.array_distinct(F.transform("matches", lambda m: F.struct(m["category_pos"].alias("pos"), m["category"].alias("category"))))
    scored = F.transform(
        met,
        lambda c: F.struct(
            (
                _matched(F.col("matches"), c["category"], "strong") * STRONG_WEIGHT
                + _matched(F.col("matches"), c["category"], "weak") * WEAK_WEIGHT
            ).alias("score"),
            (-c["pos"]).alias("first"),
            c["category"].alias("category"),
        ),
    )
    rated = matched.withColumn("_best", F.array_max(scored))
    enough = F.col("_best.score") >= SCORE_NEEDED
    return rated.withColumns(
        {"keyword_category": F.when(enough, F.col("_best.category")), "keyword_score": F.when(enough, F.col("_best.score"))}
    ).drop("_best")


# ---- vectors -------------------------------------------------------------------------------------


def score_against(
    vectors: DataFrame, references: DataFrame, order: str, vector: str = "embedding", in_plan: int = PLAN_REFERENCES
) -> DataFrame:
    """Add `scores`: similarity to each reference vector, in `order`."""
    rows = references.select(order, "embedding").orderBy(order).limit(in_plan + 1).collect()
    if len(rows) > in_plan:
        return with_scores(vectors, stored_references(references.select(order, "embedding"), order), references.count(), vector)
    return vectors.withColumn("scores", similarity_to([r.embedding for r in rows])(F.col(vector)))


def best_prototype(scores: Column) -> Column:
    """Highest similarity (4 dp) and the first index that reaches it."""
    ranked = F.transform(scores, lambda s, i: F.struct(F.round(s, 4).alias("similarity"), (-i).alias("first")))
    best = F.array_max(ranked)
    return F.struct(best["similarity"].alias("similarity"), (-best["first"]).alias("index"))


def detect_churn(vectors: DataFrame, prototypes: DataFrame, threshold: float = CHURN_THRESHOLD, vector: str = "embedding") -> DataFrame:
    """Churn flag, confidence, score and best prototype per row."""
    scored = score_against(vectors, prototypes, "proto_index", vector).withColumn("_best", best_prototype(F.col("scores")))
    return scored.select(
        *vectors.columns,
        rescale_score(F.col("_best.similarity"), threshold).alias("_churn"),
        F.col("_best.index").alias("best_prototype_index"),
        F.transform("scores", lambda s: F.round(s, 4)).alias("prototype_scores"),
    ).select(*vectors.columns, "_churn.*", "best_prototype_index", "prototype_scores")


def top_k_categories(scores: Column, k: int = TOP_K, threshold: float = SIMILARITY_NEEDED) -> Column:
    """Best entries of `array<struct<confidence, pos, …>>`: at or above the threshold, config order on ties."""
    passing = F.filter(scores, lambda s: s["confidence"] >= threshold)
    ordered = F.array_sort(
        passing,
        lambda a, b: F.when(a["confidence"] > b["confidence"], -1)
        .when(a["confidence"] < b["confidence"], 1)
        .otherwise(a["pos"] - b["pos"]),
    )
    return F.slice(ordered, 1, k)


def classify(
    texts: DataFrame,
    categories: DataFrame,
    keywords: DataFrame,
    fallback: str | None = None,
    k: int = TOP_K,
    threshold: float = SIMILARITY_NEEDED,
    vector: str = "embedding",
    text: str = "text",
    in_plan: int = PLAN_REFERENCES,
) -> DataFrame:
    """Add `classes`: up to `k` categories by similarity plus keyword boost, never empty.

    `categories` has `pos, category_id, name, embedding`. Without a category at the threshold
    the fallback one (or the first) stands in with zero confidence. More categories than a plan
    holds are met block by block.
    """
    rows = categories.select("pos", "category_id", "name").orderBy("pos").limit(in_plan + 1).collect()
    if len(rows) > in_plan:
        return classify_by_blocks(texts, categories, keywords, fallback, k, threshold, vector, text)
    scored = match_keywords(score_against(texts, categories, "pos", vector), keywords, text)
    known = F.array(
        *[
            F.struct(F.lit(i).alias("pos"), F.lit(r.category_id).alias("category_id"), F.lit(r.name).alias("name"))
            for i, r in enumerate(rows)
        ]
    )

    def entry(c: Column) -> Column:
        boost = keyword_boost(F.col("matches"), c["name"])
        return F.struct(
            (F.get(F.col("scores"), c["pos"]) + boost).alias("confidence"),
            boost.alias("keyword_boost"),
            c["pos"].alias("pos"),
            c["category_id"].alias("category_id"),
            c["name"].alias("name"),
        )

    stand_in = next((r for r in rows if r.name == fallback), rows[0])
    default = F.array(
        F.struct(
            F.lit(0.0).alias("confidence"),
            F.lit(0.0).alias("keyword_boost"),
            F.lit(rows.index(stand_in)).alias("pos"),
            F.lit(stand_in.category_id).alias("category_id"),
            F.lit(stand_in.name).alias("name"),
        )
    )
    best = top_k_categories(F.transform(known, entry), k, threshold)
    chosen = scored.withColumn("classes", best)
    return chosen.withColumn("classes", F.when(F.size("classes") > 0, F.col("classes")).otherwise(default)).drop("scores", "matches")


def classify_by_blocks(
    texts: DataFrame, categories: DataFrame, keywords: DataFrame, fallback: str | None, k: int, threshold: float, vector: str, text: str
) -> DataFrame:
    """`classify` for any number of categories."""
    kept = categories.select("pos", F.col("category_id").cast("string").alias("category_id"), F.col("name").cast("string").alias("name"), "embedding")
    path = stored_references(kept, "pos", ("category_id", "name"))
    stored = texts.sparkSession.read.parquet(path).select("pos", "category_id", "name")
    stand_in = top_n(stored.select(F.col("name").eqNullSafe(F.lit(fallback)).alias("wanted"), *stored.columns), 1, F.desc("wanted"), F.asc("pos")).first()
    matched = match_keywords(texts, keywords, text)
    boosts = F.transform(
        F.array_distinct(F.transform("matches", lambda m: m["category"])),
        lambda c: F.struct(c.alias("name"), keyword_boost(F.col("matches"), c).alias("boost")),
    )
    default = F.array(
        F.struct(
            F.lit(0.0).alias("confidence"), F.lit(0.0).alias("keyword_boost"), F.lit(stand_in.pos).alias("pos"),
            F.lit(stand_in.category_id).alias("category_id"), F.lit(stand_in.name).alias("name"),
        )
    )
    chosen = with_best(matched.withColumn("_boosts", boosts).drop("matches"), path, k, threshold, vector, "_boosts")
    return chosen.withColumn("classes", F.when(F.size("classes") > 0, F.col("classes")).otherwise(default))


def churn_batch_summary(scored: DataFrame) -> DataFrame:
    """Totals over a scored batch."""
    totals = scored.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_churn").alias("churn"))
    return totals.withColumns(
        {"churn_percent": safe_percent(F.col("churn"), F.col("total")), "clean": F.col("total") - F.col("churn")}
    )


def enrichment_stats(enriched: DataFrame) -> DataFrame:
    """Counters of an enrichment run over `classes, is_churn`."""
    boosted = F.size(F.filter("classes", lambda c: c["keyword_boost"] > 0))
    return enriched.agg(
        F.count(F.lit(1)).alias("classifications"),
        F.sum(boosted).alias("keyword_boosts_applied"),
        F.count("is_churn").alias("churn_detections"),
        F.count_if("is_churn").alias("churn_positives"),
    )


# ---- labels ----------------------------------------------------------------------------------------


def ratio_match(valid: list[str], cutoff: float = FUZZY_NEEDED) -> Callable[[Column], Column]:
    """Labels of a response → valid category names.

    A whole number is a 1-based index; a leading `N. ` is dropped; then the name must match
    exactly or nearly. Each distinct label of a task is matched once.
    """
    names = set(valid)

    def resolve(label: str) -> str | None:
        label = label.strip()
        if re.fullmatch(r"\d+", label):
            index = int(label)
            return valid[index - 1] if 1 <= index <= len(valid) else None
        label = re.sub(r"^\d+\.\s*", "", label).strip()
        if label in names or not label:
            return label or None
        near = difflib.get_close_matches(label, valid, n=1, cutoff=cutoff)
        return near[0] if near else None

    @F.pandas_udf("array<string>")
    def matched(batch: pd.Series) -> pd.Series:
        distinct = pd.unique(batch.explode().dropna())
        found = {label: resolve(label) for label in distinct}
        return batch.map(lambda labels: [found[x] for x in (labels if labels is not None else []) if x is not None and found[x]])

    return matched


def validate_categories(results: DataFrame, valid: DataFrame, labels: str = "labels", default: str = UNCLASSIFIED) -> DataFrame:
    """Replace `labels` by valid category names; a list without any becomes the default."""
    names = [r.name for r in config_rows(valid.select("pos", "name").orderBy("pos"))]
    matched = results.withColumn(labels, ratio_match(names)(F.col(labels)))
    return matched.withColumn(labels, F.when(F.size(labels) > 0, F.col(labels)).otherwise(F.array(F.lit(default))))


def usable_config(categories: DataFrame) -> bool:
    """A changed configuration is taken over only with enough categories."""
    return categories.limit(FEWEST_CATEGORIES).count() >= FEWEST_CATEGORIES
