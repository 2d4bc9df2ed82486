"""Category counts and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dialoglens.functions.timing import since
from dialoglens.operators.joins import category_join, conversations
from dialoglens.operators.skew import number_rows
from dialoglens.tables import Tables


def category_counts(db: Tables, days: float = 7, call_type: str = "service") -> DataFrame:
    joined = category_join(db.conversation_category, conversations(db, days, call_type).select("source_id", "source_type"))
    return joined.groupBy(F.col("category_code").alias("category")).agg(F.count(F.lit(1)).alias("count"))


def top_categories(db: Tables, days: float = 7, limit: int = 15, call_type: str = "service") -> DataFrame:
    return top_n(category_counts(db, days, call_type), limit, F.desc("count"), F.asc("category"))


def top_categories_plain(db: Tables, days: float = 7, limit: int = 15) -> DataFrame:
    """Older form: by creation date of the category rows, without the conversations."""
    recent = since(db.conversation_category, "creation_date", days, db.as_of)
    counts = recent.groupBy(F.col("category_code").alias("category")).agg(F.count(F.lit(1)).alias("count"))
    return top_n(counts, limit, F.desc("count"), F.asc("category"))


def categories_overview(db: Tables, days: float = 7, call_type: str = "service") -> DataFrame:
    """One row: conversations, categories, assignments, average and the most frequent category.

    One pass over the joined rows: they are grouped by category and by conversation at once.
    """
    joined = category_join(db.conversation_category, conversations(db, days, call_type).select("source_id", "source_type"))
    sets = joined.groupingSets([["category_code"], ["source_id"]], "category_code", "source_id")
    groups = sets.agg(F.count(F.lit(1)).alias("n"), (F.grouping("source_id") == 1).alias("of_category"))
    of_category = F.col("of_category")
    stats = groups.agg(
        F.count_if(~of_category & F.col("source_id").isNotNull()).alias("total_conversations"),
        F.count_if(of_category & F.col("category_code").isNotNull()).alias("unique_categories"),
        F.coalesce(F.sum(F.when(of_category, F.col("n"))), F.lit(0)).alias("total_category_assignments"),
        # most rows first, then the first name
        F.min_by("category_code", F.when(of_category, F.struct(-F.col("n"), "category_code"))).alias("top_category"),
    )
    average = F.coalesce(F.round(F.col("total_category_assignments") / F.nullif("total_conversations", F.lit(0)), 2), F.lit(0.0))
    return stats.select(
        "total_conversations", "unique_categories", "total_category_assignments", average.alias("avg_per_conversation"),
        F.coalesce("top_category", F.lit("-")).alias("top_category"),
    )


def share_of_total(counts: DataFrame, value: str, places: int = 1) -> DataFrame:
    """Share of each row in the sum over all rows, which is read as a scalar."""
    total = counts.agg(F.sum(value)).scalar()
    return counts.withColumn("percent", F.coalesce(F.round(F.col(value) * 100 / F.nullif(total, F.lit(0)), places), F.lit(0.0)))


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def rank_rows(df: DataFrame, *order: Column, limit: int | None = None) -> DataFrame:
    """1-based rank. A limited list is small enough for one window; a whole one is numbered in parts."""
    if limit is None:
        return number_rows(df, *order)
    return top_n(df, limit, *order).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
