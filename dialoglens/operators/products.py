"""Products and queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dialoglens.functions.numbers import null_to_zero
from dialoglens.functions.text import normalize_product, not_blank, split_csv
from dialoglens.functions.timing import DATE, fmt_ts, since, trunc_day
from dialoglens.operators.categories import top_n
from dialoglens.operators.filters import has_products, with_display_product
from dialoglens.operators.joins import call_type_filter, conversations
from dialoglens.operators.kpi import rounded_avg
from dialoglens.session import materialize
from dialoglens.tables import Tables


def mentions_of_days(db: Tables, days: float, call_type: str) -> DataFrame:
    """Mentions per day and normalised product; NULL stands for texts and parts that name none.

    Equal raw strings are counted before they are split. Every day with a product text has a row.
    """
    day = fmt_ts(trunc_day(F.col("conversation_time")), DATE).alias("call_date")
    raw = has_products(conversations(db, days, call_type)).groupBy(day, "products").agg(F.count(F.lit(1)).alias("n"))
    named = raw.select("call_date", "n", F.explode_outer(split_csv(F.col("products"))).alias("raw")).select(
        "call_date", "n", normalize_product(F.col("raw")).alias("product")
    )
    return named.groupBy("call_date", "product").agg(F.sum("n").alias("count"))


def product_mentions(db: Tables, days: float = 30, call_type: str = "service") -> DataFrame:
    """Mentions per day and normalised product."""
    return mentions_of_days(db, days, call_type).filter("product is not null")


def product_totals(db: Tables, days: float = 30, call_type: str = "service") -> DataFrame:
    return product_mentions(db, days, call_type).groupBy("product").agg(F.sum("count").alias("total"))


def products_daily(db: Tables, days: float = 30, top: int = 5, call_type: str = "service") -> DataFrame:
    """Daily series of the most mentioned products, 0 on days without a mention.

    The day list holds every day with a product text, also a junk one. The counts are written once and read three times.
    """
    counted = materialize(mentions_of_days(db, days, call_type), "mentions")
    mentions = counted.filter("product is not null")
    totals = mentions.groupBy("product").agg(F.sum("count").alias("total"))
    best = top_n(totals, top, F.desc("total"), F.asc("product"))
    dates = counted.select("call_date").distinct()
    # one row per day, each with the handful of leading products
    leaders = best.agg(F.collect_list("product")).scalar()
    grid = dates.select("call_date", F.explode(leaders).alias("product"))
    series = grid.join(mentions, ["call_date", "product"], "left").join(best, "product")
    return series.select("call_date", "product", null_to_zero(F.col("count")).alias("count"), "total").orderBy(
        F.desc("total"), "product", "call_date"
    )


def product_performance(db: Tables, days: float = 7, limit: int = 10, call_type: str = "service") -> DataFrame:
    by_product = (
        has_products(conversations(db, days, call_type))
        .groupBy("products")
        .agg(
            F.count(F.lit(1)).alias("call_count"),
            rounded_avg("satisfaction", 1).alias("avg_satisfaction"),
            rounded_avg("churn_score", 0).alias("avg_churn_score"),
        )
    )
    top = with_display_product(top_n(by_product, limit, F.desc("call_count"), F.asc("products")))
    return top.withColumnRenamed("products", "queue_name")


def queue_distribution(
    db: Tables, days: float = 1, limit: int = 15, call_type: str = "service", segment_weighted: bool = False
) -> DataFrame:
    """Calls and averages per queue. A call counts once; `segment_weighted` lets each segment count.

    Segments shrink to one row per queue and call before the join; their number is the weight.
    """
    recent = since(db.segments, "call_time", days, db.as_of).filter(not_blank(F.col("queue_name")))
    per_call = recent.groupBy("queue_name", F.col("call_id").cast("string").alias("call_id")).agg(
        F.count(F.lit(1)).alias("segments")
    )
    cs = db.conversation_summary.select("source_id", "satisfaction", "churn_score")
    # a filter on the summary leaves only calls that have one
    filtered = call_type not in (None, "all")
    joined = per_call.join(
        call_type_filter(cs, db, call_type, days, db.as_of),
        per_call["call_id"] == cs["source_id"],
        "inner" if filtered else "left",
    )
    weight = F.col("segments") if segment_weighted else F.lit(1)

    def average(name: str, places: int):
        known = F.sum(F.when(F.col(name).isNotNull(), weight))
        return F.round(F.sum(F.col(name) * weight) / known, places)

    queues = joined.groupBy("queue_name").agg(
        F.countDistinct("call_id").alias("call_count"),
        average("satisfaction", 1).alias("avg_satisfaction"),
        null_to_zero(average("churn_score", 0)).alias("avg_churn_score"),
    )
    return top_n(queues, limit, F.desc("call_count"), F.asc("queue_name"))
