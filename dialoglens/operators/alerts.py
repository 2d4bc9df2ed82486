"""Alert rules over windowed metrics.

All rules are answered from one aggregation. Rows fall into age classes given by the
distinct windows of the rules; partial sums per class (and product) are then added up for
each rule, on a frame of a few rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from dialoglens.functions.numbers import null_to_zero
from dialoglens.functions.text import pad_free
from dialoglens.functions.timing import clock, since
from dialoglens.operators.filters import HIGH, HIGH_CHURN, check_condition, is_negative, is_positive
from dialoglens.operators.joins import suppress_open, with_subscriber
from dialoglens.operators.skew import small_side
from dialoglens.sources.writers import row_id
from dialoglens.tables import Tables

CRITICAL_CHURN = HIGH
LOW_SATISFACTION = 3
AFFECTED_LIMIT = 100

# fixed values: metrics a rule may watch
METRICS = [
    ("churn", "high_risk_count", "High Risk (70+)", "count"),
    ("churn", "critical_risk_count", "Critical Risk (90+)", "count"),
    ("churn", "avg_churn_score", "Avg Churn Score", "average"),
    ("sentiment", "negative_percent", "Negative %", "percent"),
    ("sentiment", "negative_count", "Negative Count", "count"),
    ("sentiment", "positive_percent", "Positive %", "percent"),
    ("satisfaction", "avg_satisfaction", "Avg Satisfaction", "average"),
    ("satisfaction", "low_satisfaction_count", "Low Satisfaction (<3)", "count"),
    ("ml_quality", "pending_count", "ML Pending", "count"),
    ("operational", "call_volume", "Call Volume", "count"),
    ("operational", "error_count", "Errors", "count"),
]

# fixed values: rules a new installation starts with
DEFAULT_RULES = [
    ("Daily High Risk", "סיכון גבוה יומי", "churn", "high_risk_count", "gt", 25.0, 24.0, None, "WARNING",
     "More than 25 high-risk customers (70+) in 24 hours"),
    ("Critical Churn Surge", "גל נטישה קריטי", "churn", "critical_risk_count", "gt", 10.0, 24.0, None, "CRITICAL",
     "More than 10 critical-risk customers (90+) in 24 hours"),
    ("Negative Sentiment Wave", "גל סנטימנט שלילי", "sentiment", "negative_percent", "gt", 35.0, 24.0, None, "WARNING",
     "Negative sentiment exceeds 35% of daily calls"),
    ("IZI Churn Risk", "סיכון נטישה IZI", "churn", "high_risk_count", "gt", 15.0, 24.0, "IZI", "WARNING",
     "More than 15 IZI customers at high risk in 24 hours"),
    ("Satisfaction Drop", "ירידה בשביעות רצון", "satisfaction", "avg_satisfaction", "lt", 3.0, 24.0, None, "WARNING",
     "Average satisfaction dropped below 3.0"),
    ("ML Backlog", "המלצות ממתינות", "ml_quality", "pending_count", "gte", 5.0, 168.0, None, "INFO",
     "5+ ML recommendations waiting for review"),
]


def metric_catalog(spark) -> DataFrame:
    return spark.createDataFrame(METRICS, "source string, name string, label string, type string")


def default_alert_rules(spark, as_of) -> DataFrame:
    names = (
        "alert_name string, alert_name_he string, metric_source string, metric_name string, condition_operator string, "
        "threshold_value double, time_window_hours double, filter_product string, severity string, description string"
    )
    rules = spark.createDataFrame(DEFAULT_RULES, names)
    return rules.select(
        row_id("alert_name").alias("alert_id"),
        "*",
        F.lit("threshold").alias("alert_type"),
        F.lit(True).alias("is_enabled"),
        clock(as_of).alias("created_at"),
    )


# ---- partial sums --------------------------------------------------------------------------------

_SUMS = ["n", "high", "critical", "negative", "positive", "low_satisfaction", "score_sum", "score_n", "rating_sum", "rating_n"]


def partial_sums() -> list[Column]:
    """What every conversation metric is made of; all of them add up."""
    score, mood, rating = F.col("churn_score"), F.col("sentiment"), F.col("satisfaction")
    return [
        F.count(F.lit(1)).alias("n"),
        F.count_if(score >= HIGH_CHURN).alias("high"),
        F.count_if(score >= CRITICAL_CHURN).alias("critical"),
        F.count_if(is_negative(mood)).alias("negative"),
        F.count_if(is_positive(mood)).alias("positive"),
        F.count_if(rating < LOW_SATISFACTION).alias("low_satisfaction"),
        F.coalesce(F.sum("churn_score"), F.lit(0.0)).alias("score_sum"),
        F.count("churn_score").alias("score_n"),
        F.coalesce(F.sum("satisfaction"), F.lit(0)).cast("double").alias("rating_sum"),
        F.count("satisfaction").alias("rating_n"),
    ]


def added(names: list[str] = _SUMS) -> list[Column]:
    return [F.sum(name).alias(name) for name in names]


def metric_values() -> dict[str, Column]:
    """Metric value from summed parts. Averages and shares of nothing are NULL, counts 0."""
    count = lambda name: null_to_zero(F.col(name)).cast("double")
    share = lambda name: F.round(F.col(name) * 100.0 / F.nullif("n", F.lit(0)), 1)
    return {
        "high_risk_count": count("high"),
        "critical_risk_count": count("critical"),
        "avg_churn_score": F.round(F.col("score_sum") / F.nullif("score_n", F.lit(0)), 1),
        "negative_count": count("negative"),
        "negative_percent": share("negative"),
        "positive_percent": share("positive"),
        "avg_satisfaction": F.round(F.col("rating_sum") / F.nullif("rating_n", F.lit(0)), 2),
        "low_satisfaction_count": count("low_satisfaction"),
        "call_volume": count("n"),
    }


def windows_of(rules: DataFrame) -> list[float]:
    """The different windows of the rules in hours, shortest first."""
    return sorted(r[0] for r in rules.select("time_window_hours").distinct().collect() if r[0] is not None)


def age_class(df: DataFrame, time_col: str, windows: list[float], as_of) -> DataFrame:
    """Add `age`, the number of the shortest window that still contains the row; rows older than all are dropped.

    The bounds are searched by halves, so the number of windows hardly matters.
    """
    recent = since(df, time_col, windows[-1] / 24 if windows else 0, as_of)
    # microseconds as in the filter: a row is inside a window while it is younger than it
    micros = F.unix_micros(clock(as_of)) - F.unix_micros(F.col(time_col).cast("timestamp"))
    bounds = sorted({round(hours * 3600, 6) * 1_000_000 for hours in windows}) or [0.0]
    search = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol="_micros", outputCol="_age", handleInvalid="keep")
    aged = search.transform(recent.withColumn("_micros", micros.cast("double")))
    return aged.withColumn("age", F.col("_age").cast("int")).filter(F.col("age") < len(bounds)).drop("_micros", "_age")


def with_age_of_window(rules: DataFrame, windows: list[float]) -> DataFrame:
    """Add `age`, the number of the rule's window."""
    bounds = sorted({round(hours * 3600, 6) for hours in windows})
    numbers = [(hours, bounds.index(round(hours * 3600, 6))) for hours in windows] if len(bounds) < len(windows) else list(zip(windows, range(len(windows)), strict=True))
    numbered = rules.sparkSession.createDataFrame(numbers, "time_window_hours double, age int")
    return rules.join(small_side(numbered), "time_window_hours", "left")


def summed_for_rules(rules: DataFrame, parts: DataFrame, sums: list[str]) -> DataFrame:
    """Rules (`age`, `product`) with the sums of all parts of their product that are no older than their window.

    One running sum over both, in place of a comparison of every rule with every part.
    """
    both = rules.withColumn("_rule", F.lit(True)).unionByName(parts.select("age", "product", *sums), allowMissingColumns=True)
    so_far = Window.partitionBy("product").orderBy("age").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumns({name: F.sum(name).over(so_far) for name in sums}).filter("_rule").drop("_rule")


def conversation_parts(db: Tables, rules: DataFrame, windows: list[float]) -> DataFrame:
    """`age, product` and partial sums; product NULL stands for all conversations.

    Accounts are summed before they meet the products they own, so an account with very
    many conversations is one row by then.
    """
    aged = age_class(db.conversation_summary, "conversation_time", windows, db.as_of)
    return product_parts(aged.groupBy("age", "ban").agg(*partial_sums()), db.subscriber, rules)


def product_parts(by_account: DataFrame, subscriber: DataFrame, rules: DataFrame) -> DataFrame:
    """Sums per age class and account → per age class, and per age class and watched product.

    An account lists the watched products it owns, at most as many as the rules name.
    """
    watched = rules.filter("filter_product is not null").select(F.col("filter_product").alias("product_code")).distinct()
    owners = (
        subscriber.select(F.col("customer_ban").alias("ban"), "product_code")
        .join(watched, "product_code", "left_semi")
        .groupBy("ban")
        .agg(F.collect_set("product_code").alias("_owned"))
    )
    everything = F.array(F.lit(None).cast("string"))
    counted_for = F.concat(everything, F.coalesce("_owned", F.array().cast("array<string>")))
    listed = by_account.join(owners, "ban", "left").withColumn("product", F.explode(counted_for))
    return listed.groupBy("age", "product").agg(*added())


def conversation_metrics(rules: DataFrame, parts: DataFrame, windows: list[float]) -> DataFrame:
    """Value of each rule on conversations, from parts no older than its window."""
    values = metric_values()
    known = list(values)
    asked = rules.filter(F.col("metric_name").isin(known)).select("alert_id", "metric_name", "time_window_hours", F.col("filter_product").alias("product"))
    summed = summed_for_rules(with_age_of_window(asked, windows), parts, _SUMS)
    picked = reduce(lambda rest, name: F.when(F.col("metric_name") == name, values[name]).otherwise(rest), known, F.lit(None).cast("double"))
    return summed.select("alert_id", picked.alias("metric_value"))


def error_metrics(db: Tables, rules: DataFrame, windows: list[float]) -> DataFrame:
    counts = age_class(db.error_log, "error_timestamp", windows, db.as_of).groupBy("age").agg(F.count(F.lit(1)).alias("n"))
    asked = rules.filter("metric_name = 'error_count'").select("alert_id", "time_window_hours", F.lit(None).cast("string").alias("product"))
    summed = summed_for_rules(with_age_of_window(asked, windows), counts.withColumn("product", F.lit(None).cast("string")), ["n"])
    return summed.select("alert_id", null_to_zero(F.col("n")).cast("double").alias("metric_value"))


def quality_metrics(db: Tables, rules: DataFrame) -> DataFrame:
    """Backlog of recommendations and the recall of the latest evaluation; no window."""
    pending = db.recommendations.filter("status = 'PENDING'").agg(F.count(F.lit(1)).cast("double")).scalar()
    recall = db.evaluation_history.agg(
        F.max_by(F.col("recall_rate").cast("double"), F.struct("eval_date", "eval_id"))
    ).scalar()
    asked = rules.filter("metric_name in ('pending_count', 'recall_rate')")
    return asked.select("alert_id", F.when(F.col("metric_name") == "pending_count", pending).otherwise(recall).alias("metric_value"))


def rule_values(db: Tables, rules: DataFrame, partials: DataFrame | None = None) -> DataFrame:
    """`alert_id, metric_value` of every enabled rule with a known metric.

    `partials` are stored sums per 5-minute slot and account; with them no conversation is read.
    """
    windows = windows_of(rules)
    if partials is None:
        parts = conversation_parts(db, rules, windows)
    else:
        aged = age_class(partials, "slot_end", windows, db.as_of)
        parts = product_parts(aged.groupBy("age", "ban").agg(*added()), db.subscriber, rules)
    return (
        conversation_metrics(rules, parts, windows)
        .unionByName(error_metrics(db, rules, windows))
        .unionByName(quality_metrics(db, rules))
    )


def evaluate_alerts(db: Tables, rules: DataFrame | None = None, partials: DataFrame | None = None) -> DataFrame:
    """All enabled threshold rules: value, triggered, already_active, created."""
    rules = db.alert_rules if rules is None else rules
    active = rules.filter("is_enabled and alert_type = 'threshold'")
    judged = active.join(rule_values(db, active, partials), "alert_id", "left").withColumn(
        "triggered",
        check_condition(F.col("metric_value"), F.col("condition_operator"), F.col("threshold_value")),
    )
    flagged = suppress_open(judged, db.alert_history)
    open_already = F.col("triggered") & F.col("already_active")
    return flagged.select(
        "alert_id",
        "alert_name",
        "metric_source",
        "metric_name",
        "time_window_hours",
        "filter_product",
        "severity",
        "metric_value",
        F.col("threshold_value").alias("threshold"),
        "triggered",
        open_already.alias("already_active"),
        (F.col("triggered") & ~F.col("already_active")).alias("created"),
    )


def run_counts(evaluated: DataFrame) -> DataFrame:
    return evaluated.agg(
        F.count(F.lit(1)).alias("evaluated"),
        F.count_if("triggered").alias("triggered"),
        F.count_if("created").alias("created"),
        F.count_if("already_active").alias("already_active"),
    )


# ---- affected subscribers ---------------------------------------------------------------------------

_COUNTED = {
    "high_risk_count": lambda: F.col("churn_score") >= HIGH_CHURN,
    "critical_risk_count": lambda: F.col("churn_score") >= CRITICAL_CHURN,
    "negative_count": lambda: is_negative(F.col("sentiment")),
    "low_satisfaction_count": lambda: F.col("satisfaction") < LOW_SATISFACTION,
}


def count_rules(rules: DataFrame) -> DataFrame:
    return rules.filter(F.col("metric_name").isin(list(_COUNTED))).select(
        "alert_id", "metric_name", "time_window_hours", F.col("filter_product").alias("product")
    )


def matching_rows(db: Tables, asked: DataFrame, windows: list[float]) -> DataFrame:
    """Conversations with each metric that counts them, their age class, and each product that rules ask for (NULL: any).

    Rules don't multiply rows: a conversation comes once for each metric and watched product of its account.
    """
    metrics = F.filter(
        F.array(*[F.when(counted(), F.lit(name)) for name, counted in _COUNTED.items()]), lambda name: name.isNotNull()
    )
    recent = age_class(db.conversation_summary, "conversation_time", windows, db.as_of).withColumn("metric_name", F.explode(metrics))
    watched = asked.filter("product is not null").select(F.col("product").alias("product_code")).distinct()
    owned = db.subscriber.join(watched, "product_code", "left_semi").select(F.col("customer_ban").alias("ban"), F.col("product_code").alias("product")).distinct()
    return recent.withColumn("product", F.lit(None).cast("string")).unionByName(recent.join(owned, "ban").select(*recent.columns, "product"))


def for_rules(classes: DataFrame, asked: DataFrame, windows: list[float]) -> DataFrame:
    """Rows of metric, product and age classes for every rule whose window contains their class."""
    wanted = with_age_of_window(asked, windows).select(
        "alert_id", F.col("metric_name").alias("_metric"), F.col("product").alias("_product"), F.col("age").alias("_longest")
    )
    fits = (F.col("metric_name") == F.col("_metric")) & F.col("product").eqNullSafe(F.col("_product")) & (F.col("age") <= F.col("_longest"))
    return classes.join(wanted, fits).drop("_metric", "_product", "_longest")


def affected_counts(db: Tables, rules: DataFrame) -> DataFrame:
    """How many rows the whole list of each count rule has: counted by class, then summed for the rules."""
    asked = count_rules(rules)
    windows = windows_of(asked)
    counted = with_subscriber(matching_rows(db, asked, windows), db.subscriber).groupBy("metric_name", "product", "age").agg(F.count(F.lit(1)).alias("n"))
    return for_rules(counted, asked, windows).groupBy("alert_id").agg(F.sum("n").alias("affected"))


def affected_by_rule(db: Tables, rules: DataFrame, limit: int = AFFECTED_LIMIT) -> DataFrame:
    """The leading conversations behind each count rule, with subscriber status.

    Order: score for churn, newest for sentiment, lowest rating for satisfaction. Only `limit` rows of each class of
    metric, product and age leave a task, and only these meet the rules.
    """
    asked = count_rules(rules)
    windows = windows_of(asked)
    matching = matching_rows(db, asked, windows)
    order = [
        F.desc_nulls_last(F.when(F.col("metric_name").isin("high_risk_count", "critical_risk_count"), F.col("churn_score"))),
        F.asc_nulls_last(F.when(F.col("metric_name") == "low_satisfaction_count", F.col("satisfaction"))),
        F.desc_nulls_last("conversation_time"),
        F.asc("source_id"),
        F.asc("source_type"),
    ]

    def leading(df: DataFrame, keys: list[str], *extra: Column) -> DataFrame:
        position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *extra))
        return df.withColumn("position", position).filter(F.col("position") <= limit)

    few = leading(matching, ["metric_name", "product", "age"]).drop("position")
    # a join that may repeat rows comes after the first cut of a rule and before the second
    named = with_subscriber(leading(for_rules(few, asked, windows), ["alert_id"]), db.subscriber)
    return leading(named, ["alert_id"], F.asc("sub_status"), F.asc("product_code")).select(
        "alert_id",
        "position",
        "source_id",
        pad_free(F.col("subscriber_no")).alias("subscriber_no"),
        "ban",
        "churn_score",
        "sentiment",
        "satisfaction",
        F.col("conversation_time").alias("call_time"),
        "product_code",
        "sub_status",
    )


def alert_history_rows(db: Tables, evaluated: DataFrame, affected: DataFrame, counts: DataFrame) -> DataFrame:
    """New history rows for created alerts: the leading subscribers and how many there are in all."""
    lists = affected.groupBy("alert_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct("position", "subscriber_no", "ban", "churn_score", "call_time", "product_code", "sub_status")
            )
        ).alias("_rows")
    )
    created = evaluated.filter("created").join(lists, "alert_id", "left").join(counts, "alert_id", "left")
    shape = "array<struct<subscriber_no:string,ban:string,churn_score:double,call_time:timestamp,product_code:string,sub_status:string>>"
    people = F.transform("_rows", lambda r: r.dropFields("position")).cast(shape)
    return created.select(
        row_id("alert_id", F.lit(str(db.as_of))).alias("history_id"),
        "alert_id",
        clock(db.as_of).alias("triggered_at"),
        "metric_value",
        F.col("threshold").alias("threshold_value"),
        "severity",
        F.lit("ACTIVE").alias("status"),
        F.coalesce(people, F.array().cast(shape)).alias("affected_subscribers"),
        F.coalesce("affected", F.lit(0)).cast("int").alias("affected_count"),
    )


def alert_summary(db: Tables) -> DataFrame:
    open_alerts = db.alert_history.filter("status = 'ACTIVE'").agg(
        F.count(F.lit(1)).alias("active_count"), F.count_if(F.col("severity") == "CRITICAL").alias("critical_count")
    )
    rules = db.alert_rules.agg(F.count_if("is_enabled")).scalar()
    lately = since(db.alert_history, "triggered_at", 1, db.as_of).agg(F.count(F.lit(1))).scalar()
    return open_alerts.withColumns({"enabled_rules": rules, "alerts_24h": lately})


def metric_overview(db: Tables, hours: float = 24) -> DataFrame:
    """Every available metric with its value over the last `hours`."""
    catalog = metric_catalog(db.spark)
    rules = catalog.select(
        F.col("name").alias("alert_id"),
        F.col("name").alias("metric_name"),
        F.lit(float(hours)).alias("time_window_hours"),
        F.lit(None).cast("string").alias("filter_product"),
    )
    return catalog.join(rule_values(db, rules).withColumnRenamed("alert_id", "name"), "name", "left")


def single_metric(db: Tables, name: str, hours: float, product: str | None = None) -> DataFrame:
    """One metric as a one-row frame, through the same path as the rules."""
    rule = db.spark.createDataFrame(
        [(name, name, float(hours), product)],
        "alert_id string, metric_name string, time_window_hours double, filter_product string",
    )
    return rule_values(db, rule).select(F.col("alert_id").alias("metric"), F.col("metric_value").alias("value"))
