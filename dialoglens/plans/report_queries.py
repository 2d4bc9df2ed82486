"""Reports, distributions, drill-downs and lookups."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from dialoglens.functions import timing
from dialoglens.operators import calls, categories, churn, customers, filters, joins, kpi, products, repeat
from dialoglens.plans.registry import of_kind, query, recent

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
MIN = "'%Y-%m-%d %H:%M'"
SEC = "'%Y-%m-%d %H:%M:%S'"


def base(days: float, kind: str = "service", time_col: str = "conversation_time") -> str:
    """FROM and WHERE of the conversations a report looks at."""
    where = recent(time_col, days)
    return f"FROM cs WHERE {where}" + ("" if kind == "all" else f" AND {of_kind(kind, days)}")


LINE = (
    f"source_id AS call_id, source_type AS type, strftime(conversation_time, {MIN}) AS created, "
    "summary, sentiment, satisfaction, round(churn_score, 1) AS churn_score"
)
LINE_FULL = LINE + ", products, action_items"
NEWEST = "ORDER BY conversation_time DESC, source_id, source_type"
RISKIEST = "ORDER BY cs.churn_score DESC NULLS LAST, conversation_time DESC, source_id, source_type"

# ---- key figures -----------------------------------------------------------------------------

KPIS = """SELECT count(*) AS total, count(*) FILTER (source_type = 'CALL') AS calls,
  count(*) FILTER (source_type = 'WAPP') AS whatsapp,
  round(avg(satisfaction), 2) AS avg_satisfaction, round(avg(churn_score), 2) AS avg_churn_score,
  {} """
NUMERIC_MOODS = """count(*) FILTER (sentiment > 3) AS positive, count(*) FILTER (sentiment < 3) AS negative,
  count(*) FILTER (coalesce(sentiment, 3) = 3) AS neutral"""

for _kind in ("service", "sales", "all"):
    query(
        "A01_summary_kpis" if _kind == "service" else f"A01_summary_kpis_{_kind}",
        KPIS.format(NUMERIC_MOODS) + base(7, _kind),
    )(lambda db, kind=_kind: kpi.summary_kpis(db, 7, kind))

query(
    "A02_summary_kpis_text",
    KPIS.format(
        """count(*) FILTER (contains(lower(sentiment_text), 'positive')) AS positive,
  count(*) FILTER (contains(lower(sentiment_text), 'negative')) AS negative,
  count(*) FILTER (sentiment_text IS NULL OR sentiment_text = 'neutral') AS neutral"""
    )
    + base(7, "all", "creation_date"),
)(lambda db: kpi.summary_kpis_text(db))

query(
    "A03_sentiment_breakdown",
    f"SELECT if(coalesce(sentiment, 3) < 3, 'Negative', 'Other') AS sentiment, count(*) AS count {base(7)} GROUP BY 1",
)(lambda db: kpi.sentiment_breakdown(db))

query(
    "A04_sentiment_breakdown_3",
    "SELECT CASE lower(coalesce(sentiment_text, 'neutral')) WHEN 'positive' THEN 'Positive' "
    "WHEN 'negative' THEN 'Negative' ELSE 'Neutral' END AS sentiment, count(*) AS count "
    f"{base(7, 'all', 'creation_date')} GROUP BY 1",
)(lambda db: kpi.sentiment_breakdown_3(db))

query(
    "A05_churn_distribution",
    "SELECT if(churn_score < 95, 'High Risk (90-94)', 'Critical (95-100)') AS risk_level, count(*) AS count "
    f"{base(7)} AND churn_score >= 90 GROUP BY 1",
)(lambda db: kpi.churn_distribution(db))

query(
    "A06_churn_distribution_3",
    "SELECT if(coalesce(churn_score, 0) < 40, 'Low', if(churn_score < 70, 'Medium', 'High')) AS risk_level, "
    f"count(*) AS count {base(7, 'all', 'creation_date')} GROUP BY 1",
)(lambda db: kpi.churn_distribution_3(db))

query(
    "A07_satisfaction_distribution",
    f"SELECT satisfaction AS rating, count(*) AS count {base(7)} AND satisfaction IS NOT NULL GROUP BY 1",
)(lambda db: kpi.satisfaction_distribution(db))

query(
    "A08_daily_trend",
    "SELECT strftime(conversation_time, '%Y-%m-%d') AS call_date, count(*) AS count, "
    f"round(avg(satisfaction), 2) AS avg_satisfaction, round(avg(churn_score), 2) AS avg_churn {base(30)} GROUP BY 1",
)(lambda db: kpi.daily_trend(db))

# ---- categories --------------------------------------------------------------------------------

BY_CATEGORY = (
    "SELECT category_code AS category, count(*) AS count FROM cat JOIN cs USING (source_id, source_type) "
    f"WHERE {recent('conversation_time', 7)} AND {of_kind('service', 7)} GROUP BY 1"
)
query("A09_top_categories", f"{BY_CATEGORY} ORDER BY count DESC, category LIMIT 15")(
    lambda db: categories.top_categories(db)
)
query(
    "A09_top_categories_plain",
    f"SELECT category_code AS category, count(*) AS count FROM cat WHERE {recent('creation_date', 7)} "
    "GROUP BY 1 ORDER BY count DESC, category LIMIT 15",
)(lambda db: categories.top_categories_plain(db))
query("A10_category_counts", BY_CATEGORY)(lambda db: categories.category_counts(db))
query(
    "A10_categories_overview",
    f"""WITH j AS (SELECT source_id, category_code FROM cat JOIN cs USING (source_id, source_type)
      WHERE {recent('conversation_time', 7)} AND {of_kind('service', 7)})
    SELECT count(DISTINCT source_id) AS total_conversations, count(DISTINCT category_code) AS unique_categories,
      count(*) AS total_category_assignments,
      round(count(*) / nullif(count(DISTINCT source_id), 0), 2) AS avg_per_conversation,
      (SELECT category_code FROM j GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_category FROM j""",
)(lambda db: categories.categories_overview(db))
query(
    "A11_share_of_total",
    f"SELECT category, count, round(count * 100 / sum(count) OVER (), 1) AS percent FROM ({BY_CATEGORY})",
)(lambda db: categories.share_of_total(categories.category_counts(db), "count"))
query(
    "W06_rank_rows",
    f"SELECT *, row_number() OVER (ORDER BY count DESC, category) AS rank FROM ({BY_CATEGORY})",
)(lambda db: categories.rank_rows(categories.category_counts(db), F.desc("count"), F.asc("category")))
query(
    "L01_top_n",
    "SELECT source_id, churn_score FROM cs ORDER BY churn_score DESC NULLS LAST, source_id LIMIT 25",
)(
    lambda db: categories.top_n(
        db.conversation_summary.select("source_id", "churn_score"), 25, F.desc_nulls_last("churn_score"), F.asc("source_id")
    )
)

# ---- trends ---------------------------------------------------------------------------------------

query(
    "A12_call_heatmap",
    f"""WITH cells AS (SELECT dayofweek(conversation_time) AS day_of_week, hour(conversation_time) AS hour,
      count(*) AS count {base(30)} GROUP BY 1, 2)
    SELECT *, (SELECT max(count) FROM cells) AS max_count FROM cells""",
)(lambda db: kpi.call_heatmap(db))


def _trend_sql() -> str:
    now = f"conversation_time > {AS_OF} - INTERVAL 7 DAY AND {of_kind('service', 7)}"
    before = (
        f"conversation_time BETWEEN {AS_OF} - INTERVAL 14 DAY AND {AS_OF} - INTERVAL 7 DAY AND {of_kind('service', 14)}"
    )
    one = """SELECT count(*) AS total_calls, coalesce(round(avg(satisfaction), 2), 0) AS avg_satisfaction,
      coalesce(round(avg(churn_score), 1), 0) AS avg_churn_score, count(*) FILTER (sentiment > 3) AS positive,
      count(*) FILTER (sentiment < 3) AS negative, count(*) FILTER (coalesce(sentiment, 3) = 3) AS neutral,
      count(*) FILTER (churn_score >= 70) AS high_risk_count,
      coalesce(round(count(*) FILTER (sentiment > 3) * 100 / nullif(count(*), 0), 1), 0) AS positive_percent,
      strftime(min(conversation_time), '%Y-%m-%d') AS first_day, strftime(max(conversation_time), '%Y-%m-%d') AS last_day
      FROM cs WHERE """
    names = [
        "total_calls", "avg_satisfaction", "avg_churn_score", "positive", "negative", "neutral", "high_risk_count",
        "positive_percent",
    ]
    out = [
        "c.first_day AS current_start", "c.last_day AS current_end", "p.first_day AS previous_start",
        "p.last_day AS previous_end",
    ]
    for n in names:
        out += [
            f"c.{n} AS current_{n}", f"p.{n} AS previous_{n}",
            f"round(c.{n}::DOUBLE - p.{n}, 2) AS delta_{n}_value",
            f"CASE WHEN p.{n} = 0 THEN if(c.{n} > 0, 100, 0) ELSE round((c.{n}::DOUBLE - p.{n}) * 100 / p.{n}, 1) END "
            f"AS delta_{n}_percent",
            f"CASE sign(c.{n}::DOUBLE - p.{n}) WHEN 1 THEN 'up' WHEN -1 THEN 'down' ELSE 'same' END AS delta_{n}_direction",
        ]
    return f"WITH c AS ({one} {now}), p AS ({one} {before}) SELECT {', '.join(out)} FROM c, p"


query("A13_trend_comparison", _trend_sql())(lambda db: kpi.flat_deltas(kpi.trend_comparison(db)))

PRODUCT_NAME = (
    "CASE trim(raw) WHEN 'iPhone 7' THEN 'iphone 17' WHEN 'iphone 12' THEN 'iphone 17' "
    "WHEN 'Galaxy  S9' THEN 'Galaxy S9' WHEN 'N/A' THEN NULL WHEN '' THEN NULL ELSE trim(raw) END"
)
MENTIONS = f"""ment AS (SELECT call_date, {PRODUCT_NAME} AS product FROM (
      SELECT strftime(conversation_time, '%Y-%m-%d') AS call_date, unnest(string_split(products, ',')) AS raw {base(30)}))"""
query(
    "A14_products_daily",
    f"""WITH {MENTIONS},
    best AS (SELECT product, count(*) AS total FROM ment WHERE product IS NOT NULL GROUP BY 1
      ORDER BY total DESC, product LIMIT 5),
    days AS (SELECT DISTINCT strftime(conversation_time, '%Y-%m-%d') AS call_date {base(30)} AND trim(products) <> '')
    SELECT d.call_date, b.product, b.total, (SELECT count(*) FROM ment m WHERE m.product = b.product
      AND m.call_date = d.call_date) AS count FROM days d, best b""",
)(lambda db: products.products_daily(db))
query(
    "A14_product_totals",
    f"WITH {MENTIONS} SELECT product, count(*) AS total FROM ment WHERE product IS NOT NULL GROUP BY 1",
)(lambda db: products.product_totals(db))
query(
    "A15_product_performance",
    f"""SELECT products AS queue_name, CASE products WHEN 'iPhone 7' THEN 'iphone 17'
      WHEN 'iphone 12, Galaxy  S9' THEN 'iphone 17, Galaxy S9' ELSE products END AS display_name,
      count(*) AS call_count, round(avg(satisfaction), 1) AS avg_satisfaction,
      round(avg(churn_score), 0) AS avg_churn_score
      {base(7)} AND trim(products) <> '' GROUP BY products ORDER BY call_count DESC, products LIMIT 10""",
)(lambda db: products.product_performance(db))


def _queue_sql(days: float, weighted: bool) -> str:
    rows = "" if weighted else "DISTINCT"
    return f"""WITH s AS (SELECT {rows} queue_name, call_id FROM seg WHERE {recent('call_time', days)}
      AND trim(queue_name) <> '')
    SELECT queue_name, count(DISTINCT call_id) AS call_count, round(avg(satisfaction), 1) AS avg_satisfaction,
      coalesce(round(avg(churn_score), 0), 0) AS avg_churn_score
    FROM s JOIN cs ON call_id = source_id WHERE {of_kind('service', days)}
    GROUP BY 1 ORDER BY call_count DESC, queue_name LIMIT 15"""


query("A16_queue_distribution", _queue_sql(1, False))(lambda db: products.queue_distribution(db))
query("A16_queue_distribution_weighted", _queue_sql(7, True))(
    lambda db: products.queue_distribution(db, 7, segment_weighted=True)
)

# ---- repeat callers ----------------------------------------------------------------------------------

CALLERS = (
    "SELECT subscriber_no, ban, count(*) AS call_count, max(churn_score) AS max_churn_score, "
    f"strftime(max(conversation_time), {MIN}) AS last_call {base(1)} AND trim(subscriber_no) <> '' GROUP BY 1, 2"
)
BUCKETS = f"""SELECT n AS bucket_order, n || if(n = 6, '+', '') || ' calls' AS label, count(call_count) AS count,
    count(*) FILTER (max_churn_score >= 70) AS high_risk
    FROM range(2, 7) r(n) LEFT JOIN ({CALLERS}) c ON least(call_count, 6) = n GROUP BY n"""
query("A17_repeat_caller_buckets", BUCKETS)(lambda db: repeat.repeat_caller_buckets(db))
query(
    "A18_repeat_caller_list",
    f"SELECT * FROM ({CALLERS}) WHERE call_count BETWEEN 2 AND 4 AND max_churn_score >= 70 "
    "ORDER BY call_count DESC, max_churn_score DESC NULLS LAST, subscriber_no, ban LIMIT 100",
)(lambda db: repeat.repeat_caller_list(db, 2, 4, True))
query(
    "A19_top_repeat_callers",
    f"SELECT * FROM ({CALLERS}) WHERE call_count >= 7 ORDER BY call_count DESC, subscriber_no, ban LIMIT 10",
)(lambda db: repeat.top_repeat_callers(db))
query("A20_bucket_low_risk", f"SELECT *, count - high_risk AS low_risk FROM ({BUCKETS})")(
    lambda db: repeat.bucket_low_risk(repeat.repeat_caller_buckets(db))
)

# ---- churn -----------------------------------------------------------------------------------------------

FLAGGED = f"SELECT * {base(180)} AND churn_score >= 70"
CHURNED = "(rtrim(subscriber_no), customer_ban) IN (SELECT (subscriber_no, ban) FROM f) AND sub_status = 'C'"
query(
    "A21_churn_accuracy",
    f"""WITH f AS ({FLAGGED}), n AS (SELECT (SELECT count(*) FROM f) AS total_predictions,
      (SELECT count(*) FROM sub WHERE {CHURNED}) AS actual_churns,
      (SELECT count(DISTINCT (subscriber_no, ban)) FROM f) AS flagged_subscribers)
    SELECT *, round(actual_churns * 100 / total_predictions, 1) AS accuracy_rate,
      total_predictions - actual_churns AS false_positives FROM n""",
)(lambda db: churn.churn_accuracy(db))
query(
    "A22_churn_by_product",
    f"WITH f AS ({FLAGGED}) SELECT product_code, count(*) AS count FROM sub WHERE {CHURNED} GROUP BY 1",
)(lambda db: churn.churn_by_product(db))


def _bands_sql(bands, strict: bool, kind: str, days: float, within: float | None) -> str:
    uppers = [b.high if strict or i == 0 else bands[i - 1].low for i, b in enumerate(bands)]
    less = ["<=" if strict or i == 0 else "<" for i in range(len(bands))]
    parts = []
    for b, upper, op in zip(bands, uppers, less):
        inside = f"churn_score >= {b.low}" + ("" if not strict and op == "<=" else f" AND churn_score {op} {upper}")
        lately = "" if within is None else f" AND {recent('sub_status_date', within)}"
        parts.append(
            f"""SELECT '{b.label}' AS label, '{b.low}-{b.high}' AS range, {b.low} AS min_score, {b.high} AS max_score,
            (SELECT count(*) FROM base WHERE {inside}) AS predictions,
            (SELECT count(*) FROM sub WHERE sub_status = 'C'{lately} AND (rtrim(subscriber_no), customer_ban) IN
              (SELECT (subscriber_no, ban) FROM base WHERE {inside})) AS actual_churns"""
        )
    return f"""WITH base AS (SELECT * {base(days, kind)}), b AS ({' UNION ALL '.join(parts)})
      SELECT *, coalesce(round(actual_churns * 100 / nullif(predictions, 0), 1), 0) AS accuracy,
      predictions - actual_churns AS false_positives FROM b"""


query("A23_churn_by_score_range", _bands_sql(churn.BANDS, False, "service", 180, None))(
    lambda db: churn.churn_by_score_range(db)
)
query("A23_churn_by_score_range_strict", _bands_sql(churn.BANDS, True, "service", 180, None))(
    lambda db: churn.churn_by_score_range(db, strict=True)
)
query("A23_churn_by_score_range_4", _bands_sql(churn.BANDS_4, False, "all", 3650, 90))(
    lambda db: churn.churn_by_score_range(db, 3650, "all", churn.BANDS_4, churned_within_days=90)
)
query(
    "A24_churn_trend",
    "SELECT strftime(conversation_time, '%Y-%m-%d') AS call_date, count(*) AS total_calls, "
    "count(*) FILTER (churn_score >= 70) AS high_risk, count(*) FILTER (churn_score BETWEEN 40 AND 69.999999) AS medium_risk, "
    "count(*) FILTER (coalesce(churn_score, 0) < 40) AS low_risk, round(avg(churn_score), 1) AS avg_score "
    f"{base(30)} GROUP BY 1",
)(lambda db: kpi.churn_trend(db))
query(
    "J06_churned_flagged",
    f"WITH f AS ({FLAGGED}) SELECT subscriber_no, customer_ban, product_code FROM sub WHERE {CHURNED}",
)(
    lambda db: joins.churned_flagged(
        db.subscriber, joins.conversations(db, 180, "service"), F.col("churn_score") >= 70
    ).select("subscriber_no", "customer_ban", "product_code")
)
query(
    "J07_recent_churned_flagged",
    f"WITH f AS (SELECT * FROM cs WHERE churn_score >= 70) SELECT subscriber_no, customer_ban FROM sub "
    f"WHERE {CHURNED} AND {recent('sub_status_date', 20)}",
)(
    lambda db: joins.churned_flagged(
        db.subscriber, db.conversation_summary, F.col("churn_score") >= 70, 20, db.as_of
    ).select("subscriber_no", "customer_ban")
)

# ---- filters ---------------------------------------------------------------------------------------------------

IDS = "SELECT source_id, source_type FROM cs WHERE "


def _ids(df):
    return df.select("source_id", "source_type")


def filter_query(name: str, condition: str, build) -> None:
    query(name, IDS + condition)(lambda db: _ids(build(db)))


filter_query(
    "F01_since",
    recent("conversation_time", 7),
    lambda db: timing.since(db.conversation_summary, "conversation_time", 7, db.as_of),
)
filter_query(
    "F02_between_periods",
    f"conversation_time BETWEEN {AS_OF} - INTERVAL 14 DAY AND {AS_OF} - INTERVAL 7 DAY",
    lambda db: timing.between_periods(db.conversation_summary, "conversation_time", 7, 7, db.as_of),
)
filter_query(
    "F03_day_slice",
    "conversation_time >= TIMESTAMP '2024-01-10' AND conversation_time < TIMESTAMP '2024-01-11'",
    lambda db: timing.day_slice(db.conversation_summary, "conversation_time", "2024-01-10"),
)
for _mood, _sql in {"Negative": "sentiment < 3", "Other": "coalesce(sentiment, 3) >= 3"}.items():
    filter_query(
        f"F04_sentiment_filter_{_mood.lower()}",
        _sql,
        lambda db, mood=_mood: filters.sentiment_filter(db.conversation_summary, mood),
    )
for _mood, _sql in {
    "Positive": "sentiment_text ILIKE '%positive%'",
    "Negative": "sentiment_text ILIKE '%negative%'",
    "Neutral": "coalesce(sentiment_text, 'neutral') = 'neutral'",
}.items():
    filter_query(
        f"F05_sentiment_text_filter_{_mood.lower()}",
        _sql,
        lambda db, mood=_mood: filters.sentiment_text_filter(db.conversation_summary, mood),
    )
for _label, _sql in {
    "Critical (95-100)": "churn_score >= 95",
    "High Risk (90-94)": "churn_score >= 90 AND churn_score < 95",
    "any": "churn_score >= 90",
}.items():
    filter_query(
        f"F06_risk_level_filter_{_label.split()[0].lower()}",
        _sql,
        lambda db, label=_label: filters.risk_level_filter(db.conversation_summary, label),
    )
for _label, _sql in {
    "High": "churn_score >= 70",
    "Medium": "churn_score >= 40 AND churn_score < 70",
    "Low": "coalesce(churn_score, 0) < 40",
}.items():
    filter_query(
        f"F07_risk_level_filter_3_{_label.lower()}",
        _sql,
        lambda db, label=_label: filters.risk_level_filter_3(db.conversation_summary, label),
    )
filter_query(
    "F08_score_range", "churn_score BETWEEN 60 AND 80", lambda db: filters.score_range(db.conversation_summary, 60, 80)
)
filter_query("F09_not_blank", "length(trim(products)) > 0", lambda db: filters.has_products(db.conversation_summary))
filter_query(
    "F10_product_equals", "products = 'Router'", lambda db: filters.product_equals(db.conversation_summary, "Router")
)
filter_query(
    "F10_product_unknown", "products IS NULL", lambda db: filters.product_equals(db.conversation_summary, "Unknown")
)
filter_query(
    "F11_hour_cell",
    "dayofweek(conversation_time) = 2 AND hour(conversation_time) = 10",
    lambda db: filters.hour_cell(db.conversation_summary, 2, 10),
)
filter_query(
    "F12_customer_filter",
    "subscriber_no = '7' AND ban = '7'",
    lambda db: filters.customer_filter(db.conversation_summary, "7 ", "7"),
)
filter_query(
    "F13_customer_filter_any",
    "subscriber_no = '7' OR ban = '9'",
    lambda db: filters.customer_filter_any(db.conversation_summary, "7", "9"),
)
query(
    "F14_chat_base_filter",
    f"""SELECT case_id, seq FROM chat WHERE channel_code <> 2 AND last_run_date > {AS_OF} AND channel_desc = 'WhatsApp'
      AND text IS NOT NULL AND case_date > {AS_OF} - INTERVAL 7 DAY""",
)(lambda db: filters.chat_base_filter(db.chat_segments, db.as_of).select("case_id", "seq"))
query(
    "F15_check_condition",
    """WITH v AS (SELECT history_id, metric_value, hist.threshold_value, condition_operator AS op FROM hist JOIN rules USING (alert_id))
    SELECT history_id, CASE op WHEN 'gt' THEN metric_value > threshold_value WHEN 'gte' THEN metric_value >= threshold_value
      WHEN 'lt' THEN metric_value < threshold_value WHEN 'lte' THEN metric_value <= threshold_value ELSE false END AS met FROM v""",
)(
    lambda db: db.alert_history.select("history_id", "alert_id", "metric_value", "threshold_value")
    .join(db.alert_rules.select("alert_id", "condition_operator"), "alert_id")
    .select(
        "history_id",
        filters.check_condition(F.col("metric_value"), F.col("condition_operator"), F.col("threshold_value")).alias("met"),
    )
)
query("F16_status_filter", "SELECT history_id FROM hist WHERE status = 'ACTIVE'")(
    lambda db: filters.status_filter(db.alert_history, "ACTIVE").select("history_id")
)
query("F16_status_filter_absent", "SELECT history_id FROM hist")(
    lambda db: filters.status_filter(db.alert_history).select("history_id")
)
query("F18_to_days", f"SELECT count(*) AS count FROM cs WHERE conversation_time > {AS_OF} - INTERVAL 90 MINUTE")(
    lambda db: kpi.period_volume(db, timing.to_days(90, "minutes"))
)
query(
    "F18_range_days",
    "SELECT count(*) AS count FROM cs WHERE conversation_time > TIMESTAMP '2024-01-30 12:00:00'",
)(lambda db: kpi.period_volume(db, timing.range_days(datetime(2024, 1, 10), datetime(2024, 1, 10, 12))))
query(
    "F19_preview_columns",
    f"""SELECT source_id AS call_id, source_type AS type, strftime(conversation_time, {MIN}) AS created,
      left(summary, 12) AS summary, sentiment, satisfaction, round(churn_score, 1) AS churn_score FROM cs""",
)(lambda db: filters.preview_columns(db.conversation_summary, 12))
query(
    "F20_speaker_label",
    """SELECT call_id, seq, CASE owner WHEN 'A' THEN 'Agent' WHEN 'C' THEN 'Customer' ELSE owner END AS speaker_label,
      CASE owner WHEN 'A' THEN 'agent' WHEN 'C' THEN 'customer' ELSE 'other' END AS speaker_class FROM seg""",
)(lambda db: filters.with_speaker(db.segments).select("call_id", "seq", "speaker_label", "speaker_class"))

# ---- joins --------------------------------------------------------------------------------------------------------

query(
    "J01_unprocessed",
    f"""SELECT call_id, seq FROM seg WHERE {recent('call_time', 5)} AND NOT EXISTS
      (SELECT 1 FROM ledger l WHERE l.call_id = seg.call_id AND {recent('text_time', 3)})""",
)(lambda db: joins.unprocessed(db.segments, db.processed_calls, 5, 3, db.as_of).select("call_id", "seq"))
for _kind in ("service", "sales"):
    query(f"J02_call_type_filter_{_kind}", f"SELECT source_id, source_type FROM cs WHERE {of_kind(_kind, 14)}")(
        lambda db, kind=_kind: _ids(joins.call_type_filter(db.conversation_summary, db, kind, 14, db.as_of))
    )
query("J02_call_type_filter_all", "SELECT source_id, source_type FROM cs")(
    lambda db: _ids(joins.call_type_filter(db.conversation_summary, db, "all", 14, db.as_of))
)
query(
    "J02_call_kinds",
    """SELECT call_id AS source_id,
      max(call_time) FILTER (queue_name NOT IN (SELECT queue_name FROM sales)) AS service,
      max(call_time) FILTER (queue_name IN (SELECT queue_name FROM sales)) AS sales
      FROM seg WHERE queue_name IS NOT NULL GROUP BY 1""",
)(lambda db: joins.call_kinds(db.segments, db.sales_queue))
query(
    "J02_reused_call_kinds",
    KPIS.format(NUMERIC_MOODS) + base(7, "sales"),
)(lambda db: kpi.summary_kpis(db.replaced(call_kinds=joins.call_kinds(db.segments, db.sales_queue)), 7, "sales"))
query(
    "J03_category_join",
    "SELECT source_id, source_type, category_code, churn_score FROM cat JOIN cs USING (source_id, source_type)",
)(
    lambda db: joins.category_join(db.conversation_category, db.conversation_summary).select(
        "source_id", "source_type", "category_code", "churn_score"
    )
)
query(
    "J04_category_left_join",
    f"SELECT source_id, category_code FROM cat LEFT JOIN cs USING (source_id, source_type) "
    f"WHERE {recent('conversation_time', 7)}",
)(
    lambda db: timing.since(
        joins.category_join(db.conversation_category, db.conversation_summary, "left"), "conversation_time", 7, db.as_of
    ).select("source_id", "category_code")
)
query(
    "J05_with_subscriber",
    """SELECT source_id, source_type, sub_status, product_code FROM cs
      LEFT JOIN sub ON rtrim(sub.subscriber_no) = cs.subscriber_no AND customer_ban = ban""",
)(
    lambda db: joins.with_subscriber(db.conversation_summary, db.subscriber).select(
        "source_id", "source_type", "sub_status", "product_code"
    )
)
query(
    "J08_queue_join",
    "SELECT call_id, seq, seg.queue_name, satisfaction FROM seg LEFT JOIN cs ON call_id = source_id",
)(
    lambda db: joins.queue_join(db.segments, db.conversation_summary.select("source_id", "satisfaction")).select(
        "call_id", "seq", "queue_name", "satisfaction"
    )
)
query(
    "J09_calls_in_queue",
    f"SELECT source_id, source_type FROM cs WHERE source_id IN (SELECT call_id FROM seg WHERE queue_name = 'view' "
    f"AND {recent('call_time', 7)})",
)(lambda db: _ids(joins.calls_in_queue(db.conversation_summary, db.segments, "view", 7, db.as_of)))
CHURNER_CALLS = f"""SELECT rtrim(s.subscriber_no) AS subscriber_no, s.sub_status AS churn_status,
    s.sub_status_date AS churn_date, v.call_id, max(v.call_time) AS call_time, max(c.churn_score) AS churn_score
    FROM sub s JOIN seg v ON rtrim(s.subscriber_no) = v.subscriber_no AND v.call_time < s.sub_status_date
    LEFT JOIN cs c ON v.call_id = c.source_id
    WHERE s.sub_status = 'C' AND s.sub_status_date > {AS_OF} - INTERVAL 30 DAY GROUP BY 1, 2, 3, 4"""
query("J10_churner_calls", CHURNER_CALLS)(
    lambda db: joins.churner_calls(db.subscriber, db.segments, db.conversation_summary, ["C"], 30, db.as_of)
)
query(
    "J11_product_filter",
    "SELECT source_id, source_type FROM cs WHERE ban IN (SELECT customer_ban FROM sub WHERE product_code = 'BUILDING')",
)(lambda db: _ids(joins.product_filter(db.conversation_summary, db.subscriber, "BUILDING")))
query(
    "J12_alert_history_join",
    "SELECT history_id, alert_name, metric_source, filter_product FROM hist JOIN rules USING (alert_id)",
)(
    lambda db: joins.alert_history_join(db.alert_history, db.alert_rules).select(
        "history_id", "alert_name", "metric_source", "filter_product"
    )
)
HIST_SHOWN = (
    "history_id, alert_id, alert_name, metric_source, filter_product, metric_value, hist.threshold_value, hist.severity, "
    "status, affected_count, acknowledged_by, resolved_by"
)
query(
    "J13_active_alerts",
    f"SELECT {HIST_SHOWN}, triggered_at FROM hist JOIN rules USING (alert_id) WHERE status = 'ACTIVE'",
)(lambda db: calls.active_alerts(db))
query(
    "J14_lookup_customer",
    f"""SELECT l.call_id, s.ban, s.subscriber_no, s.call_time AS conversation_time FROM ledger l LEFT JOIN
      (SELECT * FROM seg WHERE {recent('call_time', 90)}
       QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY call_time, seq, owner) = 1) s ON l.call_id = s.call_id""",
)(lambda db: joins.lookup_customer(db.processed_calls.select("call_id"), db.segments, db.as_of))
query(
    "J15_attach_categories",
    """SELECT source_id, source_type, coalesce((SELECT string_agg(DISTINCT category_code, ',' ORDER BY category_code)
      FROM cat WHERE cat.source_id = cs.source_id), '') AS categories FROM cs""",
)(
    lambda db: joins.attach_categories(_ids(db.conversation_summary), db.conversation_category).withColumn(
        "categories", F.array_join("categories", ",")
    )
)
query(
    "J16_suppress_open",
    "SELECT alert_id, alert_id IN (SELECT alert_id FROM hist WHERE status = 'ACTIVE') AS already_active FROM rules",
)(lambda db: joins.suppress_open(db.alert_rules.select("alert_id"), db.alert_history))
query(
    "J20_attach_queue",
    f"""SELECT source_id, source_type, queue_name FROM cs LEFT JOIN (SELECT call_id, queue_name FROM seg
      WHERE {recent('call_time', 365)} QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY call_time, seq, owner) = 1)
      ON source_id = call_id""",
)(lambda db: joins.attach_queue(_ids(db.conversation_summary), db.segments, db.as_of))
query(
    "J21_affected_subscribers",
    """SELECT CAST(event_id AS STRING) AS history_id, alert_name, CAST(user_id + i AS STRING) AS subscriber_no,
      if(i IS NULL, NULL, value) AS churn_score, affected_count
      FROM (SELECT e.*, unnest(CASE WHEN event_id % 3 = 0 THEN [NULL] ELSE range(1, event_id % 3 + 1) END) AS i,
        CAST(event_id % 3 AS INT) AS affected_count FROM events e WHERE event_type = 'error')
      JOIN rules ON alert_id = CAST(event_id % 23 AS STRING)""",
)(
    lambda db: joins.affected_subscribers(db.alert_history, db.alert_rules).select(
        "history_id", "alert_name", "subscriber_no", "churn_score", "affected_count"
    )
)
query(
    "W04_one_row_per_call",
    """SELECT call_id, owner, call_time FROM seg
      QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY call_time, seq, owner) = 1""",
)(lambda db: joins.one_row_per_call(db.segments, "owner", "call_time"))
query(
    "W05_latest_call_per_churner",
    f"SELECT subscriber_no, arg_max(call_id, (call_time, call_id)) AS call_id FROM ({CHURNER_CALLS}) GROUP BY 1",
)(
    lambda db: joins.latest_call_per_churner(
        joins.churner_calls(db.subscriber, db.segments, db.conversation_summary, ["C"], 30, db.as_of)
    )
)

# ---- lists and drill-downs ---------------------------------------------------------------------------------------

query(
    "L02_oldest_first_batch",
    f"""SELECT DISTINCT call_id, call_time FROM seg WHERE {recent('call_time', 5)} AND call_id NOT IN
      (SELECT call_id FROM ledger WHERE {recent('text_time', 5)}) ORDER BY call_time, call_id LIMIT 50""",
)(
    lambda db: categories.top_n(
        joins.unprocessed(db.segments, db.processed_calls, 5, 5, db.as_of).select("call_id", "call_time").distinct(),
        50,
        F.asc("call_time"),
        F.asc("call_id"),
    )
)
query(
    "L03_page",
    f"""SELECT source_id, churn_score, (SELECT count(*) FROM cs WHERE churn_score >= 80) AS total,
      CAST(ceil((SELECT count(*) FROM cs WHERE churn_score >= 80) / 20.0) AS BIGINT) AS pages
      FROM cs WHERE churn_score >= 80 ORDER BY churn_score DESC, source_id LIMIT 20 OFFSET 40""",
)(
    lambda db: calls.page(
        db.conversation_summary.filter("churn_score >= 80").select("source_id", "churn_score"),
        [F.desc("churn_score"), F.asc("source_id")],
        40,
        20,
    )
)
query(
    "L04_order_nulls_last",
    "SELECT source_id FROM cs ORDER BY satisfaction DESC NULLS LAST, churn_score DESC NULLS LAST, source_id LIMIT 30",
)(
    lambda db: categories.top_n(
        db.conversation_summary, 30, F.desc_nulls_last("satisfaction"), F.desc_nulls_last("churn_score"), F.asc("source_id")
    ).select("source_id")
)
query(
    "L05_order_by_severity",
    """SELECT history_id, severity FROM hist ORDER BY CASE severity WHEN 'CRITICAL' THEN 1 WHEN 'WARNING' THEN 2 ELSE 3 END,
      triggered_at DESC, history_id LIMIT 40""",
)(lambda db: calls.order_by_severity(db.alert_history).limit(40).select("history_id", "severity"))
query("L06_recent_conversations", f"SELECT {LINE} {base(7)} {NEWEST} LIMIT 50")(
    lambda db: calls.recent_conversations(db)
)
query(
    "L06_recent_conversations_created",
    f"SELECT {LINE} {base(7, 'all', 'creation_date')} ORDER BY creation_date DESC, source_id LIMIT 50",
)(lambda db: calls.recent_conversations(db, call_type="all", time_col="creation_date"))
query(
    "L07_recent_errors",
    f"""SELECT error_type, left(error_message, 200) AS error_message, call_id, strftime(error_timestamp, {SEC}) AS timestamp
      FROM errors WHERE {recent('error_timestamp', 7)} ORDER BY error_timestamp DESC, error_id LIMIT 100""",
)(lambda db: calls.recent_errors(db))
query(
    "L08_calls_by_category",
    f"SELECT {LINE_FULL} FROM cat JOIN cs USING (source_id, source_type) WHERE category_code = 'cat_4' "
    f"AND {recent('conversation_time', 7)} AND {of_kind('service', 7)} {NEWEST} LIMIT 50",
)(lambda db: calls.calls_by_category(db, "cat_4"))
query("L09_calls_by_sentiment", f"SELECT {LINE_FULL} {base(7)} AND sentiment < 3 {NEWEST} LIMIT 50")(
    lambda db: calls.calls_by_sentiment(db, "Negative")
)
query(
    "L09_calls_by_sentiment_text",
    f"SELECT {LINE_FULL} {base(7, 'all', 'creation_date')} AND sentiment_text = 'Positive' "
    "ORDER BY creation_date DESC, source_id LIMIT 50",
)(lambda db: calls.calls_by_sentiment_text(db, "Positive"))
query("L10_calls_by_risk", f"SELECT {LINE_FULL} {base(14)} AND churn_score >= 90 AND churn_score < 95 {RISKIEST} LIMIT 50")(
    lambda db: calls.calls_by_risk(db, "High Risk (90-94)", 14)
)
query(
    "L10_calls_by_risk_3",
    f"SELECT {LINE_FULL} {base(7, 'all', 'creation_date')} AND coalesce(churn_score, 0) < 40 {RISKIEST} LIMIT 50",
)(lambda db: calls.calls_by_risk_3(db, "Low"))
query(
    "L11_calls_by_heatmap_cell",
    f"SELECT {LINE} {base(30)} AND dayofweek(conversation_time) = 3 AND hour(conversation_time) = 14 {NEWEST} LIMIT 50",
)(lambda db: calls.calls_by_heatmap_cell(db, 3, 14))
query("L12_calls_by_product", f"SELECT {LINE} {base(7)} AND products = 'Router' {NEWEST} LIMIT 50")(
    lambda db: calls.calls_by_product(db, "Router")
)
query(
    "L13_calls_by_queue",
    f"SELECT {LINE} FROM cs WHERE source_id IN (SELECT call_id FROM seg WHERE queue_name = 'click' "
    f"AND {recent('call_time', 1)}) AND {of_kind('service', 1)} {NEWEST} LIMIT 100",
)(lambda db: calls.calls_by_queue(db, "click"))
query(
    "L14_calls_by_score_range",
    f"SELECT {LINE_FULL} {base(180)} AND churn_score BETWEEN 50 AND 60 {RISKIEST} LIMIT 50",
)(lambda db: calls.calls_by_score_range(db, 50, 60))
query(
    "L15_high_risk_calls",
    f"""WITH b AS (SELECT * {base(7)} AND churn_score BETWEEN 70 AND 100)
    SELECT source_id AS call_id, source_type AS type, strftime(conversation_time, {MIN}) AS created, churn_score,
      b.subscriber_no, ban, left(summary, 100) AS summary, sub_status, product_code,
      (SELECT count(*) FROM b) AS total, CAST(ceil((SELECT count(*) FROM b) / 25.0) AS BIGINT) AS pages
    FROM b LEFT JOIN sub ON rtrim(sub.subscriber_no) = b.subscriber_no AND customer_ban = ban
    {RISKIEST.replace('cs.', 'b.')}, sub_status, product_code LIMIT 25 OFFSET 25""",
)(lambda db: calls.high_risk_calls(db, offset=25))

# lookups are asked for every call
query(
    "L16_call_details",
    f"""SELECT source_id AS call_id, source_type AS type, strftime(conversation_time, {SEC}) AS created, summary, sentiment,
      satisfaction, round(churn_score, 1) AS churn_score, products, action_items, unresolved_issues, ban, cs.subscriber_no,
      sub_status, product_code, coalesce((SELECT string_agg(DISTINCT category_code, ',' ORDER BY category_code) FROM cat
        WHERE cat.source_id = cs.source_id), '') AS categories, q.queue_name
    FROM cs LEFT JOIN sub ON rtrim(sub.subscriber_no) = cs.subscriber_no AND customer_ban = ban
    LEFT JOIN (SELECT call_id, queue_name FROM seg QUALIFY row_number() OVER
      (PARTITION BY call_id ORDER BY call_time, seq, owner) = 1) q ON q.call_id = source_id""",
)(
    lambda db: calls.call_details(db, db.conversation_summary.select("source_id")).withColumn(
        "categories", F.array_join("categories", ",")
    )
)
query(
    "L17_call_conversation",
    f"""SELECT call_id, owner AS speaker, strftime(call_time, {SEC}) AS timestamp, seq, text,
      CASE owner WHEN 'A' THEN 'Agent' WHEN 'C' THEN 'Customer' ELSE owner END AS speaker_label,
      CASE owner WHEN 'A' THEN 'agent' WHEN 'C' THEN 'customer' ELSE 'other' END AS speaker_class,
      count(*) OVER (PARTITION BY call_id) AS message_count FROM seg""",
)(lambda db: calls.call_conversation(db, db.conversation_summary.select("source_id")))
CUSTOMERS = "SELECT DISTINCT subscriber_no, ban FROM cs"
STATUS = f"""SELECT k.subscriber_no, k.ban, coalesce(sub_status, 'UNKNOWN') AS status,
    coalesce(sub_status = 'A', false) AS is_active, product_code FROM ({CUSTOMERS}) k
    LEFT JOIN sub ON rtrim(sub.subscriber_no) = k.subscriber_no AND customer_ban = k.ban"""
query("L18_subscriber_status", STATUS)(
    lambda db: customers.subscriber_status(db.subscriber, db.conversation_summary.select("subscriber_no", "ban"))
)
LAST = (
    "SELECT *, row_number() OVER (PARTITION BY subscriber_no, ban ORDER BY conversation_time DESC, source_id, source_type) "
    f"AS position FROM cs WHERE {recent('conversation_time', 365)} QUALIFY position <= 50"
)
query(
    "L19_customer_journey_timeline",
    f"""SELECT subscriber_no, ban, position, source_id, source_type, strftime(conversation_time, {SEC}) AS call_date, sentiment,
      round(churn_score, 1) AS churn_score, satisfaction, left(summary, 200) AS summary, products,
      coalesce((SELECT string_agg(DISTINCT category_code, ',' ORDER BY category_code) FROM cat
        WHERE cat.source_id = l.source_id), '') AS categories FROM ({LAST}) l""",
)(
    lambda db: customers.journey_timeline(db, db.conversation_summary.select("subscriber_no", "ban")).withColumn(
        "categories", F.array_join("categories", ",")
    )
)
query(
    "L19_customer_journey",
    f"""WITH n AS (SELECT subscriber_no, ban, count(*) AS total_interactions,
      round(avg(round(churn_score, 1)), 1) AS avg_churn_score FROM ({LAST}) GROUP BY 1, 2)
    SELECT subscriber_no, ban, replace(status, 'UNKNOWN', 'Unknown') AS status, product_code, total_interactions,
      avg_churn_score FROM ({STATUS}) JOIN n USING (subscriber_no, ban)""",
)(lambda db: customers.customer_journey(db, db.conversation_summary.select("subscriber_no", "ban")))
query(
    "A38_avg_churn",
    "SELECT subscriber_no, ban, round(avg(round(churn_score, 1)), 1) AS avg_churn_score FROM cs GROUP BY 1, 2",
)(lambda db: customers.avg_churn(db.conversation_summary, "subscriber_no", "ban"))
# every subscriber is looked up by number, also those without a call
PHONE = f"""WITH v AS (SELECT DISTINCT trim(subscriber_no) AS value FROM sub),
  r AS (SELECT value, arg_max(ban, (conversation_time, source_id, source_type)) AS ban, max(subscriber_no) AS subscriber_no
    FROM v LEFT JOIN cs ON subscriber_no = value GROUP BY 1)"""
query(
    "L20_customer_lookup_phone",
    f"""{PHONE} SELECT value, r.subscriber_no IS NOT NULL AS found, r.subscriber_no, r.ban,
      coalesce(sub_status, 'Unknown') AS status, product_code,
      (SELECT count(*) FROM cs WHERE cs.subscriber_no = r.subscriber_no AND cs.ban = r.ban) AS total_interactions
      FROM r LEFT JOIN sub ON trim(sub.subscriber_no) = r.subscriber_no AND customer_ban = r.ban""",
)(lambda db: customers.customer_lookup(db, db.subscriber.select(F.col("subscriber_no").alias("value"))))
query(
    "L20_lookup_recent_calls",
    f"""{PHONE} SELECT value, row_number() OVER (PARTITION BY value ORDER BY conversation_time DESC, source_id) AS position,
      source_id, source_type, strftime(conversation_time, {MIN}) AS call_date, sentiment,
      round(churn_score, 1) AS churn_score, satisfaction, left(summary, 80) AS summary
      FROM r JOIN cs ON cs.subscriber_no = r.subscriber_no AND cs.ban = r.ban QUALIFY position <= 10""",
)(lambda db: customers.lookup_recent_calls(db, db.subscriber.select(F.col("subscriber_no").alias("value"))))
query(
    "L20_customer_lookup_call",
    f"""WITH v AS (SELECT source_id AS value FROM cs UNION SELECT 'none-' || source_id FROM cs)
    SELECT value, cs.source_id IS NOT NULL AS found, cs.subscriber_no, ban, coalesce(sub_status, 'Unknown') AS status,
      product_code, if(cs.source_id IS NULL, 0, (SELECT count(*) FROM cs c WHERE c.subscriber_no = cs.subscriber_no
        AND c.ban = cs.ban)) AS total_interactions
      FROM v LEFT JOIN cs ON source_id = value
      LEFT JOIN sub ON rtrim(sub.subscriber_no) = cs.subscriber_no AND customer_ban = ban""",
)(
    lambda db: customers.customer_lookup(
        db,
        db.conversation_summary.select(F.col("source_id").alias("value")).union(
            db.conversation_summary.select(F.concat(F.lit("none-"), "source_id"))
        ),
        "source_id",
    )
)
query(
    "L21_alert_history",
    f"""WITH h AS (SELECT * FROM hist WHERE {recent('triggered_at', 7)} AND status = 'ACKNOWLEDGED')
    SELECT {HIST_SHOWN.replace('hist.', 'h.')}, strftime(triggered_at, {MIN}) AS triggered_at,
      (SELECT count(*) FROM h JOIN rules USING (alert_id)) AS total,
      CAST(ceil((SELECT count(*) FROM h JOIN rules USING (alert_id)) / 50.0) AS BIGINT) AS pages
      FROM h JOIN rules USING (alert_id) ORDER BY h.triggered_at DESC, history_id LIMIT 50""",
)(lambda db: calls.alert_history(db, 7, "ACKNOWLEDGED"))
query("L22_list_alert_rules", "SELECT alert_id, alert_name, severity, created_at FROM rules")(
    lambda db: calls.list_alert_rules(db.alert_rules).select("alert_id", "alert_name", "severity", "created_at")
)
query(
    "L26_recent_processed",
    "SELECT call_id, processed_at, sqs_message_id FROM ledger ORDER BY processed_at DESC, call_id LIMIT 20",
)(lambda db: calls.recent_processed(db.processed_calls))
query("S26_read_alert_rules", "SELECT alert_id, metric_name FROM rules WHERE is_enabled")(
    lambda db: calls.read_enabled_rules(db.alert_rules).select("alert_id", "metric_name")
)
query("A40_source_stats", "SELECT count(*) AS total_segments, count(DISTINCT call_id) AS total_calls FROM seg")(
    lambda db: kpi.source_stats(db.segments)
)
