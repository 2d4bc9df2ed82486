"""Alert metrics, rule evaluation and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoglens.functions.timing import clock
from dialoglens.operators import alerts, evaluation, workflow
from dialoglens.plans.registry import query, recent

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

# one SQL form per metric, over the rows `r` of a window
VALUE = {
    "high_risk_count": "count(*) FILTER (churn_score >= 70)",
    "critical_risk_count": "count(*) FILTER (churn_score >= 90)",
    "avg_churn_score": "round(avg(churn_score), 1)",
    "negative_count": "count(*) FILTER (sentiment < 3)",
    "negative_percent": "round(count(*) FILTER (sentiment < 3) * 100 / nullif(count(source_id), 0), 1)",
    "positive_percent": "round(count(*) FILTER (sentiment > 3) * 100 / nullif(count(source_id), 0), 1)",
    "avg_satisfaction": "round(avg(satisfaction), 2)",
    "low_satisfaction_count": "count(*) FILTER (satisfaction < 3)",
    "call_volume": "count(source_id)",
}
OWNS = "ban IN (SELECT customer_ban FROM sub WHERE product_code = {})"
PENDING = "(SELECT count(*) FROM recs WHERE status = 'PENDING')"
RECALL = "(SELECT recall_rate FROM evals ORDER BY eval_date DESC, eval_id DESC LIMIT 1)"

for _number, (_name, _hours, _product) in enumerate(
    [
        ("high_risk_count", 24, "BUILDING"),
        ("critical_risk_count", 24, None),
        ("avg_churn_score", 48, None),
        ("negative_count", 24, None),
        ("negative_percent", 24, None),
        ("positive_percent", 36, "MACHINERY"),
        ("avg_satisfaction", 24, None),
        ("low_satisfaction_count", 12, None),
    ],
    start=1,
):
    _where = recent("conversation_time", _hours / 24) + ("" if _product is None else f" AND {OWNS.format(repr(_product))}")
    query(
        f"M{_number:02d}_{_name}",
        f"SELECT '{_name}' AS metric, CAST({VALUE[_name]} AS DOUBLE) AS value FROM cs WHERE {_where}",
    )(lambda db, name=_name, hours=_hours, product=_product: alerts.single_metric(db, name, hours, product))
query("M09_pending_count", f"SELECT 'pending_count' AS metric, CAST(count(*) AS DOUBLE) AS value FROM recs WHERE status = 'PENDING'")(
    lambda db: alerts.single_metric(db, "pending_count", 24)
)
query(
    "M10_recall_rate",
    "SELECT 'recall_rate' AS metric, recall_rate AS value FROM evals ORDER BY eval_date DESC, eval_id DESC LIMIT 1",
)(lambda db: alerts.single_metric(db, "recall_rate", 24))
query(
    "M11_error_count",
    f"SELECT 'error_count' AS metric, CAST(count(*) AS DOUBLE) AS value FROM errors WHERE {recent('error_timestamp', 1)}",
)(lambda db: alerts.single_metric(db, "error_count", 24))
query(
    "M12_call_volume",
    f"SELECT 'call_volume' AS metric, CAST(count(*) AS DOUBLE) AS value FROM cs WHERE {recent('conversation_time', 1)}",
)(lambda db: alerts.single_metric(db, "call_volume", 24))

ALL_VALUES = ", ".join(f"CAST({sql} AS DOUBLE) AS {name}" for name, sql in VALUE.items())
PICKED = "CASE metric_name " + " ".join(f"WHEN '{n}' THEN {n}" for n in VALUE)
RULE_VALUES = f"""active AS (SELECT * FROM rules WHERE is_enabled AND alert_type = 'threshold'),
  spans AS (SELECT alert_id, {ALL_VALUES} FROM active LEFT JOIN cs
    ON conversation_time > {AS_OF} - time_window_hours * INTERVAL 1 HOUR
    AND (filter_product IS NULL OR {OWNS.format('filter_product')}) GROUP BY 1),
  mistakes AS (SELECT alert_id, count(error_id) AS n FROM active LEFT JOIN errors
    ON error_timestamp > {AS_OF} - time_window_hours * INTERVAL 1 HOUR GROUP BY 1),
  vals AS (SELECT active.*, {PICKED} WHEN 'error_count' THEN mistakes.n WHEN 'pending_count' THEN {PENDING}
    WHEN 'recall_rate' THEN {RECALL} END AS metric_value
    FROM active JOIN spans USING (alert_id) JOIN mistakes USING (alert_id)),
  judged AS (SELECT *, coalesce(CASE condition_operator WHEN 'gt' THEN metric_value > threshold_value
    WHEN 'gte' THEN metric_value >= threshold_value WHEN 'lt' THEN metric_value < threshold_value
    WHEN 'lte' THEN metric_value <= threshold_value END, false) AS triggered,
    alert_id IN (SELECT alert_id FROM hist WHERE status = 'ACTIVE') AS is_open FROM vals)"""
# the CTE text is read for view names, which must follow FROM or JOIN
EVALUATED = f"""WITH {RULE_VALUES} SELECT alert_id, alert_name, metric_source, metric_name, time_window_hours, filter_product,
    severity, metric_value, threshold_value AS threshold, triggered, triggered AND is_open AS already_active,
    triggered AND NOT is_open AS created FROM judged"""
query("K05_evaluate_alerts", EVALUATED)(lambda db: alerts.evaluate_alerts(db))
query(
    "K05_run_counts",
    f"""SELECT count(*) AS evaluated, count(*) FILTER (triggered) AS triggered, count(*) FILTER (created) AS created,
      count(*) FILTER (already_active) AS already_active FROM ({EVALUATED})""",
)(lambda db: alerts.run_counts(alerts.evaluate_alerts(db)))
query(
    "M14_metric_catalog",
    f"""WITH v AS (SELECT {ALL_VALUES} FROM cs WHERE {recent('conversation_time', 1)})
    SELECT name, metric_value FROM (UNPIVOT v ON * INTO NAME name VALUE metric_value)
    UNION ALL SELECT 'pending_count', {PENDING}
    UNION ALL SELECT 'error_count', count(*) FROM errors WHERE {recent('error_timestamp', 1)}""",
)(lambda db: alerts.metric_overview(db).select("name", "metric_value"))
query(
    "K08_default_alert_rules",
    f"""WITH v AS (SELECT {ALL_VALUES} FROM cs WHERE {recent('conversation_time', 1)})
    SELECT 'Daily High Risk' AS alert_name, high_risk_count AS metric_value, high_risk_count > 25 AS triggered FROM v
    UNION ALL SELECT 'Critical Churn Surge', critical_risk_count, critical_risk_count > 10 FROM v
    UNION ALL SELECT 'Negative Sentiment Wave', negative_percent, negative_percent > 35 FROM v
    UNION ALL SELECT 'IZI Churn Risk', 0, false FROM v
    UNION ALL SELECT 'Satisfaction Drop', avg_satisfaction, avg_satisfaction < 3 FROM v
    UNION ALL SELECT 'ML Backlog', {PENDING}, {PENDING} >= 5 FROM v""",
)(
    lambda db: alerts.evaluate_alerts(db, alerts.default_alert_rules(db.spark, db.as_of)).select(
        "alert_name", "metric_value", "triggered"
    )
)

RULE_ORDER = """CASE WHEN metric_name IN ('high_risk_count', 'critical_risk_count') THEN churn_score END DESC NULLS LAST,
  CASE WHEN metric_name = 'low_satisfaction_count' THEN satisfaction END ASC NULLS LAST, conversation_time DESC, source_id, source_type"""
AFFECTED = f"""SELECT r.alert_id, source_id, cs.subscriber_no, ban, churn_score, sentiment, satisfaction, s.product_code, sub_status,
    row_number() OVER (PARTITION BY r.alert_id ORDER BY {RULE_ORDER}, sub_status, s.product_code) AS position
    FROM rules r JOIN cs ON conversation_time > {AS_OF} - time_window_hours * INTERVAL 1 HOUR
      AND CASE metric_name WHEN 'high_risk_count' THEN churn_score >= 70 WHEN 'critical_risk_count' THEN churn_score >= 90
        WHEN 'negative_count' THEN sentiment < 3 WHEN 'low_satisfaction_count' THEN satisfaction < 3 ELSE false END
      AND (filter_product IS NULL OR {OWNS.format('filter_product')})
    LEFT JOIN (SELECT rtrim(subscriber_no) AS sno, customer_ban, product_code, sub_status FROM sub) s
      ON sno = cs.subscriber_no AND customer_ban = ban QUALIFY position <= 100"""
query("M13_affected_subscribers", AFFECTED)(
    lambda db: alerts.affected_by_rule(db, db.alert_rules).drop("call_time")
)
query("W07_top_n_per_rule", f"SELECT alert_id, position, source_id FROM ({AFFECTED.replace('<= 100', '<= 10')})")(
    lambda db: alerts.affected_by_rule(db, db.alert_rules, 10).select("alert_id", "position", "source_id")
)


def _new_history(db):
    evaluated = alerts.evaluate_alerts(db)
    return alerts.alert_history_rows(
        db, evaluated, alerts.affected_by_rule(db, db.alert_rules), alerts.affected_counts(db, db.alert_rules)
    )


query(
    "S16_append_alert_history",
    f"""WITH e AS ({EVALUATED}), a AS (SELECT alert_id, count(*) AS n, string_agg(subscriber_no, ',' ORDER BY position) FILTER (position <= 100) AS people
      FROM ({AFFECTED.replace('QUALIFY position <= 100', '')}) GROUP BY 1)
    SELECT e.alert_id, metric_value, threshold AS threshold_value, severity, 'ACTIVE' AS status, coalesce(n, 0) AS affected_count,
      coalesce(people, '') AS people FROM e LEFT JOIN a USING (alert_id) WHERE created""",
)(
    lambda db: _new_history(db).select(
        "alert_id", "metric_value", "threshold_value", "severity", "status", "affected_count",
        F.array_join(F.transform("affected_subscribers", lambda s: s["subscriber_no"]), ",").alias("people"),
    )
)
query(
    "A34_alert_summary",
    f"""SELECT count(*) FILTER (status = 'ACTIVE') AS active_count,
      count(*) FILTER (status = 'ACTIVE' AND severity = 'CRITICAL') AS critical_count,
      (SELECT count(*) FROM rules WHERE is_enabled) AS enabled_rules,
      count(*) FILTER ({recent('triggered_at', 1)}) AS alerts_24h FROM hist""",
)(lambda db: alerts.alert_summary(db))

# ---- decisions ----------------------------------------------------------------------------------------

# each alert gets up to three actions: acknowledged at 1, resolved at 2 or 0, resolved again at 3
ACTIONS = """SELECT CAST(event_id AS STRING) AS history_id, a.action, a.actor, a.notes, a.at FROM events
  LATERAL VIEW explode(array(
    named_struct('action', IF(event_id % 5 = 0, 'none', 'acknowledge'), 'actor', 'ack', 'notes', '', 'at', 1),
    named_struct('action', IF(event_id % 3 = 0, 'resolve', 'none'), 'actor', 'res', 'notes', 'done', 'at', IF(event_id % 2 = 0, 2, 0)),
    named_struct('action', IF(event_id % 3 = 0, 'resolve', 'none'), 'actor', 'late', 'notes', 'again', 'at', 3))) AS a
  WHERE event_type = 'error'"""


def _acted(db):
    db.events.createOrReplaceTempView("_dialoglens_events")
    actions = db.spark.sql(ACTIONS.replace("FROM events", "FROM _dialoglens_events")).filter("action != 'none'")
    actions = actions.withColumn("at", clock(db.as_of) + F.col("at") * F.expr("INTERVAL 1 MINUTE"))
    return workflow.apply_alert_actions(db.alert_history, actions)


query(
    "K01_apply_alert_actions",
    """WITH h AS (SELECT *, CAST(history_id AS BIGINT) AS id FROM hist),
      f AS (SELECT *, status = 'ACTIVE' AND id % 5 <> 0 AND NOT (id % 3 = 0 AND id % 2 = 1) AS acked,
        status IN ('ACTIVE', 'ACKNOWLEDGED') AND id % 3 = 0 AS res FROM h)
    SELECT history_id, if(res, 'RESOLVED', if(acked, 'ACKNOWLEDGED', status)) AS status,
      if(acked, 'ack', acknowledged_by) AS acknowledged_by, if(res, 'res', resolved_by) AS resolved_by,
      if(res, 'done', NULL) AS resolution_notes FROM f""",
)(lambda db: _acted(db).select("history_id", "status", "acknowledged_by", "resolved_by", "resolution_notes"))


def _rule_changes(db):
    """One request per nation, of every kind."""
    return db.nation.selectExpr(
        "CAST(n_nationkey AS STRING) AS alert_id",
        "CASE n_nationkey % 5 WHEN 0 THEN 'create' WHEN 1 THEN 'update' WHEN 2 THEN 'toggle' WHEN 3 THEN 'delete' ELSE 'none' END AS action",
        "concat('new ', n_name) AS alert_name", "CAST(NULL AS STRING) AS alert_name_he", "CAST(NULL AS STRING) AS alert_type",
        "'churn' AS metric_source", "IF(n_nationkey = 10, CAST(NULL AS STRING), 'high_risk_count') AS metric_name",
        "'gt' AS condition_operator", "7D AS threshold_value", "CAST(NULL AS DOUBLE) AS time_window_hours",
        "CAST(NULL AS STRING) AS filter_product", "CAST(NULL AS STRING) AS filter_sentiment", "CAST(NULL AS STRING) AS severity",
        "CAST(NULL AS STRING) AS description", "n_nationkey AS at",
    )


query(
    "K02_apply_rule_changes",
    """WITH r AS (SELECT *, CAST(alert_id AS BIGINT) % 5 AS k FROM rules)
    SELECT if(k = 1, 'new ' || description, alert_name) AS alert_name, if(k = 1, 'high_risk_count', metric_name) AS metric_name,
      if(k = 1, 7, threshold_value) AS threshold_value, if(k = 1, 24, time_window_hours) AS time_window_hours,
      if(k = 1, 'WARNING', severity) AS severity, if(k = 2, NOT is_enabled, is_enabled) AS is_enabled FROM r WHERE k <> 3
    UNION ALL SELECT 'new ' || n_name, 'high_risk_count', 7, 24, 'WARNING', true FROM nation
      WHERE n_nationkey % 5 = 0 AND n_nationkey <> 10""",
)(
    lambda db: workflow.apply_rule_changes(db.alert_rules, _rule_changes(db), db.as_of).select(
        "alert_name", "metric_name", "threshold_value", "time_window_hours", "severity", "is_enabled"
    )
)
query("K02_invalid_rules", "SELECT 'new ' || n_name AS alert_name, 'metric_name' AS missing FROM nation WHERE n_nationkey = 10")(
    lambda db: workflow.invalid_rules(_rule_changes(db)).select("alert_name", "missing")
)
query("K02_cascade_deletes", "SELECT history_id FROM hist WHERE CAST(alert_id AS BIGINT) % 5 <> 3")(
    lambda db: workflow.cascade_deletes(db.alert_history, _rule_changes(db)).select("history_id")
)


def _decided(db):
    decisions = db.labels.selectExpr(
        "CAST(doc_id AS STRING) AS rec_id",
        "CASE doc_id % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' ELSE 'later' END AS decision",
        "'boss' AS actor", "IF(doc_id % 2 = 0, 'too broad', CAST(NULL AS STRING)) AS reason",
    ).withColumn("at", clock(db.as_of))
    return workflow.apply_recommendation_decisions(db.recommendations, decisions.filter("decision != 'later'"))


query(
    "K03_apply_recommendation_decisions",
    """WITH r AS (SELECT *, status = 'PENDING' AND CAST(rec_id AS BIGINT) % 3 = 0 AS yes,
      status = 'PENDING' AND CAST(rec_id AS BIGINT) % 3 = 1 AS no FROM recs)
    SELECT rec_id, if(yes, 'APPROVED', if(no, 'REJECTED', status)) AS status, if(yes, 'boss', approved_by) AS approved_by,
      if(no, 'Rejected by boss: ' || if(CAST(rec_id AS BIGINT) % 2 = 0, 'too broad', ''), NULL) AS notes FROM r""",
)(lambda db: _decided(db).select("rec_id", "status", "approved_by", "notes"))
KEYWORDS = """SELECT DISTINCT unnest(['k' || CAST(CAST(rec_id AS BIGINT) % 5 AS STRING), 'k9']) AS keyword FROM recs
  WHERE rec_type = 'churn_keywords' AND status = 'APPROVED' AND CAST(rec_id AS BIGINT) % 4 = 0"""
query("K04_recommended_keywords", KEYWORDS)(lambda db: workflow.recommended_keywords(db.recommendations))
query(
    "K04_recommended_threshold",
    """SELECT coalesce((SELECT 30 + CAST(rec_id AS BIGINT) % 20 FROM recs WHERE rec_type = 'churn_threshold' AND status = 'APPROVED'
      AND CAST(rec_id AS BIGINT) % 4 = 1 ORDER BY created_at DESC, rec_id DESC LIMIT 1), 70) AS threshold""",
)(lambda db: workflow.recommended_threshold(db.recommendations, 70))
query("U02_merge_keywords", f"{KEYWORDS} UNION SELECT event_type FROM events")(
    lambda db: workflow.merge_keywords(
        db.events.select(F.col("event_type").alias("keyword")), workflow.recommended_keywords(db.recommendations)
    )
)

# ---- quality reports -------------------------------------------------------------------------------------

query("A35_feedback_stats", f"""SELECT count(*) AS total_feedback, count(*) FILTER (is_correct = 1) AS correct_count,
  count(*) FILTER (is_correct = 0) AS incorrect_count FROM fb WHERE {recent('created_at', 7)}""")(
    lambda db: evaluation.feedback_stats(db.feedback, db.as_of)
)
query("A36_pending_recommendations_count", "SELECT count(*) AS pending FROM recs WHERE status = 'PENDING'")(
    lambda db: evaluation.pending_recommendations_count(db.recommendations)
)
query(
    "A33_misclassifications",
    f"""SELECT ml_category AS predicted, correct_category AS actual, count(*) AS error_count FROM fb
      WHERE is_correct = 0 AND {recent('created_at', 30)} GROUP BY 1, 2 HAVING count(*) >= 3""",
)(lambda db: evaluation.misclassifications(db.feedback, db.as_of))
query(
    "L23_list_recommendations",
    """SELECT rec_id, rec_type, if(CAST(rec_id AS BIGINT) % 4 < 2, NULL, rec_details) AS raw_details,
      if(CAST(rec_id AS BIGINT) % 4 = 1, 30 + CAST(rec_id AS BIGINT) % 20, NULL) AS recommended_value
      FROM recs WHERE status = 'PENDING'""",
)(
    lambda db: evaluation.list_recommendations(db.recommendations).select(
        "rec_id", "rec_type", "raw_details",
        F.try_variant_get("details", "$.recommended_value", "int").alias("recommended_value"),
    )
)
RATES = "round(recall_rate * 100, 1) AS recall_percent, round(coverage_rate * 100, 1) AS coverage_percent"
query(
    "L24_evaluation_history",
    f"""SELECT eval_id, strftime(eval_date, '%Y-%m-%d') AS eval_date, churned_count, with_score_count, {RATES},
      round(avg_churn_score, 1) AS avg_churn_score, recommendations_generated FROM evals WHERE {recent('eval_date', 90)}""",
)(lambda db: evaluation.evaluation_history(db.evaluation_history, db.as_of))
LATEST = f"""SELECT strftime(eval_date, '%Y-%m-%d') AS last_eval_date, churned_count AS churned, {RATES},
  round(avg_churn_score, 1) AS avg_score FROM evals ORDER BY eval_date DESC, eval_id LIMIT 1"""
query("W03_latest_evaluation", LATEST)(lambda db: evaluation.latest_evaluation(db.evaluation_history))
query(
    "L25_ml_metrics",
    f"""SELECT (SELECT count(*) FROM recs WHERE status = 'PENDING') AS pending_recommendations, l.*, f.* FROM ({LATEST}) l,
      (SELECT count(*) AS total_feedback, count(*) FILTER (is_correct = 1) AS correct_count,
      count(*) FILTER (is_correct = 0) AS incorrect_count FROM fb WHERE {recent('created_at', 7)}) f""",
)(lambda db: evaluation.ml_metrics(db))
