"""Domain tables over the driver's parquet files.

Each view is a list of expressions that Spark SQL and DuckDB read alike, so that the
registered queries and their check SQL work on the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dialoglens.tables import Tables

AS_OF = "2024-01-31 00:00:00"
AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"

SUMMARY = {
    "source_id": "CAST(event_id AS STRING)",
    "source_type": "CASE WHEN event_id % 4 = 0 THEN 'WAPP' ELSE 'CALL' END",
    "conversation_time": "ts",
    "creation_date": "ts + INTERVAL 1 HOUR",
    "summary": "concat(event_type, ' ', CAST(event_id AS STRING), ' ', props)",
    "satisfaction": "CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(1 + event_id % 5 AS INT) END",
    "sentiment": "CASE WHEN event_id % 19 = 0 THEN NULL ELSE CAST(1 + (event_id % 7) % 5 AS INT) END",
    "sentiment_text": "CASE event_id % 4 WHEN 0 THEN 'Positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'neutral' "
    "ELSE NULL END",
    "products": "CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'iPhone 7' "
    "WHEN 3 THEN 'iphone 12, Galaxy  S9' WHEN 4 THEN 'N/A, Galaxy Tab' ELSE 'Router' END",
    "action_items": "CASE WHEN event_id % 3 = 0 THEN '[{\"action\": \"call back\"}, {\"name\": \"check\"}]' ELSE '' END",
    "unresolved_issues": "CASE WHEN event_id % 10 = 0 THEN 'open issue' ELSE '' END",
    "ban": "CAST(user_id % 50 AS STRING)",
    "subscriber_no": "CAST(user_id AS STRING)",
    "churn_score": "CASE WHEN event_id % 23 = 0 THEN NULL ELSE least(value, 100.0) END",
}
SEGMENTS = {
    "call_id": "CAST(event_id AS STRING)",
    "ban": "CAST(user_id % 50 AS STRING)",
    "subscriber_no": "CAST(user_id AS STRING)",
    "owner": "CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'R' THEN 'C' ELSE 'B' END",
    "text": "CASE WHEN l_partkey % 31 = 0 THEN '  ' ELSE concat('part ', CAST(l_partkey AS STRING)) END",
    "call_time": "ts + l_linenumber * INTERVAL 1 SECOND",
    "queue_name": "CASE WHEN event_id % 29 = 0 THEN NULL ELSE event_type END",
    "seq": "l_linenumber * 1000000 + l_partkey",
}
SUBSCRIBER = {
    "subscriber_no": "concat(CAST(c_custkey AS STRING), ' ')",
    "customer_ban": "CAST(c_custkey % 50 AS STRING)",
    "sub_status": "CASE WHEN c_custkey % 5 = 0 THEN 'C' ELSE 'A' END",
    "sub_status_date": f"{AS_OF_SQL} - (c_custkey % 40) * INTERVAL 1 DAY",
    "product_code": "c_mktsegment",
}
CATEGORY = {
    "source_id": "CAST(event_id AS STRING)",
    "source_type": "CASE WHEN event_id % 4 = 0 THEN 'WAPP' ELSE 'CALL' END",
    "creation_date": "ts + INTERVAL 1 HOUR",
    "category_code": "code",
}
LEDGER = {
    "source_type": "'CALL'",
    "call_id": "CAST(event_id AS STRING)",
    "text_time": "ts",
    "processed_at": "ts + INTERVAL 1 HOUR",
    "sqs_message_id": "CASE WHEN event_id % 2 = 0 THEN concat('m', CAST(event_id AS STRING)) "
    "ELSE 'SKIPPED_TOO_SHORT' END",
}
ERRORS = {
    "error_id": "CAST(event_id AS STRING)",
    "call_id": "CAST(event_id AS STRING)",
    "error_type": "CASE WHEN event_id % 2 = 0 THEN 'SQS_SEND_FAILED' ELSE 'PROCESSING_ERROR' END",
    "error_message": "props",
    "error_timestamp": "ts",
}
FEEDBACK = {
    "feedback_id": "CAST(doc_id AS STRING)",
    "call_id": "CAST(doc_id AS STRING)",
    "ml_category": "CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END",
    "correct_category": "CASE WHEN toxic = 1 THEN concat('cat_', CAST(doc_id % 3 AS STRING)) ELSE NULL END",
    "is_correct": "1 - toxic",
    "created_at": f"{AS_OF_SQL} - (doc_id % 45) * INTERVAL 1 DAY",
}
TEXT_SEGMENTS = {
    "call_id": "CAST(conv_id AS STRING)",
    "ban": "CAST(conv_id % 50 AS STRING)",
    "subscriber_no": "CAST(conv_id AS STRING)",
    "owner": "CASE role WHEN 'user' THEN 'C' WHEN 'assistant' THEN 'A' ELSE 'B' END",
    "text": "text",
    "call_time": "TIMESTAMP '2024-01-01 00:00:00' + (conv_id * 10 + turn) * INTERVAL 1 MINUTE",
    "queue_name": "'chat'",
    "seq": "turn",
}
CHAT = {
    "case_id": "concat('w', CAST(conv_id AS STRING))",
    "ban": "CAST(conv_id % 50 AS STRING)",
    "subscriber_no": "CAST(conv_id AS STRING)",
    "owner": "CASE role WHEN 'user' THEN 'C' WHEN 'assistant' THEN 'A' ELSE 'B' END",
    "text": "text",
    "case_date": f"{AS_OF_SQL} - (conv_id % 10) * INTERVAL 1 DAY + INTERVAL 1 HOUR",
    "message_date": f"{AS_OF_SQL} - (conv_id % 10) * INTERVAL 1 DAY + INTERVAL 1 HOUR + turn * INTERVAL 1 MINUTE",
    "channel_code": "CAST(conv_id % 4 AS INT)",
    "channel_desc": "CASE WHEN conv_id % 7 = 0 THEN 'Mail' ELSE 'WhatsApp' END",
    "last_run_date": f"{AS_OF_SQL} + INTERVAL 1 HOUR",
    "seq": "turn",
}
METRIC_SOURCE = (
    "CASE WHEN n_nationkey % 13 < 3 THEN 'churn' WHEN n_nationkey % 13 < 6 THEN 'sentiment' "
    "WHEN n_nationkey % 13 < 8 THEN 'satisfaction' WHEN n_nationkey % 13 < 10 THEN 'ml_quality' "
    "ELSE 'operational' END"
)
METRIC_NAME = (
    "CASE n_nationkey % 13 WHEN 0 THEN 'high_risk_count' WHEN 1 THEN 'critical_risk_count' "
    "WHEN 2 THEN 'avg_churn_score' WHEN 3 THEN 'negative_count' WHEN 4 THEN 'negative_percent' "
    "WHEN 5 THEN 'positive_percent' WHEN 6 THEN 'avg_satisfaction' WHEN 7 THEN 'low_satisfaction_count' "
    "WHEN 8 THEN 'pending_count' WHEN 9 THEN 'recall_rate' WHEN 10 THEN 'error_count' "
    "WHEN 11 THEN 'call_volume' ELSE 'no_such_metric' END"
)
RULES = {
    "alert_id": "CAST(n_nationkey AS STRING)",
    "alert_name": "concat('rule ', n_name)",
    "alert_name_he": "n_name",
    "alert_type": "CASE WHEN n_nationkey = 24 THEN 'trend' ELSE 'threshold' END",
    "metric_source": METRIC_SOURCE,
    "metric_name": METRIC_NAME,
    "condition_operator": "CASE n_nationkey % 5 WHEN 0 THEN 'gt' WHEN 1 THEN 'gte' WHEN 2 THEN 'lt' "
    "WHEN 3 THEN 'lte' ELSE 'gt' END",
    "threshold_value": "CAST(n_nationkey % 13 * 4 AS DOUBLE)",
    "time_window_hours": "CAST(24 * (1 + n_nationkey % 3) AS DOUBLE)",
    "filter_product": "CASE WHEN n_nationkey % 4 = 1 THEN 'BUILDING' WHEN n_nationkey % 8 = 3 THEN 'MACHINERY' "
    "ELSE NULL END",
    "severity": "CASE n_nationkey % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'WARNING' ELSE 'INFO' END",
    "is_enabled": "n_nationkey % 7 <> 6",
    "description": "n_name",
    "created_at": f"{AS_OF_SQL} - n_nationkey * INTERVAL 1 DAY",
}
HISTORY = {
    "history_id": "CAST(event_id AS STRING)",
    "alert_id": "CAST(event_id % 23 AS STRING)",
    "triggered_at": "ts",
    "metric_value": "value",
    "threshold_value": "CAST(50 AS DOUBLE)",
    "severity": "CASE event_id % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'WARNING' ELSE 'INFO' END",
    "status": "CASE WHEN event_id % 11 = 0 AND event_id % 23 < 12 THEN 'ACTIVE' "
    "WHEN event_id % 2 = 0 THEN 'ACKNOWLEDGED' ELSE 'RESOLVED' END",
    "acknowledged_by": "CASE WHEN event_id % 2 = 0 THEN 'ops' ELSE NULL END",
    "resolved_by": "CASE WHEN event_id % 2 = 1 AND event_id % 11 <> 0 THEN 'lead' ELSE NULL END",
    "affected_count": "CAST(event_id % 3 AS INT)",
}
RECOMMENDATIONS = {
    "rec_id": "CAST(doc_id AS STRING)",
    "rec_type": "CASE doc_id % 3 WHEN 0 THEN 'churn_keywords' WHEN 1 THEN 'churn_threshold' "
    "ELSE 'pipeline_coverage' END",
    "rec_details": "CASE doc_id % 4 WHEN 0 THEN concat('{\"keywords\":[\"k', CAST(doc_id % 5 AS STRING), '\",\"k9\"]}') "
    "WHEN 1 THEN concat('{\"recommended_value\":', CAST(30 + doc_id % 20 AS STRING), '}') ELSE 'free text' END",
    "status": "CASE WHEN toxic = 1 THEN 'PENDING' ELSE 'APPROVED' END",
    "created_at": f"{AS_OF_SQL} - doc_id * INTERVAL 1 MINUTE",
    "approved_by": "CASE WHEN toxic = 1 THEN NULL ELSE 'lead' END",
}
EVALUATIONS = {
    "eval_id": "CAST(doc_id AS STRING)",
    "eval_date": f"{AS_OF_SQL} - doc_id * INTERVAL 6 HOUR",
    "churned_count": "doc_id % 40 + 1",
    "with_score_count": "doc_id % 30",
    "recall_rate": "CAST(doc_id % 100 AS DOUBLE) / 128",
    "coverage_rate": "CAST(doc_id % 50 AS DOUBLE) / 64",
    "avg_churn_score": "CAST(doc_id % 90 AS DOUBLE) + CAST(0.25 AS DOUBLE)",
    "recommendations_generated": "CAST(doc_id % 4 AS INT)",
}

# result messages: valid ones of several shapes, broken ones and ones of another type
_ID = "CAST(event_id AS STRING)"
RESULT_BODY = f"""CASE WHEN event_id % 10 = 0 THEN concat('{{"type": "ML_PROCESSING_RESULT", "callId": "', {_ID}, '", "summary": ')
 WHEN event_id % 10 = 1 THEN concat('{{"type": "OTHER", "callId": "', {_ID}, '"}}')
 ELSE concat('{{"type": "ML_PROCESSING_RESULT", "callId": "', {_ID}, '", "ban": "', CAST(user_id % 50 AS STRING),
 '", "callTime": "2024-01-20T10:11:12', CASE WHEN event_id % 2 = 0 THEN '.250000' ELSE '' END, '", "summary": ',
 CASE WHEN event_id % 2 = 0 THEN concat('{{"text": "sum ', {_ID}, '"}}') ELSE concat('"sum ', {_ID}, '"') END, ', "sentiment": ',
 CASE event_id % 3 WHEN 0 THEN '{{"overall": "positive"}}' WHEN 1 THEN '"שלילי"' ELSE '5' END, ', "classification": ',
 CASE event_id % 4 WHEN 0 THEN '{{"primary": "billing", "all": ["billing", "debt"]}}' WHEN 2 THEN '"plain"' ELSE '{{}}' END,
 ', "classifications": ', CASE event_id % 4 WHEN 1 THEN '["roaming", "roaming", "", "tv"]' ELSE '[]' END,
 ', "confidence": 0.5, "churn_confidence": ', CAST(event_id % 100 AS STRING), 'e-2, "products": ["A ', event_type, '", "B"], ',
 '"action_items": [{{"action": "call ', event_type, '", "due_date": "x"}}, {{"name": "none"}}], "unresolved_issues": {{"open": "', event_type,
 '", "n": 0}}, "customer_satisfaction": ', CASE event_id % 3 WHEN 0 THEN '9' WHEN 1 THEN '"2"' ELSE '"x"' END, ', "processingTime": 12}}') END"""
RESULTS = {"message_id": _ID, "call_id": _ID, "sent_at": "ts", "body": RESULT_BODY}

# raw responses: complete, wrapped, with missing or spare commas, cut a little or a lot
_REST = """'"sentiment": "negative", "products": "tv, net", "Action_items": "call", "customer_satisfaction": 4.7"""
RESPONSE = f"""CASE event_id % 6
 WHEN 0 THEN concat('{{"Summary": "s ', {_ID}, '", ', {_REST}}}')
 WHEN 1 THEN concat('Here it is: {{"סיכום": "s ', {_ID}, '", ', {_REST}}} done')
 WHEN 2 THEN concat('{{"summary": "s ', {_ID}, '", ', {_REST},}}')
 WHEN 3 THEN concat('{{"summary": "s ', {_ID}, '"', chr(10), {_REST}}}')
 WHEN 4 THEN concat('{{"summary": "s ', {_ID}, '", ', {_REST}, "extra": {{"a": {{"b": 1}}')
 ELSE concat('{{"summary": "s ', {_ID}) END"""
RESPONSES = {"call_id": _ID, "response": RESPONSE}

SALES_TYPES = "('purchase','signup')"
AFFECTED = (
    "CASE WHEN event_id % 3 = 0 THEN NULL ELSE transform(sequence(1, CAST(event_id % 3 AS INT)), i -> "
    "named_struct('subscriber_no', CAST(user_id + i AS STRING), 'ban', CAST(user_id % 50 AS STRING), "
    "'churn_score', value, 'call_time', ts, 'product_code', CAST(NULL AS STRING), 'sub_status', 'A')) END"
)


def _view(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{expression} AS {name}" for name, expression in columns.items()])


def load(spark: SparkSession, sf_dir: str) -> Tables:
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def segments() -> DataFrame:
        events = read("events").select("event_id", "ts", "user_id", "event_type")
        lines = read("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
        return _view(lines.join(events, lines["l_orderkey"] == events["event_id"]), SEGMENTS)

    def categories() -> DataFrame:
        events = read("events")
        typed = events.select("event_id", "ts", F.col("event_type").alias("code"))
        numbered = events.filter("event_id % 3 = 0").selectExpr(
            "event_id", "ts", "concat('cat_', CAST(event_id % 11 AS STRING)) AS code"
        )
        return _view(typed.unionByName(numbered), CATEGORY)

    def history() -> DataFrame:
        return _view(read("events").filter("event_type = 'error'"), {**HISTORY, "affected_subscribers": AFFECTED})

    def sales_queue() -> DataFrame:
        kinds = read("events").filter(f"event_type IN {SALES_TYPES}").select("event_type").distinct()
        return kinds.toDF("queue_name")

    return Tables(
        spark,
        {
            "conversation_summary": lambda: _view(read("events"), SUMMARY),
            "segments": segments,
            "sales_queue": sales_queue,
            "subscriber": lambda: _view(read("customer"), SUBSCRIBER),
            "conversation_category": categories,
            "processed_calls": lambda: _view(read("events").filter("event_id % 3 = 0"), LEDGER),
            "error_log": lambda: _view(read("events").filter("event_type = 'error'"), ERRORS),
            "feedback": lambda: _view(read("labels"), FEEDBACK),
            "text_segments": lambda: _view(read("conversations"), TEXT_SEGMENTS),
            "chat_segments": lambda: _view(read("conversations"), CHAT),
            "alert_rules": lambda: _view(read("nation"), RULES),
            "alert_history": history,
            "recommendations": lambda: _view(read("labels"), RECOMMENDATIONS),
            "evaluation_history": lambda: _view(read("labels"), EVALUATIONS),
            "results_raw": lambda: _view(read("events"), RESULTS),
            "responses": lambda: _view(read("events"), RESPONSES),
            **{raw: (lambda raw=raw: read(raw)) for raw in ("events", "lineitem", "embeddings", "documents", "labels", "nation")},
        },
        AS_OF,
    )


def _sql(columns: dict[str, str], source: str) -> str:
    listed = ", ".join(f"{expression} AS {name}" for name, expression in columns.items())
    return f"SELECT {listed} FROM {source}"


_CODES = (
    "(SELECT event_id, ts, event_type AS code FROM events UNION ALL SELECT event_id, ts, "
    "concat('cat_', CAST(event_id % 11 AS STRING)) FROM events WHERE event_id % 3 = 0) c"
)

# short names of the views inside the check SQL
SQL_VIEWS = {
    "cs": _sql(SUMMARY, "events"),
    "seg": _sql(SEGMENTS, "lineitem JOIN events ON l_orderkey = event_id"),
    "sales": f"SELECT DISTINCT event_type AS queue_name FROM events WHERE event_type IN {SALES_TYPES}",
    "sub": _sql(SUBSCRIBER, "customer"),
    "cat": _sql(CATEGORY, _CODES),
    "ledger": _sql(LEDGER, "events WHERE event_id % 3 = 0"),
    "errors": _sql(ERRORS, "events WHERE event_type = 'error'"),
    "fb": _sql(FEEDBACK, "labels"),
    "tseg": _sql(TEXT_SEGMENTS, "conversations"),
    "chat": _sql(CHAT, "conversations"),
    "rules": _sql(RULES, "nation"),
    "hist": _sql(HISTORY, "events WHERE event_type = 'error'"),
    "recs": _sql(RECOMMENDATIONS, "labels"),
    "raw_results": _sql(RESULTS, "events"),
    "responses": _sql(RESPONSES, "events"),
    "evals": _sql(EVALUATIONS, "labels"),
}
