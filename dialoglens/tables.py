"""The set of tables that report operators work on."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from dialoglens.functions.timing import with_month_layout

# engine table name -> Spark DDL
SCHEMAS = {
    "segments": "call_id string, ban string, subscriber_no string, owner string, text string, "
    "call_time timestamp, queue_name string, seq bigint",
    "chat_segments": "case_id string, ban string, subscriber_no string, owner string, text string, "
    "case_date timestamp, message_date timestamp, channel_code int, channel_desc string, "
    "last_run_date timestamp",
    "conversation_summary": "source_type string, source_id string, creation_date timestamp, summary string, "
    "satisfaction int, sentiment int, products string, unresolved_issues string, action_items string, "
    "ban string, subscriber_no string, conversation_time timestamp, churn_score double",
    "call_summary": "call_id string, customer_id string, subscriber_no string, call_time timestamp, "
    "summary_text string, sentiment int, classification_primary string, classification_all string, "
    "confidence_score double, ml_processing_time_ms bigint, ml_model_version string, processed_at timestamp",
    "conversation_category": "source_id string, source_type string, creation_date timestamp, category_code string",
    "subscriber": "subscriber_no string, customer_ban string, sub_status string, sub_status_date timestamp, "
    "product_code string",
    "sales_queue": "queue_name string",
    "processed_calls": "source_type string, call_id string, processed_at timestamp, text_time timestamp, "
    "sqs_message_id string",
    "processing_status": "table_name string, last_processed_timestamp timestamp, last_change_id bigint, "
    "total_processed bigint, is_enabled boolean, created_at timestamp, last_updated timestamp",
    "processing_log": "batch_id string, call_id string, operation_type string, processing_time_ms bigint, "
    "status string, error_message string, created_at timestamp",
    "error_log": "error_id string, call_id string, error_message string, error_type string, retry_count int, "
    "error_timestamp timestamp",
    "dead_letters": "failure_id string, call_id string, error_message string, total_attempts int, "
    "original_message string, marked_failed_at timestamp",
    "alert_rules": "alert_id string, alert_name string, alert_name_he string, alert_type string, "
    "metric_source string, metric_name string, condition_operator string, threshold_value double, "
    "time_window_hours double, filter_product string, filter_sentiment string, severity string, "
    "is_enabled boolean, description string, created_at timestamp, updated_at timestamp, created_by string",
    "alert_history": "history_id string, alert_id string, triggered_at timestamp, metric_value double, "
    "threshold_value double, severity string, status string, acknowledged_by string, "
    "acknowledged_at timestamp, resolved_by string, resolved_at timestamp, resolution_notes string, "
    "affected_subscribers array<struct<subscriber_no string, ban string, churn_score double, "
    "call_time timestamp, product_code string, sub_status string>>, affected_count int",
    "recommendations": "rec_id string, rec_type string, rec_details string, status string, "
    "created_at timestamp, approved_by string, approved_at timestamp, notes string",
    "feedback": "feedback_id string, call_id string, ml_category string, correct_category string, "
    "is_correct int, reviewer string, created_at timestamp, notes string",
    "evaluation_history": "eval_id string, eval_date timestamp, churned_count bigint, with_score_count bigint, "
    "recall_rate decimal(5,4), coverage_rate decimal(5,4), avg_churn_score decimal(5,2), "
    "recommendations_generated int, notes string",
}

# fixed values: tables kept in month folders and their time columns
PARTITIONED = {
    "segments": "call_time",
    "conversation_summary": "conversation_time",
    "conversation_category": "creation_date",
    "call_summary": "processed_at",
    "processed_calls": "processed_at",
    "error_log": "error_timestamp",
}


class Tables:
    """Named DataFrames, built on first use: `Tables(spark, {...}).segments`.

    `call_kinds` is optional. Where a job has stored it (see
    `operators.joins.call_kinds`), every call-type filter uses it instead of
    scanning the segments again.
    """

    def __init__(
        self,
        spark: SparkSession,
        sources: Mapping[str, DataFrame | Callable[[], DataFrame]],
        as_of: str,
    ):
        self.spark = spark
        self.as_of = as_of
        self._sources = dict(sources)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._sources:
            raise AttributeError(f"no table {name!r}")
        source = self._sources[name]
        if callable(source) and not isinstance(source, DataFrame):
            source = self._sources[name] = source()
        # a stored table in month folders: time filters then prune them
        if name in PARTITIONED and "month" in source.columns and not source.schema["month"].metadata:
            source = self._sources[name] = with_month_layout(source, PARTITIONED[name])
        return source

    def __contains__(self, name: str) -> bool:
        return name in self._sources

    def replaced(self, **frames: DataFrame) -> "Tables":
        return Tables(self.spark, {**self._sources, **frames}, self.as_of)
