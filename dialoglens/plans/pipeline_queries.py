"""Scans, assembly, ledger, results and keyed replace."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dialoglens.operators import assemble, calls, results
from dialoglens.operators.filters import success_gate
from dialoglens.operators.joins import call_kinds, transcripts
from dialoglens.plans.registry import query, recent
from dialoglens.session import fresh_path, materialize
from dialoglens.sources import readers, writers
from dialoglens.sources.store import ChangeTable
from dialoglens.tables import PARTITIONED, SCHEMAS

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
REQUIRED, FEWEST = ("A", "C"), 3
CHAT_WHERE = f"""channel_code <> 2 AND last_run_date > {AS_OF} AND channel_desc = 'WhatsApp' AND text IS NOT NULL
  AND case_date > {AS_OF} - INTERVAL 7 DAY"""

# ---- scans -----------------------------------------------------------------------------------

query(
    "S01_read_segments",
    "SELECT call_id, ban, subscriber_no, owner, text, call_time, queue_name, seq FROM seg",
)(lambda db: readers.read_segments(db.segments))
query(
    "S02_read_source",
    f"""SELECT 'WAPP' AS source_type, case_id AS call_id, ban, subscriber_no, owner, text, message_date AS call_time, seq
      FROM chat WHERE {CHAT_WHERE}""",
)(lambda db: readers.read_source(db.chat_segments, readers.CHATS, db.as_of))
query(
    "U01_union_sources",
    f"""SELECT 'CALL' AS source_type, call_id, seq FROM seg UNION ALL
      SELECT 'WAPP', case_id, seq FROM chat WHERE {CHAT_WHERE}""",
)(
    lambda db: readers.union_sources(db, [readers.CALLS, readers.CHATS]).select("source_type", "call_id", "seq")
)
query(
    "S03_bulk_scan_calls",
    f"""SELECT DISTINCT call_id FROM seg WHERE {recent('call_time', 90)} AND call_id NOT IN
      (SELECT call_id FROM ledger WHERE {recent('text_time', 90)})""",
)(lambda db: readers.bulk_scan_calls(db.segments, db.processed_calls, db.as_of))
query(
    "S24_check_tables",
    """SELECT 'segments' AS table_name, true AS present, '' AS missing, count(*) AS rows FROM seg UNION ALL
      SELECT 'error_log', true, 'retry_count', count(*) FROM errors UNION ALL
      SELECT 'processed_calls', true, '', count(*) FROM ledger UNION ALL
      SELECT 'call_summary', false, NULL, NULL""",
)(lambda db: readers.check_tables(db, ["segments", "error_log", "processed_calls", "call_summary"]))


def _written_lines(db):
    path = fresh_path(db.spark, "texts")
    db.documents.select("text").write.text(path)
    return readers.read_texts(db.spark, path)


query(
    "S23_read_texts",
    """SELECT trim(line, ' ') AS text FROM (SELECT unnest(regexp_split_to_array(text, '\\r\\n|\\n|\\r')) AS line FROM documents)
      WHERE trim(line, ' ') <> ''""",
)(_written_lines)


def _config_file(db, body) -> str:
    path = fresh_path(db.spark, "config")
    body.write.text(path)
    return path


def _categories(db, as_objects: bool):
    """Config file made of the event types; their number is that of the distinct types."""
    kinds = db.events.select("event_type").distinct()
    entry = (
        F.struct(F.col("event_type").alias("id"), F.upper("event_type").alias("name"), F.concat(F.lit("about "), "event_type").alias("description"))
        if as_objects
        else F.col("event_type")
    )
    body = kinds.agg(F.to_json(F.struct(F.sort_array(F.collect_list(entry)).alias("classifications"))))
    return readers.read_categories(db.spark, _config_file(db, body))


query(
    "S20_read_categories",
    """SELECT row_number() OVER (ORDER BY event_type) - 1 AS pos, event_type AS category_id, upper(event_type) AS name,
      'about ' || event_type AS description FROM (SELECT DISTINCT event_type FROM events)""",
)(lambda db: _categories(db, True))
query(
    "S20_read_categories_plain",
    """SELECT row_number() OVER (ORDER BY event_type) - 1 AS pos,
      'cat_' || CAST(row_number() OVER (ORDER BY event_type) - 1 AS STRING) AS category_id, event_type AS name,
      event_type AS description FROM (SELECT DISTINCT event_type FROM events)""",
)(lambda db: _categories(db, False))


def _keywords(db):
    kinds = db.events.select("event_type").distinct()
    words = F.struct(
        F.array(F.col("event_type"), F.upper("event_type")).alias("strong"), F.array(F.lit("weak")).alias("weak")
    )
    pairs = F.map_from_entries(F.collect_list(F.struct("event_type", words.alias("words"))))
    return readers.read_keywords(db.spark, _config_file(db, kinds.agg(F.to_json(F.struct(pairs.alias("keywords"))))))


query(
    "S21_read_keywords",
    """WITH k AS (SELECT DISTINCT event_type AS category FROM events)
    SELECT category, 'strong' AS strength, category AS keyword FROM k UNION ALL SELECT category, 'strong', upper(category) FROM k
    UNION ALL SELECT category, 'weak', 'weak' FROM k""",
)(_keywords)


def _prototypes(db):
    kinds = db.events.select("event_type").distinct()
    detection = F.struct(
        F.lit(True).alias("enabled"), F.lit(65).alias("threshold"), F.sort_array(F.collect_list("event_type")).alias("churn_prototypes")
    )
    body = kinds.agg(detection.alias("churn_detection")).select(F.to_json(F.struct("churn_detection")))
    return readers.read_prototypes(db.spark, _config_file(db, body))


query(
    "S22_read_prototypes",
    """SELECT row_number() OVER (ORDER BY event_type) - 1 AS proto_index, event_type AS text, 65.0 AS threshold, true AS enabled
      FROM (SELECT DISTINCT event_type FROM events)""",
)(_prototypes)

# ---- assembly ------------------------------------------------------------------------------------

STATS = """SELECT call_id, count(*) AS segments, count(*) FILTER (trim(text) <> '') AS message_count,
    count(DISTINCT owner) FILTER (owner IN ('A', 'C')) AS found, max(call_time) AS last_time FROM seg GROUP BY 1"""
REASON = (
    "CASE WHEN segments < 3 THEN 'SKIPPED_TOO_SHORT' WHEN found < 2 THEN 'SKIPPED_MISSING_CHANNEL' END"
)


def _stats(db):
    return assemble.conversation_stats(db.segments, REQUIRED, FEWEST)


def _documents(db, **limits):
    return assemble.assemble_conversations(db.segments, REQUIRED, FEWEST, "CALL", db.as_of, **limits)


def _lines(documents):
    """Messages of documents one per row, in order, for comparison."""
    return documents.select("call_id", "ban", "message_count", F.posexplode("messages").alias("pos", "m")).select(
        "call_id", "ban", "message_count", "pos", F.col("m.channel").alias("channel"), F.col("m.text").alias("text")
    )


LINES = f"""SELECT call_id, ban, message_count,
    row_number() OVER (PARTITION BY call_id ORDER BY call_time, seq, owner, text) - 1 AS pos, owner AS channel, text
    FROM seg JOIN (SELECT call_id, message_count FROM ({STATS}) WHERE {REASON} IS NULL) USING (call_id) WHERE trim(text) <> ''"""

query("A25_last_text_time", "SELECT call_id, max(call_time) AS text_time FROM seg GROUP BY 1")(
    lambda db: db.segments.groupBy("call_id").agg(F.max("call_time").alias("text_time"))
)
query("A26_conversation_stats", f"SELECT call_id, segments, message_count, last_time, {REASON} AS skip_reason FROM ({STATS})")(
    lambda db: _stats(db).select("call_id", "segments", "message_count", "last_time", "skip_reason")
)
query("A27_assemble_conversations", LINES)(lambda db: _lines(_documents(db)))
def _lines_of_parts(db):
    """Messages of calls cut into parts of four; a line's position counts the parts before its own."""
    documents = _documents(db, part_size=4)
    sizes = documents.groupBy("call_id").agg(
        F.map_from_entries(F.collect_list(F.struct("part", F.size("messages").alias("n")))).alias("sizes")
    )
    before = F.aggregate(
        F.filter(F.map_entries("sizes"), lambda e: e["key"] < F.col("part")), F.lit(0), lambda total, e: total + e["value"]
    )
    lines = documents.join(sizes, "call_id").select(
        "call_id", "ban", "message_count", before.alias("before"), F.posexplode("messages").alias("i", "m")
    )
    return lines.select(
        "call_id", "ban", "message_count", (F.col("before") + F.col("i")).alias("pos"),
        F.col("m.channel").alias("channel"), F.col("m.text").alias("text"),
    )


query("A27_assemble_in_parts", LINES)(_lines_of_parts)
query("R04_skipped_calls", f"SELECT 'CALL' AS source_type, call_id, {REASON} AS sqs_message_id FROM ({STATS}) WHERE {REASON} IS NOT NULL")(
    lambda db: assemble.skipped_calls(_stats(db), "CALL")
)
query(
    "A31_transcript_text",
    "SELECT call_id, string_agg(text, ' ' ORDER BY call_time, seq, owner, text) AS transcript FROM tseg GROUP BY 1",
)(lambda db: transcripts(db.text_segments).select("call_id", "transcript"))


def _round_trip(db):
    """Messages as published, read back from their JSON bodies."""
    sent = writers.conversation_messages(_documents(db))
    shape = "callId string, ban string, messageCount bigint, messages array<struct<channel string, text string>>"
    body = sent.select("message_type", "source_id", F.from_json("body", shape).alias("b"))
    return body.select(
        "message_type", "source_id", "b.callId", "b.ban", "b.messageCount", F.posexplode("b.messages").alias("pos", "m")
    ).select("message_type", "source_id", "callId", "messageCount", "pos", F.col("m.text").alias("text"))


query(
    "S04_write_conversations",
    f"""SELECT 'CONVERSATION_ASSEMBLY' AS message_type, 'CALL' AS source_id, call_id AS "callId",
      message_count AS "messageCount", pos, text FROM ({LINES})""",
)(_round_trip)

# ---- ledger and status --------------------------------------------------------------------------------

HANDLED = f"SELECT 'CALL' AS source_type, call_id, coalesce({REASON}, 'm-' || call_id) AS sqs_message_id, last_time FROM ({STATS})"


def _handled(db):
    return _stats(db).select(
        F.lit("CALL").alias("source_type"),
        "call_id",
        F.coalesce("skip_reason", F.concat(F.lit("m-"), "call_id")).alias("sqs_message_id"),
        "last_time",
    )


query(
    "S09_mark_processed",
    f"""SELECT source_type, h.call_id, {AS_OF} AS processed_at, text_time, sqs_message_id FROM ({HANDLED}) h
      LEFT JOIN (SELECT call_id, max(call_time) AS text_time FROM seg WHERE {recent('call_time', 10)} GROUP BY 1) t
      ON h.call_id = t.call_id WHERE h.call_id NOT IN (SELECT call_id FROM ledger)""",
)(
    lambda db: writers.mark_processed(
        _handled(db).drop("last_time"), db.segments, db.processed_calls, db.as_of, window_days=10
    )
)
query(
    "S10_mark_processed_backfill",
    f"""SELECT source_type, call_id, {AS_OF} AS processed_at, if(CAST(call_id AS BIGINT) % 2 = 0, {AS_OF}, last_time) AS text_time,
      sqs_message_id FROM ({HANDLED}) WHERE call_id NOT IN (SELECT call_id FROM ledger)""",
)(
    lambda db: writers.mark_processed_backfill(
        _handled(db).withColumn("text_time", F.when(F.col("call_id").cast("bigint") % 2 != 0, F.col("last_time"))),
        db.processed_calls,
        db.as_of,
    )
)
query(
    "S13_init_status",
    f"""WITH present AS (SELECT DISTINCT if(event_type = 'view', 'CDC_NORMAL_MODE', event_type) AS table_name FROM events),
      seeds(table_name, is_enabled, mark) AS (VALUES ('CDC_NORMAL_MODE', true, {AS_OF} - INTERVAL 1 DAY),
        ('CDC_HISTORICAL_MODE', false, TIMESTAMP '2023-01-01'), ('CDC_NORMAL_MODE_SF_OC', true, {AS_OF} - INTERVAL 1 DAY))
      SELECT table_name, is_enabled, mark AS last_processed_timestamp FROM seeds WHERE table_name NOT IN (SELECT table_name FROM present)""",
)(
    lambda db: writers.init_status(
        db.events.select(F.when(F.col("event_type") == "view", "CDC_NORMAL_MODE").otherwise(F.col("event_type")).alias("table_name")).distinct(),
        db.as_of,
        "2023-01-01 00:00:00",
    ).select("table_name", "is_enabled", "last_processed_timestamp")
)


def _status(db):
    """Status rows made of the event types: one mode per type."""
    return (
        db.events.groupBy("event_type")
        .agg(F.min("ts").cast("timestamp").alias("first"))
        .selectExpr(
            "event_type AS table_name", "first AS last_processed_timestamp", "0L AS last_change_id", "10L AS total_processed",
            "event_type <> 'view' AS is_enabled", "first AS created_at", "first AS last_updated",
        )
    )


def _updated_status(db):
    handled = db.events.filter("event_type <> 'click'").select(
        F.col("event_type").alias("table_name"), F.col("ts").cast("timestamp").alias("processed_time")
    )
    return writers.update_status(_status(db), handled, db.as_of)


STATUS = f"""SELECT event_type AS table_name, if(event_type = 'click', min(ts), max(ts)) AS last_processed_timestamp,
    if(event_type = 'click', 10, 10 + count(*)) AS total_processed, event_type <> 'view' AS is_enabled,
    if(event_type = 'click', min(ts), {AS_OF}) AS last_updated FROM events GROUP BY event_type"""
query("S14_update_status", STATUS)(
    lambda db: _updated_status(db).select(
        "table_name", "last_processed_timestamp", "total_processed", "is_enabled", "last_updated"
    )
)
query("L28_status_report", f"SELECT table_name, total_processed, last_processed_timestamp, is_enabled FROM ({STATUS})")(
    lambda db: calls.status_report(_updated_status(db))
)


def _log(db):
    handled = db.events.select(
        F.col("event_id").cast("string").alias("call_id"),
        (F.col("event_id") % 50).alias("processing_time_ms"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error_message"),
    )
    return writers.batch_log(handled, "b1", db.as_of)


query(
    "S15_batch_log",
    f"""SELECT 'b1' AS batch_id, CAST(event_id AS STRING) AS call_id, 'PUBLISH' AS operation_type,
      event_id % 50 AS processing_time_ms, if(event_type = 'error', 'FAILED', 'SUCCESS') AS status,
      if(event_type = 'error', props, NULL) AS error_message, {AS_OF} AS created_at FROM events""",
)(_log)
query(
    "A37_pipeline_counters",
    """SELECT count(*) FILTER (event_type <> 'error') AS processed, count(*) FILTER (event_type = 'error') AS failed,
      1 AS cycles, CAST(sum(event_id % 50) AS BIGINT) AS processing_time_ms FROM events""",
)(lambda db: writers.pipeline_counters(_log(db)))

# ---- results ------------------------------------------------------------------------------------------------


def _parsed(db):
    return readers.read_results(db.results_raw)


def _results(db):
    return results.normalize_results(_parsed(db))


GOOD = "FROM events WHERE event_id % 10 > 1"
ID = "CAST(event_id AS STRING)"
R_SENTIMENT = "CASE event_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 5 END"
R_PRIMARY = "CASE event_id % 4 WHEN 0 THEN 'billing' WHEN 1 THEN 'roaming' WHEN 2 THEN 'plain' ELSE 'unknown' END"
R_ALL = "CASE event_id % 4 WHEN 0 THEN 'billing, debt' WHEN 1 THEN 'roaming, roaming, , tv' ELSE '' END"
R_LABELS = "CASE event_id % 4 WHEN 0 THEN ['billing', 'debt'] WHEN 1 THEN ['roaming', 'tv'] WHEN 2 THEN ['plain'] ELSE ['unknown'] END"
R_TIME = "TIMESTAMP '2024-01-20 10:11:12' + if(event_id % 2 = 0, 250, 0) * INTERVAL 1 MILLISECOND"
query(
    "S05_read_results",
    f"""SELECT {ID} AS message_id, CASE event_id % 10 WHEN 0 THEN 'bad_json' WHEN 1 THEN 'other_type' ELSE 'ok' END AS verdict
      FROM events""",
)(lambda db: _parsed(db).select("message_id", "verdict"))
query(
    "S11_append_errors",
    f"""SELECT {ID} AS call_id, 'PROCESSING_ERROR' AS error_type, 'message is not valid JSON' AS error_message,
      0 AS retry_count, {AS_OF} AS error_timestamp FROM events WHERE event_id % 10 = 0""",
)(lambda db: writers.error_rows(readers.result_errors(_parsed(db)), db.as_of).drop("error_id"))


def _attempted(db):
    return readers.result_errors(_parsed(db)).withColumn("attempts", F.col("call_id").cast("bigint") % 4)


query(
    "S12_write_dead_letters",
    f"""SELECT {ID} AS call_id, CAST(event_id % 4 + 1 AS INT) AS total_attempts, 'message is not valid JSON' AS error_message
      FROM events WHERE event_id % 10 = 0 AND event_id % 4 >= 2""",
)(
    lambda db: writers.dead_letter_rows(writers.split_retries(_attempted(db))[1], db.as_of).select(
        "call_id", "total_attempts", "error_message"
    )
)
query("R14_retry_and_dlq", f"SELECT {ID} AS call_id, event_id % 4 + 1 AS attempts FROM events WHERE event_id % 10 = 0 AND event_id % 4 < 2")(
    lambda db: writers.split_retries(_attempted(db))[0].select("call_id", "attempts")
)
query("T13_primary_category", f"SELECT {ID} AS call_id, {R_PRIMARY} AS classification_primary, {R_ALL} AS classification_all {GOOD}")(
    lambda db: _results(db).select("call_id", "classification_primary", "classification_all")
)
query("T14_summary_text", f"SELECT {ID} AS call_id, 'sum ' || {ID} AS summary_text, {R_SENTIMENT} AS sentiment {GOOD}")(
    lambda db: _results(db).select("call_id", "summary_text", "sentiment")
)


def _replaced(db, name: str, keys: list[str], old: DataFrame, new: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """The stored table after a batch of old rows and one of new rows."""
    table = ChangeTable(db.spark, fresh_path(db.spark, name), SCHEMAS[name], keys, time=PARTITIONED[name])
    table.put(old, 0)
    table.put(new, 1, touched)
    return table.read()


query(
    "S06_upsert_call_summary",
    f"""SELECT {ID} AS call_id, 'sum ' || {ID} AS summary_text, {R_SENTIMENT} AS sentiment, {R_PRIMARY} AS classification_primary,
      {R_TIME} AS call_time, CAST(user_id % 50 AS STRING) AS customer_id, 12 AS ml_processing_time_ms {GOOD}
      UNION ALL SELECT {ID}, 'old', 3, 'old', ts, 'old', 1 FROM events WHERE event_id % 10 <= 1""",
)(
    lambda db: _replaced(
        db, "call_summary", ["call_id"],
        db.events.selectExpr(
            f"{ID} AS call_id", "'old' AS summary_text", "3 AS sentiment", "'old' AS classification_primary",
            "CAST(ts AS TIMESTAMP) AS call_time", "'old' AS customer_id", "1L AS ml_processing_time_ms",
        ),
        results.call_summary_rows(_results(db), db.as_of),
    ).select(
        "call_id", "summary_text", "sentiment", "classification_primary", "call_time", "customer_id", "ml_processing_time_ms"
    )
)
query(
    "L27_recent_results",
    f"""SELECT {ID} AS call_id, {R_SENTIMENT} AS sentiment, {R_PRIMARY} AS classification_primary, 0.5 AS confidence_score,
      {AS_OF} AS processed_at {GOOD} ORDER BY {ID} LIMIT 20""",
)(lambda db: calls.recent_results(results.call_summary_rows(_results(db), db.as_of)))
SUMMARY_ROW = f"""SELECT 'CALL' AS source_type, {ID} AS source_id, 'sum ' || {ID} AS summary,
    CASE event_id % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 3 END AS satisfaction, {R_SENTIMENT} AS sentiment,
    'A ' || event_type || ', B' AS products, 'open: ' || event_type AS unresolved_issues, 'call ' || event_type AS action_items,
    s.ban, s.subscriber_no, s.call_time AS conversation_time, CAST(event_id % 100 AS DOUBLE) AS churn_score
    FROM events LEFT JOIN (SELECT call_id, ban, subscriber_no, call_time FROM seg
      QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY call_time, seq, owner) = 1) s ON s.call_id = {ID}
    WHERE event_id % 10 > 1"""
COLUMNS = (
    "source_type, source_id, summary, satisfaction, sentiment, products, unresolved_issues, action_items, ban, "
    "subscriber_no, conversation_time, churn_score"
)


def _upserted_summaries(db):
    old = db.conversation_summary.drop("sentiment_text").withColumn("conversation_time", F.col("conversation_time").cast("timestamp"))
    new = results.conversation_summary_rows(_results(db), db.segments, db.as_of)
    new = new.withColumn("churn_score", F.round("churn_score", 6))
    merged = _replaced(db, "conversation_summary", ["source_type", "source_id"], old, new)
    return merged.selectExpr(*COLUMNS.split(", "))


query(
    "S07_upsert_conversation_summary",
    f"""WITH n AS ({SUMMARY_ROW}) SELECT {COLUMNS} FROM n UNION ALL
      SELECT {COLUMNS} FROM cs WHERE (source_type, source_id) NOT IN (SELECT (source_type, source_id) FROM n)""",
)(_upserted_summaries)
query(
    "S08_replace_categories",
    f"""WITH n AS (SELECT {ID} AS source_id, 'CALL' AS source_type, unnest({R_LABELS}) AS category_code {GOOD})
      SELECT * FROM n UNION ALL SELECT source_id, source_type, category_code FROM cat
      WHERE (source_id, source_type) NOT IN (SELECT (source_id, source_type) FROM n)""",
)(
    lambda db: _replaced(
        db, "conversation_category", ["source_id", "source_type"], db.conversation_category, results.category_rows(_results(db), db.as_of)
    ).select("source_id", "source_type", "category_code")
)
query(
    "R10_source_type_state",
    f"""SELECT {ID} AS call_id, CASE WHEN event_id % 5 = 0 THEN 'WAPP' WHEN event_id % 3 = 0 THEN 'CALL' ELSE 'CALL' END AS source_type
      FROM events""",
)(
    lambda db: results.with_source_type(
        db.events.selectExpr(f"{ID} AS call_id", "CASE WHEN event_id % 5 = 0 THEN 'WAPP' END AS source_type"),
        db.processed_calls,
    )
)


def _structured(db):
    return results.structure_result(db.responses)


SHAPE = """SELECT call_id, CAST(call_id AS BIGINT) % 6 AS k FROM responses"""
query(
    "T25_structure_result",
    f"""SELECT call_id, k <> 5 AS success, if(k = 5, 'severe_truncation', NULL) AS error, if(k = 5, NULL, 's ' || call_id) AS summary,
      if(k = 5, 3, 2) AS sentiment, if(k = 5, 3, 4) AS customer_satisfaction, if(k = 5, '', 'tv|net') AS products,
      if(k = 5, '', 'call') AS action_items, '' AS unresolved_issues FROM ({SHAPE})""",
)(
    lambda db: _structured(db).select(
        "call_id", "success", "error", "summary", "sentiment", "customer_satisfaction",
        F.array_join("products", "|").alias("products"), F.array_join("action_items", "|").alias("action_items"),
        "unresolved_issues",
    )
)


def _gated(db):
    """Both sides of the gate, from responses that are structured once."""
    passed, stopped = success_gate(materialize(_structured(db).select("call_id", "success"), "structured"))
    passed, stopped = (side.select("call_id", F.lit(ok).alias("passed")) for side, ok in ((passed, True), (stopped, False)))
    return passed.unionByName(stopped)


query("F17_success_gate", f"SELECT call_id, k <> 5 AS passed FROM ({SHAPE})")(_gated)
query(
    "T22_fallback_category",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'net' WHEN event_id % 2 = 0 THEN event_type ELSE 'בירור כללי' END AS category
      FROM events""",
)(
    lambda db: db.events.select(
        "event_id",
        F.expr("IF(event_id % 3 = 0, array('net', 'x'), CAST(array() AS array<string>))").alias("vector_based"),
        F.expr("IF(event_id % 2 = 0, array(event_type), CAST(array() AS array<string>))").alias("keyword_based"),
    ).select("event_id", F.get(results.fallback_category(F.col("vector_based"), F.col("keyword_based")), 0).alias("category"))
)

# ---- feedback ---------------------------------------------------------------------------------------------------

query(
    "S19_append_feedback",
    f"""SELECT CAST(doc_id AS STRING) AS call_id, if(quality = 1, 'good', 'bad') AS ml_category,
      if(toxic = 1, 'cat_' || CAST(doc_id % 3 AS STRING), NULL) AS correct_category, 1 - toxic AS is_correct,
      if(doc_id % 2 = 0, 'ann', 'dashboard_user') AS reviewer FROM labels""",
)(
    lambda db: writers.feedback_rows(
        db.labels.selectExpr(
            "CAST(doc_id AS STRING) AS call_id", "IF(quality = 1, 'good', 'bad') AS ml_category",
            "concat('cat_', CAST(doc_id % 3 AS STRING)) AS correct_category", "toxic = 0 AS is_correct",
            "IF(doc_id % 2 = 0, 'ann', CAST(NULL AS STRING)) AS reviewer",
        ),
        db.as_of,
    ).select("call_id", "ml_category", "correct_category", "is_correct", "reviewer")
)

# ---- month partitions ----------------------------------------------------------------------------------------------


def _orders_by_month(db, keep: int | None):
    """Churn dates spread over two months: written in month folders and read back."""
    path = fresh_path(db.spark, "months")
    writers.write_partitioned(db.subscriber, "sub_status_date", path)
    if keep is not None:
        writers.expire_partitions(db.spark, path, keep, db.as_of)
    return db.spark.read.parquet(path).groupBy(F.col("month").cast("string").alias("month")).agg(F.count(F.lit(1)).alias("rows"))


MONTHS = "SELECT strftime(sub_status_date, '%Y-%m-01') AS month, count(*) AS rows FROM sub"
query("S25_write_partitioned", f"{MONTHS} GROUP BY 1")(lambda db: _orders_by_month(db, None))


def _bucketed(db):
    """The segments kept in buckets of calls, as a table of this session."""
    path = fresh_path(db.spark, "buckets")
    name = f"segments_{path.rsplit('-', 1)[1]}"
    writers.write_bucketed(db.segments, name, path, buckets=8)
    return db.replaced(segments=db.spark.table(name))


query(
    "S25_write_bucketed",
    """SELECT call_id AS source_id,
      max(call_time) FILTER (queue_name NOT IN (SELECT queue_name FROM sales)) AS service,
      max(call_time) FILTER (queue_name IN (SELECT queue_name FROM sales)) AS sales
      FROM seg WHERE queue_name IS NOT NULL GROUP BY 1""",
)(lambda db: call_kinds(_bucketed(db).segments, db.sales_queue))
query("S27_expire_partitions", f"{MONTHS} WHERE sub_status_date >= TIMESTAMP '2024-01-01' GROUP BY 1")(
    lambda db: _orders_by_month(db, 1)
)
query("S27_kept_months", f"{MONTHS} WHERE sub_status_date >= TIMESTAMP '2024-01-01' GROUP BY 1")(
    lambda db: writers.kept_months(writers.with_month(db.subscriber, "sub_status_date"), 1, db.as_of)
    .groupBy(F.col("month").cast("string").alias("month"))
    .agg(F.count(F.lit(1)).alias("rows"))
)
