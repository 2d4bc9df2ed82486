"""Streams run to their end over the given files, and the batch jobs beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dialoglens.operators import alerts, classify
from dialoglens.plans import ingest
from dialoglens.plans.adapters import RESULTS, SEGMENTS, SUMMARY, _view
from dialoglens.plans.pipeline_queries import FEWEST, GOOD, ID, LINES, R_LABELS, R_PRIMARY, R_SENTIMENT, REASON, STATS
from dialoglens.plans.alert_queries import EVALUATED
from dialoglens.plans.registry import query
from dialoglens.session import fresh_path, state_on_disk
from dialoglens.sources import readers
from dialoglens.streaming import alerts as alert_stream, config, ingest as ingest_stream, results as result_stream

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
SPEC = readers.SourceSpec("calls", "segments", "call_id", "call_time", "call_time", ("A", "C"), FEWEST, "CALL")


def _streamed(db, table: str) -> DataFrame:
    """All files of a given table as a stream of micro-batches."""
    frame = getattr(db, table)
    files = frame.inputFiles()
    folders = sorted({f.rsplit("/", 1)[0] for f in files})
    reader = db.spark.readStream.schema(frame.schema)
    if len(folders) == 1 and len(files) == 1:  # a table that is one file, beside others
        reader = reader.option("pathGlobFilter", files[0].rsplit("/", 1)[1])
    return reader.parquet(folders[0] if len(folders) == 1 else "{" + ",".join(folders) + "}")


def _segment_stream(db) -> DataFrame:
    lines = _streamed(db, "lineitem")
    joined = lines.join(db.events, lines["l_orderkey"] == db.events["event_id"])
    return _view(joined, {**SEGMENTS, "call_time": f"CAST({SEGMENTS['call_time']} AS TIMESTAMP)"})


def _result(db, stream: DataFrame, name: str) -> DataFrame:
    """Append a stream to a folder until it is drained, and read that back."""
    out = fresh_path(db.spark, name)
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-state")
    with state_on_disk(db.spark):
        running = writer.trigger(availableNow=True).start(out)
    running.awaitTermination()
    return db.spark.read.schema(stream.schema).parquet(out)


def _twice(segments: DataFrame) -> DataFrame:
    return segments.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))


query("R02_late_data_dedupe", "SELECT call_id, call_time, seq, owner FROM seg GROUP BY ALL")(
    lambda db: _result(db, ingest_stream.dedupe_segments(_twice(_segment_stream(db))).select("call_id", "call_time", "seq", "owner"), "dedupe")
)
# sessions come out when the watermark, 500 minutes behind the newest segment, has passed their end
DONE = "call_id IN (SELECT call_id FROM seg GROUP BY 1 HAVING max(call_time) <= (SELECT max(call_time) FROM seg) - INTERVAL 530 MINUTE)"
ONCE = STATS.replace("FROM seg", "FROM (SELECT DISTINCT call_id, call_time, seq, owner, text FROM seg)")
query("R03_assemble_stream", f"SELECT call_id, segments, message_count, last_time FROM ({ONCE}) WHERE {DONE}")(
    lambda db: _result(
        db, ingest_stream.assemble_stream(_segment_stream(db)).select("call_id", "segments", "message_count", "last_time"), "sessions"
    )
)


def _ingested(db, early: bool = False) -> str:
    out = fresh_path(db.spark, "ingest")
    ingest_stream.ingest_stream(
        _segment_stream(db), lambda: db.segments, SPEC, out, f"{out}/state", db.as_of, interval=None, early=early
    ).awaitTermination()
    return out


def _messages(db, early: bool = False) -> DataFrame:
    shape = "callId string, messageCount bigint, messages array<struct<channel string, text string>>"
    sent = db.spark.read.schema("body string").json(f"{_ingested(db, early)}/messages")
    body = sent.select(F.from_json("body", shape).alias("b"))
    return body.select(F.col("b.callId").alias("call_id"), F.posexplode("b.messages").alias("pos", "m")).select(
        "call_id", "pos", F.col("m.channel").alias("channel"), F.col("m.text").alias("text")
    )


query("R01_ingest_stream", f"SELECT call_id, pos, channel, text FROM ({LINES}) WHERE {DONE}")(_messages)
# every call that is ready is published at once, whether it has ended or not
query("R03_early_calls", f"SELECT call_id, pos, channel, text FROM ({LINES})")(lambda db: _messages(db, True))
query(
    "R04_skip_stream",
    f"SELECT call_id, {REASON} AS sqs_message_id FROM ({STATS}) WHERE {DONE} AND {REASON} IS NOT NULL",
)(
    lambda db: ingest_stream.ledger_table(db.spark, _ingested(db))
    .read()
    .filter("sqs_message_id like 'SKIPPED%'")
    .select("call_id", "sqs_message_id")
)


def _message_stream(db) -> DataFrame:
    """Result messages, each of them twice, as after a redelivery."""
    columns = {k: RESULTS[k] for k in ("message_id", "body")} | {"sent_at": "CAST(ts AS TIMESTAMP)"}
    return _twice(_view(_streamed(db, "events"), columns)).drop("copy")


def _stored(db, flush: bool = False) -> result_stream.ResultStore:
    out = fresh_path(db.spark, "results")
    store = result_stream.ResultStore(db.spark, out)
    if flush:
        running = result_stream.flush_stream(_message_stream(db), lambda: db.segments, store, f"{out}/state", db.as_of, 1)
        running.processAllAvailable()
        running.stop()
    else:
        result_stream.drain(_message_stream(db), lambda: db.segments, store, f"{out}/state", db.as_of)
    return store


query(
    "R05_results_stream",
    f"SELECT {ID} AS call_id, 'sum ' || {ID} AS summary_text, {R_SENTIMENT} AS sentiment, {R_PRIMARY} AS classification_primary {GOOD}",
)(
    lambda db: _stored(db).call_summary.read().select("call_id", "summary_text", "sentiment", "classification_primary")
)
query("R06_drain", f"SELECT {ID} AS source_id, 'CALL' AS source_type, unnest({R_LABELS}) AS category_code {GOOD}")(
    lambda db: _stored(db).conversation_category.read().select("source_id", "source_type", "category_code")
)
query("R07_flush_stream", f"SELECT {ID} AS source_id, CAST(event_id % 100 AS DOUBLE) AS churn_score {GOOD}")(
    lambda db: _stored(db, True).conversation_summary.read().select("source_id", F.round("churn_score", 6).alias("churn_score"))
)


def _mark(db, enabled: bool):
    return db.events.agg(F.min("ts").cast("timestamp").alias("first")).select(
        F.lit(ingest.HISTORICAL_MODE).alias("table_name"),
        F.date_trunc("day", "first").alias("last_processed_timestamp"),
        F.lit(enabled).alias("is_enabled"),
    )


def _historical(db, enabled: bool):
    return ingest.historical_replay(db, _mark(db, enabled), 10)


query(
    "R08_historical_replay",
    """SELECT date_trunc('day', call_time) AS slice, count(DISTINCT call_id) AS calls, date_trunc('day', call_time) + INTERVAL 1 DAY AS mark
      FROM seg WHERE call_time >= TIMESTAMP '2024-01-01' AND call_time < TIMESTAMP '2024-01-11'
      AND call_id NOT IN (SELECT call_id FROM ledger) GROUP BY 1""",
)(lambda db: _historical(db, True))
query("R08_historical_replay_disabled", "SELECT NULL AS slice, NULL AS calls, NULL AS mark FROM events WHERE false")(
    lambda db: _historical(db, False)
)
REPLAYED = """call_id IN (SELECT call_id FROM seg WHERE call_time >= TIMESTAMP '2024-01-01' AND call_time < TIMESTAMP '2024-01-11')
      AND call_id NOT IN (SELECT call_id FROM ledger)"""
query("R08_replayed_conversations", f"SELECT call_id, pos, channel, text FROM ({LINES}) WHERE {REPLAYED}")(
    lambda db: ingest.replay_history(db, _mark(db, True), 10, SPEC)["conversations"]
    .select("call_id", F.posexplode("messages").alias("pos", "m"))
    .select("call_id", "pos", F.col("m.channel").alias("channel"), F.col("m.text").alias("text"))
)
query(
    "R08_replayed_ledger",
    f"SELECT call_id, coalesce({REASON}, 'SENT') AS handled FROM ({STATS}) WHERE {REPLAYED}",
)(
    lambda db: ingest.replay_history(db, _mark(db, True), 10, SPEC)["ledger"].select(
        "call_id", F.when(F.col("sqs_message_id").startswith("SKIPPED"), F.col("sqs_message_id")).otherwise("SENT").alias("handled")
    )
)
query("R08_replayed_mark", "SELECT 'CDC_HISTORICAL_MODE' AS table_name, date_trunc('day', min(ts)) + INTERVAL 10 DAY AS mark FROM events")(
    lambda db: ingest.replay_history(db, _mark(db, True), 10, SPEC)["status"].select(
        "table_name", F.col("last_processed_timestamp").alias("mark")
    )
)
query(
    "R09_backfill",
    """WITH s AS (SELECT call_id, count(*) AS n, count(DISTINCT owner) FILTER (owner IN ('A', 'C')) AS found FROM seg
      WHERE call_id NOT IN (SELECT call_id FROM ledger) GROUP BY 1)
    SELECT count(*) AS calls, count(*) FILTER (n >= 4 AND found = 2) AS sent, count(*) FILTER (n < 4 OR found < 2) AS skipped FROM s""",
)(lambda db: ingest.backfill(db, min_segments=4)["totals"])
query(
    "R09_backfill_conversations",
    LINES.replace(f"segments < {FEWEST}", "segments < 4").replace("SELECT call_id, ban, message_count,", "SELECT call_id,")
    + " AND call_id NOT IN (SELECT call_id FROM ledger)",
)(
    lambda db: ingest.backfill(db, min_segments=4)["conversations"]
    .select("call_id", F.posexplode("messages").alias("pos", "m"))
    .select("call_id", "pos", F.col("m.channel").alias("channel"), F.col("m.text").alias("text"))
)


def _judged(db):
    """Rules judged from the slots that a stream over the conversations has filled."""
    out = fresh_path(db.spark, "slots")
    slots = alert_stream.slot_table(db.spark, f"{out}/slots")
    conversations = _view(_streamed(db, "events"), {**SUMMARY, "conversation_time": "CAST(ts AS TIMESTAMP)"})
    alert_stream.alerts_stream(conversations, slots, f"{out}/state", interval=None).awaitTermination()
    days = alert_stream.longest_window(db.alert_rules)
    return alerts.evaluate_alerts(db, partials=alert_stream.recent_slots(slots, days, db.as_of))


query("R11_alerts_stream", EVALUATED)(_judged)
query(
    "R12_staleness",
    f"SELECT event_type AS table_name, if(max(ts) > {AS_OF} - INTERVAL 20 MINUTE, 'HEALTHY', 'STALE') AS health, max(ts) AS last_updated FROM events GROUP BY 1",
)(
    lambda db: ingest.staleness(
        db.events.groupBy(F.col("event_type").alias("table_name")).agg(F.max("ts").alias("last_updated")), db.as_of, 20 / 1440
    )
)


def _refreshed(db):
    """The stored configuration shrinks below what is usable before the stream begins: the first one stays."""
    kinds = db.events.select(F.col("event_type").alias("category")).distinct()
    words = kinds.select("category", F.lit("strong").alias("strength"), F.col("category").alias("keyword"))
    path = fresh_path(db.spark, "keywords")
    words.write.parquet(path)
    refreshed = config.RefreshedConfig(db.spark, lambda: db.spark.read.parquet(path))
    refreshed.current()
    words.filter("category = 'view'").write.mode("overwrite").parquet(path)
    out = fresh_path(db.spark, "enriched")
    texts = _view(_streamed(db, "events"), {k: SUMMARY[k] for k in ("source_id", "summary")})
    enrich = lambda batch, keywords: classify.keyword_category(
        classify.match_keywords(batch, keywords, "summary")
    ).select("source_id", "keyword_category")
    config.enrich_stream(texts, refreshed, enrich, out, f"{out}-state").awaitTermination()
    return db.spark.read.parquet(out).select("source_id", "keyword_category")


query("R13_config_refresh", "SELECT CAST(event_id AS STRING) AS source_id, event_type AS keyword_category FROM events")(_refreshed)
