"""Result messages in, summary and category tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from dialoglens.operators import results
from dialoglens.session import empty_folder, materialize, scratch
from dialoglens.sources import readers, writers
from dialoglens.sources.store import ChangeTable
from dialoglens.streaming.ingest import Source, fresh, now
from dialoglens.tables import SCHEMAS

MESSAGES = "message_id string, sent_at timestamp, body string, attempts int"


class ResultStore:
    """The tables a result ends in, under one folder. Of several results of a call the newest sent one counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        sent = ", sent_at timestamp"
        table = lambda name, keys, more=sent, **how: ChangeTable(spark, f"{path}/{name}", SCHEMAS[name] + more, keys, **how)
        self.call_summary = table("call_summary", ["source_type", "call_id"], ", source_type string" + sent, order="sent_at", time="processed_at")
        self.conversation_summary = table("conversation_summary", ["source_type", "source_id"], order="sent_at", time="conversation_time")
        self.conversation_category = table("conversation_category", ["source_id", "source_type"], order="sent_at", time="creation_date")
        self.error_log = table("error_log", ["error_id"], "", time="error_timestamp", keep="first")
        self.dead_letters = table("dead_letters", ["failure_id"], "", time="marked_failed_at", keep="first")


def message_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(MESSAGES)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def store_results(messages: DataFrame, segments: Source, store: ResultStore, as_of=None, batch_id: int = 0, chats: Source | None = None) -> None:
    """One micro-batch into all tables. Repeating it replaces what it has stored.

    Calls are looked up in `segments` and chats in `chats` (in the segment layout). A message that can't be read is an
    error; it is queued again with one more attempt, and out of attempts it becomes a dead letter.
    """
    spark, clock_now = store.spark, now(as_of)
    with scratch(spark, f"results-{batch_id}"):
        parsed = readers.read_results(messages)
        # what is sent at one time is ordered by message
        rows = materialize(
            results.latest_per_call(results.normalize_results(parsed, keep=("sent_at", "message_id")), "sent_at", "message_id"), "results"
        )
        summaries = results.call_summary_rows(rows, clock_now, ("source_type", "sent_at"))
        store.call_summary.put(summaries, batch_id)
        feeds = {"CALL": fresh(segments)} if chats is None else {"CALL": fresh(segments), "WAPP": fresh(chats)}
        store.conversation_summary.put(results.conversation_summary_rows(rows, feeds, clock_now, ("sent_at",)), batch_id)
        touched = rows.select(F.col("call_id").alias("source_id"), "source_type", "sent_at")
        store.conversation_category.put(results.category_rows(rows, clock_now, ("sent_at",)), batch_id, touched)
        attempts = F.coalesce("attempts", F.lit(0)) if "attempts" in messages.columns else F.lit(0)
        failed = materialize(readers.result_errors(parsed.withColumn("attempts", attempts), ("message_id", "sent_at", "attempts")), "failed")
        again, dead = writers.split_retries(failed)
        queued = again.select("message_id", "sent_at", F.col("original_message").alias("body"), "attempts")
        # an empty file would be read as new input and make a batch of its own, which then writes the next one, without end
        folder = f"{store.path}/retry/batch={batch_id}"
        if queued.isEmpty():
            empty_folder(spark, folder)
        else:
            queued.write.mode("overwrite").json(folder)
        store.dead_letters.put(writers.dead_letter_rows(dead, clock_now).dropDuplicates(["failure_id"]), batch_id)
        store.error_log.put(writers.error_rows(failed, clock_now).dropDuplicates(["error_id"]), batch_id)


def queued_again(store: ResultStore) -> DataFrame:
    """Stream of the messages that `store_results` has queued again. A batch's queue is read by a later batch."""
    folder = f"{store.path}/retry"
    store.spark.createDataFrame([], MESSAGES).write.mode("overwrite").json(f"{folder}/batch=none")
    return message_stream(store.spark, folder).select(*[f.split()[0] for f in MESSAGES.split(", ")])


def results_stream(
    messages: DataFrame, segments: Source, store: ResultStore, checkpoint: str, as_of=None, interval: str | None = None, chats: Source | None = None,
    retries: bool = True,
) -> StreamingQuery:
    """Results into the store. The checkpoint acknowledges a batch after all tables have it.

    `segments` is best a callable, so that calls that came after the start are found. Without an interval the stream
    drains what is there and stops; with one it repeats. With `retries` it also reads what it has queued again itself,
    until a message is stored or out of attempts.
    """
    if retries:
        messages = messages.unionByName(queued_again(store), allowMissingColumns=True)

    def write(batch: DataFrame, batch_id: int) -> None:
        store_results(batch, segments, store, as_of, batch_id, chats)

    writer = messages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return writer.trigger(**({"processingTime": interval} if interval else {"availableNow": True})).start()


def drain(messages: DataFrame, segments: Source, store: ResultStore, checkpoint: str, as_of=None) -> None:
    """Store what is there, and what had to be queued again on the way."""
    for _ in range(writers.MAX_RETRIES):
        results_stream(messages, segments, store, checkpoint, as_of).awaitTermination()


def flush_stream(
    messages: DataFrame, segments: Source, store: ResultStore, checkpoint: str, as_of=None, seconds: int = 60
) -> StreamingQuery:
    return results_stream(messages, segments, store, checkpoint, as_of, f"{seconds} seconds")
