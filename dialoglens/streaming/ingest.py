"""Segments in, conversations out, without end.

The stream keeps per call only counts, channels and times in its state. Texts are read from
the segment table once a call is complete, so a very long call does not fill the state.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from dialoglens.functions.text import not_blank
from dialoglens.functions.timing import clock, interval_days
from dialoglens.operators import assemble
from dialoglens.plans.ingest import MODE_OF, NORMAL_MODE, prepare_calls
from dialoglens.session import materialize, scratch, state_on_disk
from dialoglens.sources import writers
from dialoglens.sources.readers import SourceSpec
from dialoglens.sources.store import ChangeTable
from dialoglens.streaming.early import ready_calls
from dialoglens.tables import SCHEMAS

LATENESS = "500 minutes"
SESSION_GAP = "30 minutes"
POLL_INTERVAL = "10 seconds"
#: How far before its earliest call a batch looks into the ledger.
LEDGER_DAYS = 31
SEGMENT_KEY = ["call_id", "call_time", "seq", "owner"]


def segment_stream(spark: SparkSession, path: str, files_per_batch: int | None = None, schema: str = SCHEMAS["segments"]) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def dedupe_segments(segments: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Each segment once. The key is the whole segment: a call's later segments must pass."""
    return segments.withWatermark("call_time", lateness).dropDuplicatesWithinWatermark(SEGMENT_KEY)


def completed_calls(segments: DataFrame, gap: str = SESSION_GAP) -> DataFrame:
    """Calls without a new segment for `gap`, once the watermark has passed that point."""
    return segments.groupBy("call_id", F.session_window("call_time", gap).alias("session")).agg(
        F.count(F.lit(1)).alias("segments"),
        F.count_if(not_blank(F.col("text"))).alias("message_count"),
        F.max("call_time").alias("last_time"),
    )


def assemble_stream(segments: DataFrame, lateness: str = LATENESS, gap: str = SESSION_GAP) -> DataFrame:
    # whether a text is blank is all that is asked of it here: the state and the shuffles before it hold no texts
    spoken = F.when(not_blank(F.col("text")), F.lit("x")).alias("text")
    return completed_calls(dedupe_segments(segments.select(*SEGMENT_KEY, spoken), lateness), gap)


def _trigger(interval: str | None) -> dict:
    return {"processingTime": interval} if interval else {"availableNow": True}


Source = DataFrame | Callable[[], DataFrame]


def fresh(source: Source) -> DataFrame:
    """The table as it is now. A frame has the files of the time it was made; a callable reads it again."""
    return source() if callable(source) and not isinstance(source, DataFrame) else source


def now(as_of) -> Column:
    """The clock of a batch: a callable is asked each time, None is the wall clock, all else stays."""
    value = as_of() if callable(as_of) and not isinstance(as_of, Column) else as_of
    return F.current_timestamp() if value is None else clock(value)


def ledger_table(spark: SparkSession, out: str) -> ChangeTable:
    """Calls with the batch that took them first, in months of their last segment."""
    return ChangeTable(spark, f"{out}/ledger", SCHEMAS["processed_calls"], writers.LEDGER_KEYS, time="text_time", keep="first")


def ingest_stream(
    segments: DataFrame,
    table: Source,
    spec: SourceSpec,
    out: str,
    checkpoint: str,
    as_of=None,
    interval: str | None = POLL_INTERVAL,
    lateness: str = LATENESS,
    gap: str = SESSION_GAP,
    mark_skipped: bool = True,
    early: bool = False,
    ledger_days: float = LEDGER_DAYS,
) -> StreamingQuery:
    """Publish completed calls and keep the ledger, the batch log and the status.

    `table` is best a callable: each micro-batch then sees segments that came after the start. A batch takes the calls
    that no other batch has in the ledger, so repeating it, also after its ledger rows were written, publishes the same
    calls again into the same folders. The ledger is written last. `interval=None` drains what is there and stops.

    With `early` a call is published at first sight of enough segments and all channels (`streaming.early`); what has
    ended without that is skipped as ever. A batch asks the ledger from `ledger_days` before its earliest call on.
    """
    spark = segments.sparkSession
    ledger = ledger_table(spark, out)

    def publish(batch: DataFrame, batch_id: int) -> None:
        began, clock_now = time.monotonic(), now(as_of)
        with scratch(spark, f"ingest-{batch_id}"):
            seen = batch if early else batch.withColumn("ended", F.lit(True))
            seen = materialize(seen.groupBy("call_id").agg(F.min("last_time").alias("since"), F.bool_or("ended").alias("ended")), "seen")
            first = seen.agg(F.date_format(F.trunc(F.min("since") - interval_days(ledger_days), "month"), "yyyy-MM-dd")).first()[0]
            others = ledger.changes(first).filter((F.col("source_type") == spec.source_type) & (F.col("batch") != batch_id))
            ids = materialize(seen.join(others.select("call_id"), "call_id", "left_anti").select("call_id", "ended"), "ids")
            count, source = ids.count(), fresh(table)
            # a batch without calls, as the first one of a stream is, doesn't read the table
            documents, handled = prepare_calls(source if count else source.limit(0), ids, spec, clock_now, mark_skipped)
            if early:  # a call that goes on and isn't ready in the table yet is left for later
                handled = materialize(handled.join(ids, "call_id").filter("sent OR ended").drop("ended"), "handled")
            # one folder per batch: a repeated batch replaces its own messages
            writers.conversation_messages(documents).write.mode("overwrite").json(f"{out}/messages/batch={batch_id}", compression="gzip")
            # a call that the stream has seen whole but the table does not hold is a failure, not a silent loss
            ended = ids.filter("ended").select("call_id")
            lost = ended.join(handled.select("call_id"), "call_id", "left_anti") if mark_skipped else ended.limit(0)
            failed = lost.select("call_id", F.lit("no segments in the table").alias("error_message"), F.lit("PROCESSING_ERROR").alias("error_type"))
            writers.error_rows(failed, clock_now).write.mode("overwrite").parquet(f"{out}/errors/batch={batch_id}")
            spent = int((time.monotonic() - began) * 1000)
            each = F.lit(spent) / F.lit(max(1, count))
            log = handled.select("call_id", each.alias("processing_time_ms"), F.lit(None).cast("string").alias("error_message"))
            log = log.unionByName(failed.select("call_id", each.alias("processing_time_ms"), "error_message"))
            writers.batch_log(log, str(batch_id), clock_now).write.mode("overwrite").parquet(f"{out}/log/batch={batch_id}")
            marks = handled.agg(F.max("text_time").alias("mark"), F.count(F.lit(1)).alias("calls"))
            mode = MODE_OF.get(spec.source_type, NORMAL_MODE)
            marks.withColumn("table_name", F.lit(mode)).write.mode("overwrite").parquet(f"{out}/marks/batch={batch_id}")
            rows = handled.select(*writers.LEDGER_KEYS, clock_now.alias("processed_at"), "text_time", "sqs_message_id")
            ledger.put(rows, batch_id)

    calls = ready_calls(segments, spec.required_channels, spec.min_segments, lateness, gap) if early else assemble_stream(segments, lateness, gap)
    writer = calls.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    with state_on_disk(spark):
        return writer.foreachBatch(publish).trigger(**_trigger(interval)).start()


def stream_status(spark: SparkSession, out: str) -> DataFrame:
    """Status rows of a running ingest: high-water mark and total, from its batch marks."""
    marks = spark.read.parquet(f"{out}/marks")
    return marks.groupBy("table_name").agg(
        F.max("mark").alias("last_processed_timestamp"), F.sum("calls").alias("total_processed")
    )


def current_status(status: DataFrame, out: str, as_of=None) -> DataFrame:
    """The status table with the marks and totals of a running ingest."""
    moved = stream_status(status.sparkSession, out).withColumnsRenamed({"last_processed_timestamp": "_mark", "total_processed": "_total"})
    changed = {
        "last_processed_timestamp": F.coalesce("_mark", "last_processed_timestamp"),
        "total_processed": F.col("total_processed") + F.coalesce("_total", F.lit(0)),
        "last_updated": F.when(F.col("_mark").isNotNull(), now(as_of)).otherwise(F.col("last_updated")),
    }
    joined = status.join(moved, "table_name", "left")
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in status.columns])


def skip_stream(batch: DataFrame, spec: SourceSpec) -> tuple[DataFrame, DataFrame]:
    """Side output of a micro-batch of segments: eligible calls, and ledger rows of the others."""
    stats = assemble.conversation_stats(batch, spec.required_channels, spec.min_segments)
    return stats.filter("skip_reason is null"), assemble.skipped_calls(stats, spec.source_type)
