"""Batch jobs that bring calls into the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dialoglens.functions.timing import clock, day_slice, interval_days
from dialoglens.operators import assemble
from dialoglens.operators.joins import handled_calls
from dialoglens.session import materialize
from dialoglens.sources import readers, writers
from dialoglens.tables import Tables

NORMAL_MODE, HISTORICAL_MODE, CHAT_MODE = "CDC_NORMAL_MODE", "CDC_HISTORICAL_MODE", "CDC_NORMAL_MODE_SF_OC"
#: Mode under which a feed is booked.
MODE_OF = {"CALL": NORMAL_MODE, "WAPP": CHAT_MODE}
STALE_AFTER_DAYS = 5 / 1440


def prepare_calls(
    segments: DataFrame, ids: DataFrame, spec: readers.SourceSpec, as_of, mark_skipped: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Conversations of the calls in `ids`, and what the ledger shall say about each call.

    A call is eligible as soon as it has enough segments and channels; later segments of it
    are not waited for. `mark_skipped=False` keeps short calls eligible for the next run.

    The segments are read twice: for one row per call, which is stored, and for the texts of the eligible calls. Calls
    shrink to that row before they meet `ids`, so no segment of another call is shuffled for them.
    """
    stats = assemble.conversation_stats(segments, spec.required_channels, spec.min_segments)
    stats = materialize(stats.join(ids.select("call_id"), "call_id", "left_semi"), "stats")
    documents = assemble.assemble_conversations(
        segments, spec.required_channels, spec.min_segments, spec.source_type, as_of, spec.strip_text, stats
    )
    handled = stats.select(
        F.lit(spec.source_type).alias("source_type"),
        "call_id",
        F.coalesce("skip_reason", writers.row_id("call_id", "last_time")).alias("sqs_message_id"),
        F.col("last_time").alias("text_time"),
        F.col("skip_reason").isNull().alias("sent"),
    )
    return documents, handled if mark_skipped else handled.filter("sent")


def backfill(
    db: Tables, days: float = readers.BACKFILL_DAYS, min_segments: int = readers.BACKFILL_MIN_SEGMENTS
) -> dict[str, DataFrame]:
    """All calls of the last `days` that the ledger lacks: `conversations, ledger, totals`.

    One plan over all of them; what arrives meanwhile is left to a run of the ingest stream.
    """
    ids = materialize(readers.bulk_scan_calls(db.segments, db.processed_calls, db.as_of, days), "ids")
    spec = readers.SourceSpec(
        "backfill", "segments", "call_id", "call_time", "call_time", ("A", "C"), min_segments, "CALL", strip_text=True
    )
    documents, handled = prepare_calls(db.segments, ids, spec, db.as_of)
    totals = handled.agg(
        F.count(F.lit(1)).alias("calls"), F.count_if("sent").alias("sent"), F.count_if(~F.col("sent")).alias("skipped")
    )
    ledger = writers.mark_processed_backfill(handled, db.processed_calls, db.as_of)
    return {"conversations": documents, "ledger": ledger, "totals": totals}


def historical_replay(db: Tables, status: DataFrame, days: int) -> DataFrame:
    """Calls to replay per day slice from the stored mark on, and the mark after each slice.

    Nothing is replayed while the mode is disabled. The mark moves on by finished slices.
    """
    return _replayed(db, status, days).groupBy("slice").agg(F.count(F.lit(1)).alias("calls")).withColumn(
        "mark", F.col("slice") + interval_days(1)
    )


def _replayed(db: Tables, status: DataFrame, days: int, source_type: str = "CALL") -> DataFrame:
    """`call_id, slice` of the calls to replay; the bare time column lets the slice reach the scan."""
    mark = status.filter((F.col("table_name") == HISTORICAL_MODE) & F.col("is_enabled")).agg(F.max("last_processed_timestamp")).first()[0]
    if mark is None:
        return db.segments.limit(0).select("call_id", F.lit(None).cast("timestamp").alias("slice"))
    inside = day_slice(db.segments, "call_time", mark, days)
    done = handled_calls(db.processed_calls, source_type)
    day = F.date_trunc("day", F.col("call_time").cast("timestamp"))
    return inside.select("call_id", day.alias("slice")).distinct().join(done, "call_id", "left_anti")


def replay_history(db: Tables, status: DataFrame, days: int, spec: readers.SourceSpec) -> dict[str, DataFrame]:
    """Replay the slices: `conversations, ledger, status`, the last with the mark behind the last slice.

    A call is replayed whole, with the segments that it has outside the slices too.
    """
    calls = materialize(_replayed(db, status, days, spec.source_type), "replayed")
    documents, handled = prepare_calls(db.segments, calls.select("call_id").distinct(), spec, db.as_of)
    ledger = writers.mark_processed_backfill(handled, db.processed_calls, db.as_of)
    begun = (F.col("table_name") == HISTORICAL_MODE) & F.col("is_enabled")
    end = F.least(F.col("last_processed_timestamp") + interval_days(days), clock(db.as_of))
    moved = status.withColumn("last_processed_timestamp", F.when(begun, end).otherwise(F.col("last_processed_timestamp")))
    if "total_processed" in status.columns:
        count = F.when(begun, F.lit(calls.select("call_id").distinct().count())).otherwise(0)
        moved = moved.withColumn("total_processed", F.col("total_processed") + count)
    return {"conversations": documents, "ledger": ledger, "status": moved}


def staleness(status: DataFrame, as_of, days: float = STALE_AFTER_DAYS) -> DataFrame:
    """HEALTHY where the mode was updated lately, else STALE."""
    fresh = F.col("last_updated") > clock(as_of) - interval_days(days)
    return status.select("table_name", F.when(fresh, "HEALTHY").otherwise("STALE").alias("health"), "last_updated")
