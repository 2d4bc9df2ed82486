"""Rolling alert windows from 5-minute sums.

A sliding window of 24 hours every 5 minutes would copy each row 288 times. Here a row adds
to one slot, and a rule adds up the slots of its window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from dialoglens.functions.timing import ago
from dialoglens.operators.alerts import partial_sums
from dialoglens.sources.store import ChangeTable
from dialoglens.streaming.ingest import now

SLOT = "5 minutes"
LATENESS = "500 minutes"
EVALUATION_INTERVAL = "5 minutes"
PARTIALS = (
    "slot_end timestamp, ban string, n bigint, high bigint, critical bigint, negative bigint, positive bigint, "
    "low_satisfaction bigint, score_sum double, score_n bigint, rating_sum double, rating_n bigint"
)


def slot_sums(conversations: DataFrame) -> DataFrame:
    """Partial sums per slot and account, on a stream or a table."""
    slots = conversations.groupBy(F.window("conversation_time", SLOT).alias("slot"), "ban").agg(*partial_sums())
    sums = [c for c in slots.columns if c not in ("slot", "ban")]
    return slots.select(F.col("slot.end").cast("timestamp").alias("slot_end"), "ban", *sums)


def slot_table(spark: SparkSession, path: str) -> ChangeTable:
    """Sums per slot and account, in months of the slots; an account may be NULL."""
    return ChangeTable(spark, path, PARTIALS, ["slot_end", "ban"], time="slot_end")


def longest_window(rules: DataFrame) -> float:
    """Days that the rules look back."""
    return (rules.agg(F.max("time_window_hours")).first()[0] or 0) / 24


def recent_slots(partials: ChangeTable, days: float, as_of) -> DataFrame:
    """The slots of the last `days`; only their months are opened."""
    return partials.read(F.trunc(ago(now(as_of), days), "month"))


def alerts_stream(
    conversations: DataFrame, partials: ChangeTable, checkpoint: str, on_batch=None, interval: str | None = EVALUATION_INTERVAL,
    days: float | None = None, as_of=None,
) -> StreamingQuery:
    """Keep the slots current and call `on_batch(partials, batch_id)`, which judges the rules.

    With `days`, the longest window of the rules, a batch opens the months of that window instead of all slots.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        partials.put(batch, batch_id)
        if on_batch:
            on_batch(partials.read() if days is None else recent_slots(partials, days, as_of), batch_id)

    sums = slot_sums(conversations.withWatermark("conversation_time", LATENESS))
    writer = sums.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return writer.trigger(**({"processingTime": interval} if interval else {"availableNow": True})).start()
