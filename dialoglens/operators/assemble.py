"""Segments to conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dialoglens.functions.text import not_blank
from dialoglens.functions.timing import clock, to_iso
from dialoglens.operators.skew import collect_in_parts

TOO_SHORT = "SKIPPED_TOO_SHORT"
MISSING_CHANNEL = "SKIPPED_MISSING_CHANNEL"


def missing_channels(required: tuple[str, ...], seen: Column) -> Column:
    return F.array_except(F.array(*[F.lit(c) for c in required]), seen)


def skip_reason(segments: Column, missing: Column, min_segments: int) -> Column:
    return F.when(segments < min_segments, TOO_SHORT).when(F.size(missing) > 0, MISSING_CHANNEL)


def conversation_stats(segments: DataFrame, required: tuple[str, ...], min_segments: int) -> DataFrame:
    """Per call: segment counts, channels, what is missing, why it is skipped, and its header.

    All of it is one aggregation with map-side combine; the channels of a call are few.
    """
    header = F.min_by(F.struct("ban", "subscriber_no", "call_time"), F.struct("call_time", "seq", "owner"))
    stats = segments.groupBy("call_id").agg(
        F.count(F.lit(1)).alias("segments"),
        F.count_if(not_blank(F.col("text"))).alias("message_count"),
        F.sort_array(F.collect_set("owner")).alias("channels"),
        header.alias("header"),
        F.max("call_time").alias("last_time"),
    )
    missing = missing_channels(required, F.col("channels"))
    return stats.withColumn("missing", missing).withColumn(
        "skip_reason", skip_reason(F.col("segments"), F.col("missing"), min_segments)
    )


def assemble_conversations(
    segments: DataFrame,
    required: tuple[str, ...],
    min_segments: int,
    source_type: str,
    as_of,
    strip_text: bool = False,
    stats: DataFrame | None = None,
    **limits,
) -> DataFrame:
    """Eligible calls as documents with their messages in time order, blank ones left out.

    A call of extreme length comes as several numbered parts (`part`, `parts`). `stats` are stored rows of
    `conversation_stats`: then the segments are read once, for the eligible calls of `stats` alone.
    """
    if stats is None:
        stats = conversation_stats(segments, required, min_segments).filter("skip_reason is null")
    else:
        stats = stats.filter("skip_reason is null")
        segments = segments.join(stats.select("call_id"), "call_id", "left_semi")
        limits = {"counts": stats.select("call_id", F.col("message_count").alias("_n")), **limits}
    text = F.trim("text") if strip_text else F.col("text")
    message = F.struct(
        F.col("owner").alias("channel"), text.alias("text"), to_iso(F.col("call_time")).alias("timestamp")
    )
    spoken = segments.filter(not_blank(F.col("text")))
    messages = collect_in_parts(spoken, ["call_id"], ["call_time", "seq", "owner"], message, **limits)
    empty = F.array().cast("array<struct<channel:string,text:string,timestamp:string>>")
    return stats.join(messages, "call_id", "left").select(
        F.lit(source_type).alias("source_type"),
        "call_id",
        "header.*",
        F.coalesce("items", empty).alias("messages"),
        "message_count",
        F.coalesce("part", F.lit(1)).alias("part"),
        F.coalesce("parts", F.lit(1)).alias("parts"),
        "last_time",
        clock(as_of).alias("assembled_at"),
    )


def skipped_calls(stats: DataFrame, source_type: str) -> DataFrame:
    """Ledger input for calls that are not sent on."""
    return stats.filter("skip_reason is not null").select(
        F.lit(source_type).alias("source_type"), "call_id", F.col("skip_reason").alias("sqs_message_id")
    )
