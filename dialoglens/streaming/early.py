"""Calls as soon as they can be published, and once more when they have ended.

Per call the state holds counts, channels and times, not texts. A call is told at first sight of enough segments from
all wanted channels (`ended` false), at most once; a timer tells its end (`ended` true) when the watermark has passed
the gap behind its last segment, and removes the state. What is told is a hint to look at the segment table: it holds
each segment once, also where the stream brings one twice, and the ledger keeps a call from being published again.

Calls are kept in buckets of their ids, one state and one timer a bucket: the calls of a bucket are advanced together,
as columns, since a Python call for each of many millions of them would cost more than all other work of a batch.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TOLD = "call_id string, segments bigint, message_count bigint, last_time timestamp, ended boolean"
#: The open calls of a bucket as an Arrow table.
STATE = "calls binary"
BUCKETS = 1024


def ready_calls(segments: DataFrame, required: tuple[str, ...], min_segments: int, lateness: str, gap: str, buckets: int = BUCKETS) -> DataFrame:
    """TOLD rows of a stream of segments."""
    gap_ms = int(pd.Timedelta(gap).total_seconds() * 1000)
    wanted = {f"has_{i}": channel for i, channel in enumerate(required)}
    merged = {"segments": "sum", "message_count": "sum", "last": "max", **dict.fromkeys(wanted, "max"), "told": "max", "due": "min"}

    def combined(calls: pd.DataFrame) -> pd.DataFrame:
        return calls.groupby("call_id", sort=False, dropna=False, as_index=False).agg(merged)

    def counted(frame: pd.DataFrame) -> pd.DataFrame:
        """A chunk of segments as calls; `due` -1 marks those that have new segments."""
        has = {name: (frame["owner"] == channel).astype("int8") for name, channel in wanted.items()}
        last = frame["at"].fillna(0).astype("int64")
        return combined(
            pd.DataFrame({"call_id": frame["call_id"], "segments": 1, "message_count": frame["spoken"].astype("int64"), "last": last, **has, "told": 0, "due": -1})
        )

    def advance(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        known = [_unpacked(state.get[0])] if state.exists else []
        new = [] if state.hasTimedOut else [counted(frame) for frame in frames if len(frame)]
        calls = combined(pd.concat(known + new, ignore_index=True))
        touched = calls["due"] < 0
        # a timer can't be set behind the watermark: such a call ends with the next advance
        calls.loc[touched, "due"] = (calls["last"] // 1000 + gap_ms).clip(lower=watermark + 1)
        ready = touched & (calls["told"] == 0) & (calls["segments"] >= min_segments)
        for name in wanted:
            ready &= calls[name] == 1
        calls.loc[ready, "told"] = 1
        over = ~touched & (calls["due"] < watermark)
        left = calls[~over]
        if len(left):
            state.update((_packed(left),))
            state.setTimeoutTimestamp(max(int(left["due"].min()), watermark + 1))
        else:
            state.remove()
        for rows, ended in ((calls[ready], False), (calls[over], True)):
            if len(rows):
                yield _told(rows, ended)

    rows = segments.withWatermark("call_time", lateness).select(
        F.pmod(F.xxhash64("call_id"), F.lit(buckets)).alias("bucket"), "call_id", "call_time", "owner",
        F.coalesce(F.trim("text") != "", F.lit(False)).cast("int").alias("spoken"), F.unix_micros("call_time").alias("at"),
    )
    return rows.groupBy("bucket").applyInPandasWithState(advance, TOLD, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _packed(calls: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(calls, preserve_index=False).replace_schema_metadata()
    kept = io.BytesIO()
    with pa.ipc.new_stream(kept, table.schema) as writer:
        writer.write_table(table)
    return kept.getvalue()


def _unpacked(kept: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(kept).read_all().to_pandas()


def _told(calls: pd.DataFrame, ended: bool) -> pd.DataFrame:
    told = calls[["call_id", "segments", "message_count"]].reset_index(drop=True)
    told["call_id"] = told["call_id"].astype(object).where(told["call_id"].notna(), None)
    return told.assign(last_time=pd.to_datetime(calls["last"].to_numpy(), unit="us"), ended=ended)
