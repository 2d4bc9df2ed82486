"""Calls published before they have ended."""

import pytest
from pyspark.sql import functions as F

from dialoglens.session import fresh_path
from dialoglens.sources import readers
from dialoglens.streaming import ingest
from test_storage_and_streams import SEGMENTS

SPEC = readers.SourceSpec("calls", "segments", "call_id", "call_time", "call_time", ("A", "C"), 3, "CALL")


def add(spark, path, told):
    """Append one file of segments (call, owner, minute, seq)."""
    made = [(c, "b", "s", o, "hi", f"2024-01-{1 + m // 1440:02d} {m // 60 % 24:02d}:{m % 60:02d}:00", None, k) for c, o, m, k in told]
    frame = spark.createDataFrame(made, SEGMENTS.replace("call_time timestamp", "t string")).withColumn("call_time", F.col("t").cast("timestamp"))
    frame.select(*[f.split()[0] for f in SEGMENTS.split(", ")]).coalesce(1).write.mode("append").parquet(path)


def sent(spark, out):
    found = spark.read.schema("body string").json(f"{out}/messages").select(F.get_json_object("body", "$.callId").alias("c")).collect()
    return sorted(r.c for r in found)


@pytest.fixture
def live(spark):
    path, out = fresh_path(spark, "live"), fresh_path(spark, "early")

    def run():
        stream = ingest.ingest_stream(
            ingest.segment_stream(spark, path, 1), lambda: spark.read.parquet(path), SPEC, out, f"{out}/state", interval="1 second", early=True
        )
        return stream

    return path, out, run


def test_a_ready_call_is_published_once_before_the_watermark(spark, live):
    path, out, run = live
    add(spark, path, [("1", "A", 0, 0), ("1", "C", 1, 1), ("2", "A", 2, 0), ("2", "A", 3, 1), ("2", "A", 4, 2), ("3", "A", 5, 0)])
    stream = run()
    stream.processAllAvailable()
    assert sent(spark, out) == []
    add(spark, path, [("1", "A", 6, 2), ("2", "A", 6, 3)])
    stream.processAllAvailable()
    # call 1 has three segments and both channels now; no watermark has passed
    assert sent(spark, out) == ["1"]
    stream.stop()
    add(spark, path, [("1", "C", 8, 3), ("2", "C", 9, 4)])
    stream = run()
    stream.processAllAvailable()
    assert sent(spark, out) == ["1", "2"]
    # the end of all three: 1 and 2 are known already, 3 never got ready
    add(spark, path, [("9", "A", 3000, 0)])
    add(spark, path, [("9", "A", 6000, 1)])
    stream.processAllAvailable()
    stream.stop()
    assert sent(spark, out) == ["1", "2"]
    ledger = {r.call_id: r.sqs_message_id for r in ingest.ledger_table(spark, out).read().collect()}
    assert set(ledger) >= {"1", "2", "3"} and ledger["3"] == "SKIPPED_TOO_SHORT" and not ledger["1"].startswith("SKIPPED")


def test_segments_told_twice_make_no_call_ready(spark, live):
    path, out, run = live
    add(spark, path, [("1", "A", 0, 0), ("1", "C", 1, 1)])
    stream = run()
    stream.processAllAvailable()
    # the stream brings a file again under another name, the table holds it once
    other = fresh_path(spark, "table")
    add(spark, other, [("1", "A", 0, 0), ("1", "C", 1, 1)])
    stream.stop()
    add(spark, path, [("1", "A", 0, 0)])
    stream = ingest.ingest_stream(
        ingest.segment_stream(spark, path, 1), lambda: spark.read.parquet(other), SPEC, out, f"{out}/state", interval="1 second", early=True
    )
    stream.processAllAvailable()
    assert sent(spark, out) == [] and ingest.ledger_table(spark, out).read().count() == 0
    stream.stop()
