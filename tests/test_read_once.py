"""Calls are prepared from few reads of the segments."""

from pyspark.sql import functions as F

from dialoglens.plans import ingest
from dialoglens.session import fresh_path
from dialoglens.sources import readers
from dialoglens.streaming import ingest as ingest_stream

SPEC = readers.SourceSpec("calls", "segments", "call_id", "call_time", "call_time", ("A", "C"), 2, "CALL")
COLUMNS = "call_id string, ban string, subscriber_no string, owner string, text string, t string, queue_name string, seq bigint"


def stored(spark):
    rows = [
        ("1", "b", "s", "A", "one", "2024-01-01 00:00:00", None, 1), ("1", "b", "s", "C", "two", "2024-01-01 00:01:00", None, 2),
        ("1", "b", "s", "C", " ", "2024-01-01 00:02:00", None, 3), ("2", "b", "s", "A", "x", "2024-01-01 00:00:00", None, 1),
        ("3", "b", "s", "A", "x", "2024-01-01 00:00:00", None, 1), ("3", "b", "s", "C", "y", "2024-01-01 00:00:00", None, 2),
    ]
    path = fresh_path(spark, "segments-once")
    spark.createDataFrame(rows, COLUMNS).withColumn("call_time", F.col("t").cast("timestamp")).drop("t").write.parquet(path)
    return path


def scans(frame):
    """How often the plan reads the segments: their queue, which nothing asks for, stands in the scan alone."""
    return frame._jdf.queryExecution().optimizedPlan().toString().count("queue_name")


def test_calls_are_prepared_from_two_reads(spark):
    path = stored(spark)
    segments, ids = spark.read.parquet(path), spark.createDataFrame([("1",), ("2",), ("9",)], "call_id string")
    documents, handled = ingest.prepare_calls(segments, ids, SPEC, "2024-01-02 00:00:00")
    assert scans(handled) == 0 and scans(documents) == 1
    assert [(r.call_id, [m.text for m in r.messages], r.message_count) for r in documents.collect()] == [("1", ["one", "two"], 2)]
    assert sorted((r.call_id, r.sent) for r in handled.collect()) == [("1", True), ("2", False)]


def test_a_batch_without_calls_does_not_read_the_table(spark):
    path, out = stored(spark), fresh_path(spark, "no-calls")
    # the session gap keeps the calls open: the only batch publishes nothing
    broken = lambda: spark.read.parquet(path).withColumn("text", F.raise_error(F.lit("read")).cast("string"))
    segments = ingest_stream.segment_stream(spark, path, schema=COLUMNS.replace("t string, q", "call_time timestamp, q"))
    ingest_stream.ingest_stream(segments, broken, SPEC, out, f"{out}/state", "2024-01-02 00:00:00", interval=None).awaitTermination()
    assert ingest_stream.ledger_table(spark, out).read().count() == 0
