"""Calls told early by buckets."""

from dialoglens.session import fresh_path
from dialoglens.streaming import early, ingest
from test_early_calls import add


def test_a_bucket_of_many_calls_tells_each_once(spark):
    """All calls share one state: each is told when it is ready, and ends by its own time."""
    path, out = fresh_path(spark, "bucket"), fresh_path(spark, "told")
    add(spark, path, [("1", "A", 0, 0), ("1", "C", 1, 1), ("2", "A", 900, 0), ("3", "A", 2, 0), (None, "A", 3, 0)])
    segments = ingest.segment_stream(spark, path, 1)
    told = early.ready_calls(segments, ("A", "C"), 3, "10 minutes", "30 minutes", buckets=1)
    stream = told.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(processingTime="1 second").start(out)
    found = lambda: sorted(
        ((r.call_id or "-", r.segments, r.ended) for r in spark.read.schema(told.schema).parquet(out).collect())
    )
    stream.processAllAvailable()
    # the watermark has passed the end of 1, 3 and the call without id; 2 is open
    assert found() == [("-", 1, True), ("1", 2, True), ("3", 1, True)]
    add(spark, path, [("2", "C", 905, 1), ("2", "A", 906, 2), ("4", "A", 907, 0)])
    stream.processAllAvailable()
    add(spark, path, [("2", "C", 908, 3)])
    stream.processAllAvailable()
    assert [t for t in found() if t[0] == "2"] == [("2", 3, False)]
    add(spark, path, [("9", "A", 3000, 0)])
    stream.processAllAvailable()
    stream.stop()
    assert [t for t in found() if t[0] in "249"] == [("2", 3, False), ("2", 4, True), ("4", 1, True)]
