"""Files of messages that are queued again."""

from dialoglens.session import fresh_path
from dialoglens.streaming import results as result_stream


def test_a_batch_without_failures_queues_no_file(spark, db):
    """An empty file of retries would be new input to the stream that reads them: batches without end."""
    store = result_stream.ResultStore(spark, fresh_path(spark, "no-retry"))
    segments = db.segments
    body = '{"type": "ML_PROCESSING_RESULT", "callId": "1", "summary": "s"}'
    raw = lambda b: spark.createDataFrame([("m", None, b)], "message_id string, sent_at timestamp, body string")
    result_stream.store_results(raw(body), segments, store, db.as_of, 0)
    result_stream.store_results(raw("{"), segments, store, db.as_of, 1)
    queued = lambda batch: len(spark.read.text(f"{store.path}/retry/batch={batch}").inputFiles())
    assert queued(0) == 0 and queued(1) > 0
    result_stream.store_results(raw(body), segments, store, db.as_of, 1)
    assert queued(1) == 0
