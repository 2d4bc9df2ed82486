"""Streams with a row of state for each segment keep it on disk."""

import glob
import json

from dialoglens.session import STATE_ON_DISK, fresh_path, state_on_disk
from dialoglens.streaming import ingest
from test_early_calls import add
from test_read_once import SPEC

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def provider(state):
    """The kind of store that a checkpoint was begun with."""
    with open(sorted(glob.glob(f"{state.removeprefix('file:')}/offsets/[0-9]*"))[0]) as log:
        return json.loads(log.read().splitlines()[1])["conf"][PROVIDER].rsplit(".", 1)[-1]


def test_ingest_keeps_its_state_on_disk(spark):
    before = {key: spark.conf.get(key, None) for key in STATE_ON_DISK}
    for early in (False, True):
        path, out = fresh_path(spark, "segments-state"), fresh_path(spark, "state")
        add(spark, path, [("1", "A", 0, 0), ("1", "A", 0, 0), ("1", "C", 1, 1), ("2", "A", 0, 0), (None, "A", 3, 0), ("9", "A", 3000, 0)])
        segments = ingest.segment_stream(spark, path)
        table = lambda path=path: spark.read.parquet(path).distinct()
        ingest.ingest_stream(segments, table, SPEC, out, f"{out}/state", "2024-02-02 00:00:00", interval=None, early=early).awaitTermination()
        assert provider(f"{out}/state") == "RocksDBStateStoreProvider"
        rows = {(r.call_id, r.sqs_message_id.startswith("SKIPPED")) for r in ingest.ledger_table(spark, out).read().collect()}
        assert {("1", False), ("2", True)} <= rows and "9" not in {call for call, _ in rows}
    assert {key: spark.conf.get(key, None) for key in STATE_ON_DISK} == before


def test_a_checkpoint_goes_on_with_its_kind_of_store(spark):
    """A stream begun with state in memory is continued with the new code."""
    path, out = fresh_path(spark, "segments-old"), fresh_path(spark, "sessions")
    add(spark, path, [("1", "A", 0, 0), ("1", "C", 1, 1), ("2", "A", 2, 0)])

    def run():
        calls = ingest.assemble_stream(ingest.segment_stream(spark, path)).select("call_id", "segments")
        writer = calls.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True)
        return writer.start(out)

    run().awaitTermination()
    with state_on_disk(spark):
        add(spark, path, [("1", "A", 0, 0), ("9", "A", 3000, 0)])
        run().awaitTermination()
    assert provider(f"{out}-state") == "HDFSBackedStateStoreProvider"
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [("1", 2), ("2", 1)]
