import json

import pytest
from pyspark.sql import functions as F

from dialoglens.plans.adapters import RESULTS, _view
from dialoglens.sources import readers, writers
from dialoglens.session import fresh_path
from dialoglens.sources.store import ChangeTable
from dialoglens.streaming import alerts as alert_stream, config, ingest, results as result_stream


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_change_table(spark):
    table = ChangeTable(spark, fresh_path(spark, "keyed"), "k string, v int", ["k"])
    make = lambda data: spark.createDataFrame(data, "k string, v int")
    assert table.read().count() == 0
    table.put(make([(f"k{i}", i) for i in range(20)] + [(None, 1)]), 0)
    for _ in range(2):  # a repeated batch
        table.put(make([("k3", 33), ("new", 1), (None, 2)]), 1)
    want = sorted([(f"k{i}", i) for i in range(20) if i != 3] + [("k3", 33), ("new", 1)])
    both = lambda: sorted(((r.k or "", r.v) for r in table.read().collect()))
    assert both() == sorted(want + [("", 2)])
    for _ in range(2):
        table.compact()
        assert both() == sorted(want + [("", 2)])
    table.put(make([("k3", 34)]), 2)
    assert ("k3", 34) in both() and len(both()) == len(want) + 1


def test_change_table_takes_the_newest_whatever_the_batch(spark):
    table = ChangeTable(spark, fresh_path(spark, "times"), "k string, v string, at timestamp", ["k"], order="at", time="at")
    make = lambda data: spark.createDataFrame(data, "k string, v string, s int").select("k", "v", F.timestamp_seconds("s").alias("at"))
    table.put(make([("a", "new", 10_000_000), ("b", "one", 5)]), 0)
    table.put(make([("a", "old", 1), ("b", "two", 6)]), 1)
    assert rows(table.read(), "k", "v") == [("a", "new"), ("b", "two")]
    table.compact()
    assert rows(table.read(), "k", "v") == [("a", "new"), ("b", "two")]
    plan = table.changes(F.lit("1970-03-01").cast("date"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_categories_shrink(spark):
    table = ChangeTable(spark, fresh_path(spark, "cats"), "source_id string, category_code string", ["source_id"])
    make = lambda data: spark.createDataFrame(data, "source_id string, category_code string")
    table.put(make([("1", "a"), ("1", "b"), ("1", "c"), ("2", "a")]), 0)
    table.put(make([("1", "z")]), 1, touched=make([("1", "")]))
    assert rows(table.read(), "source_id", "category_code") == [("1", "z"), ("2", "a")]
    table.put(make([]), 2, touched=spark.createDataFrame([("2",)], "source_id string"))
    assert rows(table.read(), "source_id", "category_code") == [("1", "z")]


def results(spark, told):
    """(body, seconds) as messages."""
    return spark.createDataFrame(told, "body string, at int").select(
        F.md5(F.concat("body", F.col("at").cast("string"))).alias("message_id"), F.timestamp_seconds("at").alias("sent_at"), "body"
    )


RESULT = '{{"type": "ML_PROCESSING_RESULT", "callId": "{}", "sourceId": "{}", "summary": "{}", "classifications": ["{}"], "customer_satisfaction": 4}}'


def test_result_replay(spark, db):
    """The same message twice, a newer one, a bad one and one of another type; then all again."""
    good = lambda *what: RESULT.format("1", "CALL", *what)
    bodies = [(good("old", "x"), 1), (good("old", "x"), 1), (good("new", "y"), 2), ('{"callId": "9", ', 1), ('{"type": "OTHER"}', 1)]
    store = result_stream.ResultStore(spark, fresh_path(spark, "store"))
    for _ in range(2):
        result_stream.store_results(results(spark, bodies), db.segments, store, db.as_of, 0)
        assert rows(store.call_summary.read(), "call_id", "summary_text") == [("1", "new")]
        assert rows(store.conversation_category.read(), "source_id", "category_code") == [("1", "y")]
        assert rows(store.error_log.read(), "call_id") == [("9",)]
    # an older result in a later batch changes nothing, and equal times are ordered by message
    result_stream.store_results(results(spark, [(good("late", "z"), 1)]), db.segments, store, db.as_of, 1)
    assert rows(store.call_summary.read(), "call_id", "summary_text") == [("1", "new")]
    assert rows(store.conversation_category.read(), "source_id", "category_code") == [("1", "y")]


def test_results_of_two_sources_with_one_id(spark, db):
    chats = spark.createDataFrame([("7", "chat ban", "s9", "2024-01-30 10:00:00", 1, "C")], "call_id string, ban string, subscriber_no string, t string, seq int, owner string")
    chats = chats.withColumn("call_time", F.col("t").cast("timestamp"))
    store = result_stream.ResultStore(spark, fresh_path(spark, "store"))
    told = [(RESULT.format("7", "CALL", "call", "x"), 1), (RESULT.format("7", "WAPP", "chat", "y"), 1)]
    result_stream.store_results(results(spark, told), lambda: db.segments, store, db.as_of, 0, chats=lambda: chats)
    assert rows(store.call_summary.read(), "source_type", "summary_text") == [("CALL", "call"), ("WAPP", "chat")]
    found = {r.source_type: r.ban for r in store.conversation_summary.read().collect()}
    assert found["WAPP"] == "chat ban" and found["CALL"] != "chat ban"


def test_whole_texts_are_stored(spark, db):
    store = result_stream.ResultStore(spark, fresh_path(spark, "store"))
    result_stream.store_results(results(spark, [(RESULT.format("1", "CALL", "s" * 9000, "c" * 600), 1)]), db.segments, store, db.as_of, 0)
    assert store.call_summary.read().select(F.length("summary_text"), F.length("classification_primary")).first() == (9000, 600)
    assert store.conversation_category.read().select(F.length("category_code")).first() == (600,)


def test_bad_messages_are_tried_again_and_then_set_aside(spark, db):
    store = result_stream.ResultStore(spark, fresh_path(spark, "store"))
    messages = results(spark, [('{"callId": "9", ', 1)]).withColumn("attempts", F.lit(0))
    for batch in range(writers.MAX_RETRIES):
        result_stream.store_results(messages, db.segments, store, db.as_of, batch)
        messages = spark.read.schema(result_stream.MESSAGES).json(f"{store.path}/retry/batch={batch}")
        assert messages.count() == (batch < writers.MAX_RETRIES - 1)
    assert rows(store.dead_letters.read(), "call_id", "total_attempts") == [("9", writers.MAX_RETRIES)]
    assert rows(store.error_log.read(), "call_id") == [("9",)]


def test_the_stream_reads_what_it_queues_again(spark, db):
    """A message that can't be read is tried MAX_RETRIES times by the stream itself; others are stored once."""
    out = fresh_path(spark, "retried")
    store, path = result_stream.ResultStore(spark, out), f"{out}/inbox"
    told = [('{"callId": "9", ', 1), (RESULT.format("1", "CALL", "good", "x"), 1)]
    results(spark, told).write.json(path)
    result_stream.drain(result_stream.message_stream(spark, path), lambda: db.segments, store, f"{out}/state", db.as_of)
    assert rows(store.dead_letters.read(), "call_id", "total_attempts") == [("9", writers.MAX_RETRIES)]
    assert rows(store.call_summary.read(), "call_id", "summary_text") == [("1", "good")]
    results(spark, [('{"callId": "8", ', 2)]).write.mode("append").json(path)
    result_stream.drain(result_stream.message_stream(spark, path), lambda: db.segments, store, f"{out}/state", db.as_of)
    assert rows(store.dead_letters.read(), "call_id", "total_attempts") == [("8", writers.MAX_RETRIES), ("9", writers.MAX_RETRIES)]


SEGMENTS = "call_id string, ban string, subscriber_no string, owner string, text string, call_time timestamp, queue_name string, seq bigint"
SPEC = readers.SourceSpec("calls", "segments", "call_id", "call_time", "call_time", ("A", "C"), 2, "CALL")


def talk(spark, path, calls):
    """Append a file with two segments for each (call, hour); the last pushes the watermark."""
    made = [(c, "b", "s", o, "hi", f"2024-01-0{1 + h // 24} {h % 24:02d}:0{k}:00", None, k) for c, h in calls for k, o in enumerate("AC")]
    frame = spark.createDataFrame(made, SEGMENTS.replace("call_time timestamp", "t string")).withColumn("call_time", F.col("t").cast("timestamp"))
    frame.select(*[f.split()[0] for f in SEGMENTS.split(", ")]).coalesce(1).write.mode("append").parquet(path)


def sent(spark, out):
    found = spark.read.json(f"{out}/messages").select(F.get_json_object("body", "$.callId").alias("c")).collect()
    return sorted(r.c for r in found)


def test_ingest_sees_segments_that_come_later(spark):
    path, out = fresh_path(spark, "live"), fresh_path(spark, "ingest")
    talk(spark, path, [("1", 0), ("2", 1)])
    run = lambda: ingest.ingest_stream(
        ingest.segment_stream(spark, path, 1), lambda: spark.read.parquet(path), SPEC, out, f"{out}/state", interval="1 second"
    )
    stream = run()
    stream.processAllAvailable()
    talk(spark, path, [("3", 20), ("4", 21)])
    stream.processAllAvailable()
    talk(spark, path, [("9", 60)])
    talk(spark, path, [("10", 90)])
    stream.processAllAvailable()
    stream.stop()
    assert sent(spark, out) == ["1", "2", "3", "4", "9"]
    assert {r.call_id for r in ingest.ledger_table(spark, out).read().collect()} == {"1", "2", "3", "4", "9"}
    from dialoglens.session import list_folders, work_dir

    assert not list_folders(spark, work_dir(spark), "ingest-0-")


def test_ingest_repeats_a_batch_that_was_not_committed(spark):
    import pathlib

    path, out = fresh_path(spark, "live"), fresh_path(spark, "ingest")
    talk(spark, path, [("1", 0), ("2", 1)])
    talk(spark, path, [("3", 60)])
    run = lambda: ingest.ingest_stream(
        ingest.segment_stream(spark, path), lambda: spark.read.parquet(path), SPEC, out, f"{out}/state", interval=None
    ).awaitTermination()
    run()
    commits = sorted(pathlib.Path(out.removeprefix("file://"), "state/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    assert sent(spark, out) == ["1", "2"]
    for commit in commits[-1:]:
        commit.unlink()
        commit.with_name(f".{commit.name}.crc").unlink(missing_ok=True)
    run()
    assert sent(spark, out) == ["1", "2"] and ingest.stream_status(spark, out).first().total_processed == 2


def test_slots_with_null_accounts_count_once(spark):
    slots = alert_stream.slot_table(spark, fresh_path(spark, "slots"))
    for n in (1, 2, 3):
        slots.put(spark.createDataFrame([("2024-01-01 00:05:00", None, n)], "t string, ban string, n bigint").select(F.col("t").cast("timestamp").alias("slot_end"), "ban", "n"), n)
    assert rows(slots.read(), "n") == [(3,)]


def test_a_broken_configuration_leaves_the_last_good_one(spark):
    path = fresh_path(spark, "config")
    words = [(f"c{k}", "strong", f"w{k}") for k in range(12)]
    write = lambda data: spark.createDataFrame(data, "category string, strength string, keyword string").coalesce(1).write.mode("overwrite").parquet(path)
    write(words)
    refreshed = config.RefreshedConfig(spark, lambda: spark.read.parquet(path))
    assert refreshed.current().count() == 12
    write(words[:1])
    assert refreshed.current().count() == 12
    from dialoglens.session import delete_path

    delete_path(spark, path)
    assert refreshed.current().count() == 12
    with pytest.raises(NameError):
        config.RefreshedConfig(spark, lambda: missing).current()  # noqa: F821


def test_a_large_configuration_is_kept_as_a_copy(spark):
    from dialoglens.session import list_folders, work_dir

    path = fresh_path(spark, "config")
    write = lambda n: spark.range(n).selectExpr("concat('c', id) AS category", "'strong' AS strength", "concat('w', id) AS keyword").coalesce(1).write.mode("overwrite").parquet(path)
    copies = lambda: len(list_folders(spark, work_dir(spark), "config-"))
    before = copies() + 1
    refreshed = config.RefreshedConfig(spark, lambda: spark.read.parquet(path))
    for n, more in ((30_000, 1), (25_000, 1), (2, 1), (40, 0)):
        write(n)
        assert refreshed.current().count() == (25_000 if n == 2 else n) and copies() == before + more


def test_streamed_queries_read_all_files(spark, db):
    from dialoglens.plans.stream_queries import _streamed

    path = fresh_path(spark, "events")
    db.events.repartition(3).write.parquet(path)
    many = db.replaced(events=spark.read.parquet(path))
    out = fresh_path(spark, "copied")
    _streamed(many, "events").writeStream.option("checkpointLocation", f"{out}-state").trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    assert spark.read.parquet(out).count() == db.events.count()


def test_ingest_stream_equals_batch(spark, db):
    """Segments in several files, in time order, as several micro-batches."""
    shared = fresh_path(spark, "segments")
    table = db.segments.withColumn("call_time", F.col("call_time").cast("timestamp")).filter("ban < '3'")
    for day in range(0, 30, 10):
        part = table.filter(f"call_time >= TIMESTAMP '2024-01-01' + INTERVAL {day} DAY AND call_time < TIMESTAMP '2024-01-01' + INTERVAL {day + 10} DAY")
        part.coalesce(1).write.mode("append").parquet(shared)
    spec = readers.SourceSpec("calls", "segments", "call_id", "call_time", "call_time", ("A", "C"), 3, "CALL")
    out = fresh_path(spark, "ingest")
    stream = ingest.segment_stream(spark, shared, 1)
    stored = spark.read.parquet(shared)
    ingest.ingest_stream(stream, stored, spec, out, f"{out}/state", db.as_of, interval=None).awaitTermination()
    ledger = ingest.ledger_table(spark, out).read()
    end = stored.agg(F.max("call_time") - F.expr("INTERVAL 530 MINUTE")).first()[0]
    done = {r[0] for r in stored.groupBy("call_id").agg(F.max("call_time").alias("t")).filter(F.col("t") <= F.lit(end)).collect()}
    assert {r.call_id for r in ledger.collect()} == done
    from dialoglens.operators.assemble import assemble_conversations

    batch = {r.call_id: r.message_count for r in assemble_conversations(stored, ("A", "C"), 3, "CALL", db.as_of).collect() if r.call_id in done}
    sent = spark.read.json(f"{out}/messages").select(F.from_json("body", "callId string, messageCount int").alias("b"))
    assert {r.b.callId: r.b.messageCount for r in sent.collect()} == batch
    status = ingest.stream_status(spark, out).first()
    assert status.total_processed == len(done)


def test_month_partitions(spark, db):
    path = fresh_path(spark, "months")
    writers.write_partitioned(db.subscriber, "sub_status_date", path)
    assert spark.read.parquet(path).count() == db.subscriber.count()
    assert writers.expire_partitions(spark, path, 1, db.as_of) == ["month=2023-12-01"]
    from dialoglens.functions.timing import in_month_range

    recent = in_month_range(spark.read.parquet(path), "sub_status_date", 3, db.as_of)
    assert "PartitionFilters: [isnotnull(month" in recent._jdf.queryExecution().toString()


def test_result_schema_is_stable(spark, db):
    raw = _view(db.events, RESULTS)
    from dialoglens.operators.results import normalize_results

    columns = normalize_results(readers.read_results(raw)).columns
    assert columns[:3] == ["call_id", "source_type", "customer_id"] and columns[-1] == "churn_score"


def test_configuration_with_what_was_approved(spark):
    from dialoglens.operators import workflow

    kinds = "rec_id string, rec_type string, status string, rec_details string, created_at int"
    told = [("1", "churn_keywords", "APPROVED", '{"keywords": ["leave", "go \\"now\\""]}', 1), ("2", "churn_keywords", "PENDING", '{"keywords": ["no"]}', 1),
            ("3", "churn_threshold", "APPROVED", '{"recommended_value": 45}', 2)]
    before = '{"version": "a b", "classifications": [{"name": "x"}], "churn_detection": {"enabled": true, "keywords": ["leave"], "threshold": 70}}'
    path = fresh_path(spark, "config")
    made = workflow.updated_config(spark.createDataFrame([(before,)], "config string"), spark.createDataFrame(told, kinds), 70)
    workflow.write_config(made, path)
    assert json.loads(spark.read.text(path).first()[0]) == {
        "version": "a b", "classifications": [{"name": "x"}],
        "churn_detection": {"enabled": True, "keywords": ["leave", 'go "now"'], "threshold": 45.0},
    }
    assert readers.read_prototypes(spark, path).count() == 0 and readers.read_categories(spark, path).count() == 1


def test_reports_prune_months(spark, db):
    from dialoglens.operators import calls, kpi

    stored = {}
    for name, time in (("conversation_summary", "conversation_time"), ("segments", "call_time")):
        path = fresh_path(spark, name)
        writers.write_partitioned(getattr(db, name), time, path)
        stored[name] = spark.read.parquet(path)
    months = db.replaced(**stored)
    for report in (lambda d: kpi.summary_kpis(d, days=7), lambda d: calls.recent_conversations(d, 7), lambda d: calls.high_risk_calls(d, days=7)):
        made = report(months)
        assert "PartitionFilters: [isnotnull(month" in made._jdf.queryExecution().toString()
        assert sorted(map(str, made.collect())) == sorted(map(str, report(db).collect()))
