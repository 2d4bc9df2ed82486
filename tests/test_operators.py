from pyspark.sql import functions as F

from dialoglens.operators import assemble, churn, filters, joins, kpi, repeat, skew, workflow
from dialoglens.plans.adapters import AS_OF
from dialoglens.tables import Tables

SEGMENT = "call_id string, ban string, subscriber_no string, owner string, text string, call_time timestamp, queue_name string, seq bigint"


def segments(spark, rows):
    """(call, owner, text, second, queue) → segments."""
    made = [(c, "b", "s", o, t, second, q) for c, o, t, second, q in rows]
    df = spark.createDataFrame(made, "call_id string, ban string, subscriber_no string, owner string, text string, s int, queue_name string")
    return df.withColumns(
        {"call_time": F.expr(f"TIMESTAMP '2024-01-30 12:00:00' + s * INTERVAL 1 SECOND"), "seq": F.col("s").cast("bigint")}
    ).drop("s")


def test_assembly_rules(spark):
    seg = segments(
        spark,
        [("1", "A", "hi", 0, "q"), ("1", "C", " ", 1, "q"), ("1", "C", "yes", 2, "q"), ("2", "A", "x", 0, "q"), ("3", "A", "x", 0, "q"),
         ("3", "A", "y", 1, "q"), ("3", "A", "z", 2, "q")],
    )
    stats = {r.call_id: r.skip_reason for r in assemble.conversation_stats(seg, ("A", "C"), 3).collect()}
    assert stats == {"1": None, "2": assemble.TOO_SHORT, "3": assemble.MISSING_CHANNEL}
    (doc,) = assemble.assemble_conversations(seg, ("A", "C"), 3, "CALL", AS_OF).collect()
    assert [m.text for m in doc.messages] == ["hi", "yes"] and doc.message_count == 2


def test_hot_groups_come_in_ordered_parts(spark):
    """One key holds most rows: its list is cut, whole and in order; the others stay single."""
    rows = spark.range(3000).selectExpr("IF(id % 10 < 7, 'hot', concat('k', id % 100)) AS k", "3000 - id AS o", "id AS v")
    want = {r.k: r.vs for r in rows.groupBy("k").agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "v"))), lambda x: x["v"]).alias("vs")).collect()}
    for limits in ({"part_size": 100}, {"part_size": 100, "max_broadcast_keys": 0}):
        parts = skew.collect_in_parts(rows, ["k"], ["o"], F.col("v"), **limits).orderBy("k", "part").collect()
        joined = {}
        for r in parts:
            assert len(r["items"]) <= 100
            joined.setdefault(r.k, []).extend(r["items"])
        assert joined == want
        assert sum(1 for r in parts if r.k == "hot") >= 21


def test_number_rows(spark):
    df = spark.range(500).selectExpr("id * 7 % 500 AS v")
    assert [r["rank"] for r in skew.number_rows(df, F.asc("v")).orderBy("v").collect()] == list(range(1, 501))


def test_small_side_is_checked(spark):
    assert "broadcast" in skew.small_side(spark.range(5), 5)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in skew.small_side(spark.range(6), 5)._jdf.queryExecution().logical().toString().lower()


def test_call_types(spark):
    """NULL queues belong to neither kind, NULL list entries do not count, a call may be both."""
    seg = segments(
        spark, [("s", "A", "t", 0, "sales"), ("v", "A", "t", 0, "help"), ("b", "A", "t", 0, "help"), ("b", "A", "t", 1, "sales"), ("n", "A", "t", 0, None)]
    )
    cs = spark.createDataFrame([(x,) for x in "svbnx"], "source_id string")
    tables = Tables(spark, {"segments": seg, "sales_queue": spark.createDataFrame([("sales",), (None,)], "queue_name string")}, AS_OF)
    kinds = {k: sorted(r.source_id for r in joins.call_type_filter(cs, tables, k, 7, AS_OF).collect()) for k in ("service", "sales", "all")}
    assert kinds == {"service": ["b", "v"], "sales": ["b", "s"], "all": sorted("svbnx")}
    stored = tables.replaced(call_kinds=joins.call_kinds(seg, tables.sales_queue))
    for kind in kinds:
        assert sorted(r.source_id for r in joins.call_type_filter(cs, stored, kind, 7, AS_OF).collect()) == kinds[kind]


def test_bands(spark):
    scores = spark.createDataFrame([(89.5,), (90.0,), (94.5,), (95.0,), (100.0,), (None,)], "s double")
    pick = lambda strict: [r[0] for r in scores.select(churn.band_of(F.col("s"), churn.BANDS, strict)).collect()]
    assert pick(False) == [2, 1, 1, 0, 0, None]
    assert pick(True) == [None, 1, None, 0, 0, None]


def test_conditions(spark):
    rows = [(5.0, "gt", 4.0), (4.0, "gte", 4.0), (5.0, "lt", 4.0), (4.0, "lte", 4.0), (4.0, "eq", 4.0), (None, "gt", 1.0), (5.0, "near", 5.0)]
    df = spark.createDataFrame(rows, "v double, o string, t double")
    assert [r[0] for r in df.select(filters.check_condition(F.col("v"), F.col("o"), F.col("t"))).collect()] == [True, True, False, True, True, False, False]


def test_alert_life_cycle(spark):
    history = spark.createDataFrame([("a", "ACTIVE"), ("r", "RESOLVED"), ("k", "ACKNOWLEDGED"), ("t", "ACTIVE")], "history_id string, status string")
    actions = spark.createDataFrame(
        [("a", "acknowledge", "x", None, 1), ("r", "acknowledge", "x", None, 1), ("k", "resolve", "y", "ok", 2), ("t", "resolve", "y", "1st", 1),
         ("t", "resolve", "z", "2nd", 2), ("t", "acknowledge", "z", None, 3)],
        "history_id string, action string, actor string, notes string, at int",
    )
    got = {r.history_id: (r.status, r.acknowledged_by, r.resolved_by) for r in workflow.apply_alert_actions(history, actions).collect()}
    assert got == {"a": ("ACKNOWLEDGED", "x", None), "r": ("RESOLVED", None, None), "k": ("RESOLVED", None, "y"), "t": ("RESOLVED", None, "y")}


def test_bucket_and_breakdown_totals(db):
    buckets = repeat.repeat_caller_buckets(db, "all", 30).agg(F.sum("count")).first()[0]
    assert buckets == repeat.caller_counts(db, "all", 30).filter("call_count >= 2").count()
    total = kpi.summary_kpis(db, 30, "all").first().total
    assert kpi.sentiment_breakdown(db, 30, "all").agg(F.sum("count")).first()[0] == total
    assert kpi.churn_distribution_3(db, 30).agg(F.sum("count")).first()[0] == joins.conversations(db, 30, "all", "creation_date").count()
