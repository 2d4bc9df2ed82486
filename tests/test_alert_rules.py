"""Very many rules with windows of their own beside plain Python."""

import datetime
import random

from dialoglens.operators import alerts

AS_OF = datetime.datetime(2024, 1, 31)
RULE = "alert_id string, metric_name string, time_window_hours double, filter_product string"


def made_rules(spark, db, n):
    draw = random.Random(6)
    products = [r[0] for r in db.subscriber.select("product_code").distinct().limit(3).collect()]
    metrics = ["high_risk_count", "negative_count", "low_satisfaction_count", "avg_churn_score", "call_volume", "error_count"]
    rows = [(f"r{k}", draw.choice(metrics), draw.choice([None, 24.0]) if k < 40 else 1 + k * 800.0 / n, draw.choice([None, *products])) for k in range(n)]
    rows = [(i, m, w, None if m == "error_count" else p) for i, m, w, p in rows]
    return rows, spark.createDataFrame(rows, RULE)


def plain(value):
    return None if value is None else round(float(value), 6)


def test_twenty_thousand_windows(spark, db):
    rows, rules = made_rules(spark, db, 20_000)
    found = {r.alert_id: plain(r.metric_value) for r in alerts.rule_values(db, rules).collect()}
    told = [(r.conversation_time, r.ban, r.churn_score, r.sentiment, r.satisfaction) for r in db.conversation_summary.collect()]
    owners = {}
    for r in db.subscriber.collect():
        owners.setdefault(r.product_code, set()).add(r.customer_ban)
    errors = sorted(r[0] for r in db.error_log.select("error_timestamp").collect() if r[0] is not None)
    naive = lambda t: t.replace(tzinfo=None)
    assert set(found) == {i for i, *_ in rows}
    for alert, metric, hours, product in rows[:60] + rows[60::400]:
        first = AS_OF - datetime.timedelta(hours=hours) if hours is not None else None
        if metric == "error_count":
            want = 0 if first is None else sum(naive(t) > first for t in errors)
        else:
            inside = [t for t in told if first is not None and t[0] is not None and naive(t[0]) > first and (product is None or t[1] in owners[product])]
            scores = [float(t[2]) for t in inside if t[2] is not None]
            want = {
                "high_risk_count": sum(x >= 70 for x in scores), "call_volume": len(inside),
                "low_satisfaction_count": sum(t[4] is not None and t[4] < 3 for t in inside),
                "avg_churn_score": round(sum(scores) / len(scores) + 1e-9, 1) if scores else None,
            }.get(metric, "unknown")
        if want != "unknown":
            assert found[alert] is None if want is None else abs(found[alert] - want) <= (0.11 if metric == "avg_churn_score" else 0), (alert, metric, hours, product)


def test_rows_behind_rules_of_one_class(spark, db):
    """Rules that share metric and product get the leading rows of their own window."""
    rows = [(f"r{k}", "high_risk_count", h, None) for k, h in enumerate([24.0, 24.0, 100.0, 500.0, 700.0, None])]
    rules = spark.createDataFrame(rows, RULE)
    shown = alerts.affected_by_rule(db, rules, 7).collect()
    counts = {r.alert_id: r.affected for r in alerts.affected_counts(db, rules).collect()}
    naive = lambda t: t.replace(tzinfo=None)
    told = [r for r in db.conversation_summary.collect() if r.churn_score is not None and r.churn_score >= 70]
    for alert, _, hours, _ in rows:
        inside = [r for r in told if hours is not None and naive(r.conversation_time) > AS_OF - datetime.timedelta(hours=hours)]
        best = sorted((-float(r.churn_score) for r in inside))[:7]
        got = sorted(-float(r.churn_score) for r in shown if r.alert_id == alert)
        assert got == best if len(inside) else not got
        assert (counts.get(alert, 0) >= len(inside)) and (alert in counts) == bool(inside)
