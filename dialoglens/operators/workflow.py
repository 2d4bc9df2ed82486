"""Decisions of people applied to alerts, rules, recommendations and configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dialoglens.functions.timing import clock
from dialoglens.sources.writers import row_id

REQUIRED_RULE_FIELDS = ["alert_name", "metric_source", "metric_name", "condition_operator", "threshold_value"]
EDITABLE_RULE_FIELDS = [
    "alert_name", "alert_name_he", "alert_type", "metric_source", "metric_name", "condition_operator", "threshold_value",
    "time_window_hours", "filter_product", "filter_sentiment", "severity", "description",
]


def apply_alert_actions(history: DataFrame, actions: DataFrame) -> DataFrame:
    """History after a batch of `history_id, action, actor, notes, at`.

    Only an ACTIVE alert can be acknowledged, only an ACTIVE or ACKNOWLEDGED one resolved.
    So of many actions on an alert two matter: the first resolve, and the first acknowledge
    if it comes before that.
    """
    when = F.struct("at", "actor", "notes")
    folded = actions.groupBy("history_id").agg(
        F.min(F.when(F.col("action") == "acknowledge", when)).alias("_ack"),
        F.min(F.when(F.col("action") == "resolve", when)).alias("_res"),
    )
    joined = history.join(folded, "history_id", "left")
    ack_first = F.col("_ack").isNotNull() & (F.col("_res").isNull() | (F.col("_ack.at") < F.col("_res.at")))
    acknowledged = (F.col("status") == "ACTIVE") & ack_first
    resolved = F.col("status").isin("ACTIVE", "ACKNOWLEDGED") & F.col("_res").isNotNull()

    def changed(condition, value, column: str):
        kept = F.col(column) if column in history.columns else F.lit(None)
        return F.when(condition, value).otherwise(kept)

    updates = {
        "acknowledged_by": changed(acknowledged, F.col("_ack.actor"), "acknowledged_by"),
        "acknowledged_at": changed(acknowledged, F.col("_ack.at"), "acknowledged_at"),
        "resolved_by": changed(resolved, F.col("_res.actor"), "resolved_by"),
        "resolved_at": changed(resolved, F.col("_res.at"), "resolved_at"),
        "resolution_notes": changed(resolved, F.col("_res.notes"), "resolution_notes"),
        "status": F.when(resolved, "RESOLVED").when(acknowledged, "ACKNOWLEDGED").otherwise(F.col("status")),
    }
    return joined.withColumns(updates).drop("_ack", "_res")


def invalid_rules(changes: DataFrame) -> DataFrame:
    """Create requests that lack a required field, with the first one missing."""
    missing = F.coalesce(*[F.when(F.col(f).isNull(), F.lit(f)) for f in REQUIRED_RULE_FIELDS])
    return changes.filter("action = 'create'").withColumn("missing", missing).filter("missing is not null")


def _with_defaults(changes: DataFrame) -> DataFrame:
    return changes.withColumns(
        {
            "alert_type": F.coalesce("alert_type", F.lit("threshold")),
            "time_window_hours": F.coalesce("time_window_hours", F.lit(24.0)),
            "severity": F.coalesce("severity", F.lit("WARNING")),
        }
    )


def apply_rule_changes(rules: DataFrame, changes: DataFrame, as_of) -> DataFrame:
    """Rules after a batch of changes: `action` is create, update, toggle or delete.

    Per rule the last update counts, toggles flip by their parity, a delete wins. Rules
    created in the batch get the defaults and an id from their name.
    """
    fields = [c for c in EDITABLE_RULE_FIELDS if c in rules.columns]
    complete = F.lit(True)
    for f in REQUIRED_RULE_FIELDS:
        complete = complete & F.col(f).isNotNull()
    created = _with_defaults(changes.filter("action = 'create'").filter(complete)).select(
        row_id("alert_name").alias("alert_id"), *fields, F.lit(True).alias("is_enabled"), clock(as_of).alias("created_at")
    )

    updated = _with_defaults(changes.filter("action = 'update'")).select("alert_id", "at", *fields)
    last = updated.groupBy("alert_id").agg(F.max_by(F.struct(*fields), "at").alias("_new"))
    flips = (
        changes.filter("action = 'toggle'").groupBy("alert_id").agg((F.count(F.lit(1)) % 2 == 1).alias("_flip"))
    )
    deleted = changes.filter("action = 'delete'").select("alert_id").distinct()
    kept = rules.join(deleted, "alert_id", "left_anti").join(last, "alert_id", "left").join(flips, "alert_id", "left")
    edits = {
        f: F.when(F.col("_new").isNotNull(), F.col(f"_new.{f}")).otherwise(F.col(f)) for f in fields
    }
    edits["is_enabled"] = F.when(F.coalesce("_flip", F.lit(False)), ~F.col("is_enabled")).otherwise(F.col("is_enabled"))
    changed = kept.withColumns(edits).drop("_new", "_flip")
    return changed.unionByName(created, allowMissingColumns=True)


def cascade_deletes(history: DataFrame, changes: DataFrame) -> DataFrame:
    """History without the alerts of deleted rules."""
    deleted = changes.filter("action = 'delete'").select("alert_id").distinct()
    return history.join(deleted, "alert_id", "left_anti")


def apply_recommendation_decisions(recommendations: DataFrame, decisions: DataFrame) -> DataFrame:
    """Recommendations after `rec_id, decision, actor, reason, at`; the first decision on a pending one counts."""
    first = decisions.groupBy("rec_id").agg(F.min(F.struct("at", "decision", "actor", "reason")).alias("_d"))
    joined = recommendations.join(first, "rec_id", "left")
    open_now = F.col("status") == "PENDING"
    approved = open_now & (F.col("_d.decision") == "approve")
    rejected = open_now & (F.col("_d.decision") == "reject")
    note = F.concat(F.lit("Rejected by "), "_d.actor", F.lit(": "), F.coalesce("_d.reason", F.lit("")))
    present = lambda c: F.col(c) if c in recommendations.columns else F.lit(None)
    return joined.withColumns(
        {
            "approved_by": F.when(approved, F.col("_d.actor")).otherwise(present("approved_by")),
            "approved_at": F.when(approved, F.col("_d.at")).otherwise(present("approved_at")),
            "notes": F.when(rejected, note).otherwise(present("notes")),
            "status": F.when(approved, "APPROVED").when(rejected, "REJECTED").otherwise(F.col("status")),
        }
    ).drop("_d")


def merge_keywords(existing: DataFrame, recommended: DataFrame) -> DataFrame:
    """Listed keywords and recommended ones, each once."""
    return existing.select("keyword").union(recommended.select("keyword")).distinct()


def recommended_keywords(approved: DataFrame) -> DataFrame:
    listed = F.from_json("rec_details", "keywords array<string>")["keywords"]
    rows = approved.filter("rec_type = 'churn_keywords' and status = 'APPROVED'")
    return rows.select(F.explode(listed).alias("keyword")).distinct()


def recommended_threshold(approved: DataFrame, current: float) -> DataFrame:
    """Threshold of the latest approved change, on the 0–100 scale; the current one without any."""
    value = F.from_json("rec_details", "recommended_value double")["recommended_value"]
    rows = approved.filter("rec_type = 'churn_threshold' and status = 'APPROVED'").withColumn("value", value)
    return rows.filter("value is not null").agg(
        F.coalesce(F.max_by("value", F.struct("created_at", "rec_id")), F.lit(float(current))).alias("threshold")
    )


def updated_config(config: DataFrame, recommendations: DataFrame, current_threshold: float) -> DataFrame:
    """The configuration with what was approved: `config` is one JSON text, and so is the result.

    Approved churn keywords join those listed under `churn_detection.keywords`, each once and in order, and the latest
    approved threshold becomes `churn_detection.threshold`. All other fields stay.
    """
    fields = F.from_json("config", "map<string,string>")
    churn = F.from_json(F.coalesce(F.try_element_at(fields, F.lit("churn_detection")), F.lit("{}")), "map<string,string>")
    # configuration: a few words and one number
    found = F.lit(sorted(r.keyword for r in recommended_keywords(recommendations).collect())).cast("array<string>")
    listed = F.from_json(F.try_element_at(churn, F.lit("keywords")), "array<string>")
    words = F.array_distinct(F.concat(F.coalesce(listed, F.array().cast("array<string>")), found))
    threshold = F.lit(recommended_threshold(recommendations, current_threshold).first()[0])
    changed = F.create_map(F.lit("keywords"), F.to_json(words), F.lit("threshold"), threshold.cast("string"))
    inner = F.map_concat(F.map_filter(churn, lambda k, _: ~k.isin("keywords", "threshold")), changed)
    outer = F.map_concat(F.map_filter(fields, lambda k, _: k != "churn_detection"), F.create_map(F.lit("churn_detection"), json_object(inner)))
    return config.select(json_object(outer).alias("config"))


def json_object(fields: Column) -> Column:
    """JSON object of a map from names to JSON texts; a text that isn't JSON becomes a string."""
    is_json = lambda v: F.try_parse_json(v).isNotNull()
    value = lambda v: F.when(is_json(v), v).otherwise(quoted(v))
    pairs = F.transform(F.map_entries(fields), lambda e: F.concat(quoted(e["key"]), F.lit(":"), F.coalesce(value(e["value"]), F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(F.array_sort(pairs), ","), F.lit("}"))


def quoted(text: Column) -> Column:
    """A JSON string."""
    whole = F.to_json(F.struct(text.alias("v")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def write_config(config: DataFrame, path: str) -> None:
    """Store a configuration as one text file that the configuration readers take."""
    config.select(F.col("config").alias("value")).coalesce(1).write.mode("overwrite").text(path)
