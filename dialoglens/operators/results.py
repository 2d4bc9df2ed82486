"""Model responses and result messages in one fixed schema."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from dialoglens.functions.numbers import churn_score_100
from dialoglens.functions.text import (
    action_items_text,
    canonical_key,
    coerce_list,
    json_kind,
    json_to_csv,
    let,
    number_or_text_score,
    repair_json,
    satisfaction_to_int,
    sentiment_to_int,
    sentiment_word_to_int,
    strip,
    strip_abbrev_quotes,
    truncation_class,
    truthy,
)
from dialoglens.functions.timing import clock, parse_iso
from dialoglens.operators.joins import lookup_customer

# fixed values: defaults of the stored results
NO_CATEGORY = "unknown"
DEFAULT_CATEGORY = "בירור כללי"
DEFAULT_MODEL = "dictalm-2.0"


@dataclass(frozen=True)
class Widths:
    """Most characters of stored texts, for a target with narrow columns; None keeps texts whole."""

    summary: int | None = None
    label: int | None = None
    listed: int | None = None
    category: int | None = None
    model: int | None = None


WHOLE = Widths()


def _cut(text: Column, width: int | None) -> Column:
    return text if width is None else F.substring(text, 1, width)


def _text(name: str) -> Column:
    return F.col(f"result.{name}")


def _given(name: str) -> Column:
    """Text of a field, NULL where it is absent or empty."""
    text = _text(name)
    return F.when(~text.isin("", "[]", "{}", "false"), text)


def _inside(name: str, inner: str) -> Column:
    """Non-empty field of a field that is an object, else NULL."""
    value = F.get_json_object(_text(name), f"$.{inner}")
    return F.when(_is_object(name) & ~value.isin("", "[]", "{}"), value)


def _is_object(name: str) -> Column:
    return F.coalesce(F.startswith(_text(name), F.lit("{")), F.lit(False))


def _entries(text: Column) -> Column:
    """Entries of a text that is a JSON list with any, else NULL."""
    items = F.from_json(F.when(F.startswith(text, F.lit("[")), text), "array<string>")
    return let(items, lambda found: F.when(F.size(found) > 0, found))


def distinct_categories(labels: Column) -> Column:
    """Without blanks and repetitions, in the given order."""
    return F.array_distinct(F.filter(labels, lambda c: F.nullif(F.trim(c), F.lit("")).isNotNull()))


def primary_category(widths: Widths = WHOLE) -> Column:
    label = F.coalesce(
        _inside("classification", "primary"),
        F.get(_entries(_given("classifications")), 0),
        _given("classification"),
        F.lit(NO_CATEGORY),
    )
    return _cut(label, widths.label)


def all_categories_text() -> Column:
    own, many = _inside("classification", "all"), _given("classifications")
    listed = F.when(_inside("classification", "primary").isNotNull(), F.coalesce(F.array_join(_entries(own), ", "), own))
    return F.coalesce(
        F.when(_inside("classification", "primary").isNull(), F.array_join(_entries(many), ", ")).otherwise(listed), F.lit("")
    )


def category_labels(widths: Widths = WHOLE) -> Column:
    """Labels for the category table: the list, else the detailed list, else the main label."""
    many = _given("classifications")
    labels = F.coalesce(
        _entries(many),
        F.when(~F.startswith(many, F.lit("[")), F.array(many)),
        _entries(_inside("classification", "all")),
        F.array(primary_category(widths)),
    )
    return F.transform(distinct_categories(labels), lambda c: _cut(c, widths.category))


def summary_text(widths: Widths = WHOLE) -> Column:
    inner = F.when(_is_object("summary"), F.get_json_object(_text("summary"), "$.text")).otherwise(_given("summary"))
    return _cut(F.coalesce(inner, F.lit("")), widths.summary)


def sentiment_score() -> Column:
    """Words and numbers as 1–5; an absent, empty or zero value is neutral."""
    plain = F.nullif(_given("sentiment"), F.lit("0"))
    return sentiment_to_int(
        F.when(_is_object("sentiment"), F.get_json_object(_text("sentiment"), "$.overall")).otherwise(plain)
    )


def normalize_results(parsed: DataFrame, widths: Widths = WHOLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Good result messages as typed columns, one row per message, and the columns in `keep`."""
    either = lambda a, b: F.coalesce(_given(a), _given(b))
    rows = parsed.filter("verdict = 'ok'")
    return rows.select(
        F.coalesce(_text("callId"), F.lit("UNKNOWN")).alias("call_id"),
        F.coalesce(_text("sourceId"), F.lit("CALL")).alias("source_type"),
        either("ban", "customerId").alias("customer_id"),
        either("subscriberNo", "subscriber_no").alias("subscriber_no"),
        parse_iso(either("callTime", "call_time")).alias("call_time"),
        summary_text(widths).alias("summary_text"),
        sentiment_score().alias("sentiment"),
        primary_category(widths).alias("classification_primary"),
        all_categories_text().alias("classification_all"),
        category_labels(widths).alias("categories"),
        F.coalesce(_text("confidence").try_cast("double"), F.lit(0.0)).alias("confidence_score"),
        F.coalesce(_text("processingTime").try_cast("bigint"), F.lit(0)).alias("ml_processing_time_ms"),
        _cut(F.coalesce(_text("modelVersion"), F.lit(DEFAULT_MODEL)), widths.model).alias("ml_model_version"),
        _cut(json_to_csv(_text("products")), widths.listed).alias("products"),
        action_items_text(_text("action_items"), widths.listed).alias("action_items"),
        _cut(json_to_csv(_text("unresolved_issues")), widths.listed).alias("unresolved_issues"),
        satisfaction_to_int(_text("customer_satisfaction")).alias("satisfaction"),
        churn_score_100(_text("churn_confidence").try_cast("double")).alias("churn_score"),
        *keep,
    )


def latest_per_call(results: DataFrame, *order: str) -> DataFrame:
    """The newest of several results of one call."""
    rest = [c for c in results.columns if c not in ("source_type", "call_id")]
    newest = F.max_by(F.struct(*rest), F.struct(*order, "summary_text")).alias("_row")
    return results.groupBy("source_type", "call_id").agg(newest).select("source_type", "call_id", "_row.*")


def call_summary_rows(results: DataFrame, as_of, keep: tuple[str, ...] = ()) -> DataFrame:
    return results.select(
        "call_id",
        "customer_id",
        "subscriber_no",
        "call_time",
        "summary_text",
        "sentiment",
        "classification_primary",
        "classification_all",
        "confidence_score",
        "ml_processing_time_ms",
        "ml_model_version",
        clock(as_of).alias("processed_at"),
        *keep,
    )


def conversation_summary_rows(results: DataFrame, segments: DataFrame | Mapping[str, DataFrame], as_of, keep: tuple[str, ...] = ()) -> DataFrame:
    """Summary rows with the account, subscriber and time of the call or chat.

    `segments` holds all feeds, or is a mapping of source types to theirs; a type without a feed finds nothing.
    """
    bare = results.drop("subscriber_no")
    if isinstance(segments, Mapping):
        parts = [lookup_customer(bare.filter(F.col("source_type") == kind), feed, as_of) for kind, feed in segments.items()]
        rest = bare.filter(~F.coalesce(F.col("source_type").isin(list(segments)), F.lit(False)))
        absent = {"ban": "string", "subscriber_no": "string", "conversation_time": "timestamp"}
        parts.append(rest.withColumns({name: F.lit(None).cast(kind) for name, kind in absent.items()}))
        known = reduce(DataFrame.unionByName, parts)
    else:
        known = lookup_customer(bare, segments, as_of)
    return known.select(
        "source_type",
        F.col("call_id").alias("source_id"),
        clock(as_of).alias("creation_date"),
        F.col("summary_text").alias("summary"),
        "satisfaction",
        "sentiment",
        "products",
        "unresolved_issues",
        "action_items",
        "ban",
        "subscriber_no",
        "conversation_time",
        "churn_score",
        *keep,
    )


def category_rows(results: DataFrame, as_of, keep: tuple[str, ...] = ()) -> DataFrame:
    return results.select(
        F.col("call_id").alias("source_id"),
        "source_type",
        clock(as_of).alias("creation_date"),
        F.explode("categories").alias("category_code"),
        *keep,
    )


def with_source_type(results: DataFrame, ledger: DataFrame) -> DataFrame:
    """Feed of each result: from the message, for old messages from the ledger, else CALL."""
    known = ledger.groupBy("call_id").agg(F.max("source_type").alias("_ledger_type"))
    return (
        results.join(known, "call_id", "left")
        .withColumn("source_type", F.coalesce("source_type", "_ledger_type", F.lit("CALL")))
        .drop("_ledger_type")
    )


# ---- raw model responses ----------------------------------------------------------------------------


def max_of_sources(transcript: Column, summary: Column) -> Column:
    """The higher of two churn results; the transcript wins a tie."""
    from_summary = summary["churn_score"] > transcript["churn_score"]
    return F.struct(
        F.when(from_summary, summary["is_churn"]).otherwise(transcript["is_churn"]).alias("is_churn"),
        F.when(from_summary, summary["churn_confidence"]).otherwise(transcript["churn_confidence"]).alias("churn_confidence"),
        F.when(from_summary, summary["churn_score"]).otherwise(transcript["churn_score"]).alias("churn_score"),
        F.when(from_summary, "summary").otherwise("transcription").alias("churn_source"),
    )


def fallback_category(*candidates: Column, default: str = DEFAULT_CATEGORY) -> Column:
    """First non-empty list of labels, else the default one."""
    usable = [F.when(F.size(c) > 0, c) for c in candidates]
    return F.coalesce(*usable, F.array(F.lit(default)))


def structure_result(responses: DataFrame, raw: str = "response") -> DataFrame:
    """Raw response text → `success, error` and the summary fields.

    Keys may differ in case and language; of repeated keys the last counts. Rows without
    success keep their input, so that they can be queued again or set aside.
    """
    severe = let(strip_abbrev_quotes(strip(F.col(raw))), truncation_class) == "severe"
    repaired = responses.withColumn("_severe", F.coalesce(severe, F.lit(False)))

    def named(value: Column) -> Column:
        entries = F.map_entries(value.cast("map<string,variant>"))
        present = F.filter(entries, lambda e: truthy(e["value"]))
        return F.transform(
            present, lambda e: F.struct(canonical_key(e["key"]).alias("key"), e["value"].alias("value"))
        )

    def object_fields(value: Column) -> Column:
        return F.when(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), named(value))

    parsed = F.try_parse_json(F.when(~F.col("_severe"), repair_json(F.col(raw))))
    fields = repaired.withColumn("_fields", let(parsed, object_fields))

    def last(name: str) -> Column:
        return F.get(F.filter(F.reverse("_fields"), lambda e: e["key"] == name), 0)["value"]

    names = ["summary", "sentiment", "customer_satisfaction", "products", "action_items", "unresolved_issues"]
    fields = fields.withColumns({f"_{n}": last(n) for n in names})
    field = lambda name: F.col(f"_{name}")

    summary = F.when(json_kind(field("summary")) == "STRING", field("summary").cast("string"))
    error = (
        F.when(F.col("_severe"), "severe_truncation")
        .when(F.col("_fields").isNull(), "invalid_json")
        .when(F.nullif(F.trim(summary), F.lit("")).isNull(), "missing_summary")
    )
    none = F.array().cast("array<string>")
    structured = fields.withColumns(
        {
            "error": error,
            "success": error.isNull(),
            "summary": summary,
            "sentiment": F.coalesce(number_or_text_score(field("sentiment"), sentiment_word_to_int), F.lit(3)),
            "customer_satisfaction": F.coalesce(
                number_or_text_score(field("customer_satisfaction"), satisfaction_to_int), F.lit(3)
            ),
            "products": F.coalesce(coerce_list(field("products"), True), none),
            "action_items": F.coalesce(coerce_list(field("action_items"), False), none),
            "unresolved_issues": F.coalesce(field("unresolved_issues").cast("string"), F.lit("")),
        }
    )
    return structured.drop("_severe", "_fields", *[f"_{n}" for n in names])
