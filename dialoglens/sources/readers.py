"""Table scans, source descriptions, configuration files and message parsing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dialoglens.functions.text import json_kind, not_blank
from dialoglens.functions.timing import since
from dialoglens.operators.filters import chat_base_filter
from dialoglens.operators.joins import handled_calls
from dialoglens.tables import SCHEMAS, Tables

SEGMENT_COLUMNS = ["call_id", "ban", "subscriber_no", "owner", "text", "call_time", "queue_name", "seq"]

# fixed values: message types
CONVERSATION_MESSAGE = "CONVERSATION_ASSEMBLY"
RESULT_MESSAGE = "ML_PROCESSING_RESULT"


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Parquet table with its declared schema: no inference, missing columns are NULL."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def read_segments(df: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Projected segment scan. Texts are whole unless a length is asked for."""
    text = F.col("text") if max_chars is None else F.substring("text", 1, max_chars).alias("text")
    return df.select(*[text if c == "text" else F.col(c) for c in SEGMENT_COLUMNS])


def read_segments_jdbc(
    spark: SparkSession, url: str, table: str, partition_column: str, lower, upper, partitions: int, **options: str
) -> DataFrame:
    """Segment scan from a database, split by ranges of `partition_column` over the executors."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize="10000", **options)
    return reader.options(
        partitionColumn=partition_column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(partitions)
    ).load()


@dataclass(frozen=True)
class SourceSpec:
    """What differs between the feeds of conversations."""

    name: str
    table: str
    id_column: str
    time_column: str
    text_time_column: str
    required_channels: tuple[str, ...]
    min_segments: int
    source_type: str
    lookback_days: float | None = None
    base_filter: Callable[..., DataFrame] | None = None
    strip_text: bool = False
    enabled: bool = True


# fixed values: limits of the two feeds and of the backfill
CALLS = SourceSpec("calls", "segments", "call_id", "call_time", "call_time", ("A", "C"), 11, "CALL")
CHATS = SourceSpec(
    "chats", "chat_segments", "case_id", "case_date", "message_date", ("C",), 5, "WAPP", base_filter=chat_base_filter
)
BACKFILL_MIN_SEGMENTS = 16
BACKFILL_DAYS = 90
NORMAL_LOOKBACK_DAYS = 500 / 1440
NORMAL_LEDGER_DAYS = 1200 / 1440


def read_source(df: DataFrame, spec: SourceSpec, as_of) -> DataFrame:
    """One feed in the common segment layout, tagged with its type."""
    if spec.base_filter:
        df = spec.base_filter(df, as_of)
    if spec.lookback_days is not None:
        df = since(df, spec.time_column, spec.lookback_days, as_of)
    return df.select(
        F.lit(spec.source_type).alias("source_type"),
        F.col(spec.id_column).cast("string").alias("call_id"),
        "ban",
        "subscriber_no",
        "owner",
        F.trim("text").alias("text") if spec.strip_text else F.col("text"),
        F.col(spec.text_time_column).alias("call_time"),
        "seq",
    )


def union_sources(db: Tables, specs: list[SourceSpec]) -> DataFrame:
    """All enabled feeds as one."""
    feeds = [read_source(getattr(db, s.table), s, db.as_of) for s in specs if s.enabled]
    return reduce(DataFrame.unionByName, feeds)


def bulk_scan_calls(
    segments: DataFrame, processed: DataFrame, as_of, days: float = BACKFILL_DAYS, source_type: str = "CALL"
) -> DataFrame:
    """Distinct ids of calls the ledger does not hold for the feed, over a long window."""
    done = handled_calls(since(processed, "text_time", days, as_of), source_type)
    calls = since(segments, "call_time", days, as_of).select("call_id").distinct()
    return calls.join(done, "call_id", "left_anti")


# ---- configuration ------------------------------------------------------------------------------


def _config(spark: SparkSession, path: str) -> DataFrame:
    """The whole file as one variant: its fields may be objects or plain strings."""
    return spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("config"))


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """`pos, category_id, name, description`; entries are objects, or names alone."""
    entries = _config(spark, path).select(
        F.posexplode(F.variant_get("config", "$.classifications", "array<variant>")).alias("pos", "entry")
    )
    is_object = json_kind(F.col("entry")) == "OBJECT"
    field = lambda name: F.try_variant_get("entry", f"$.{name}", "string")
    name = F.when(is_object, field("name")).otherwise(F.col("entry").cast("string"))
    return entries.select(
        "pos",
        F.when(is_object, F.coalesce(field("id"), field("name")))
        .otherwise(F.concat(F.lit("cat_"), F.col("pos").cast("string")))
        .alias("category_id"),
        name.alias("name"),
        F.when(is_object, F.coalesce(field("description"), field("name"))).otherwise(name).alias("description"),
    )


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """`category, strength, keyword`, one row per listed keyword."""
    groups = _config(spark, path).select(
        F.explode(F.variant_get("config", "$.keywords", "map<string,map<string,array<string>>>")).alias("category", "lists")
    )
    lists = groups.select("category", F.explode("lists").alias("strength", "words"))
    return lists.select("category", "strength", F.explode("words").alias("keyword"))


def read_prototypes(spark: SparkSession, path: str) -> DataFrame:
    """`proto_index, text, threshold, enabled`."""
    get = lambda name, kind: F.try_variant_get("config", f"$.churn_detection.{name}", kind)
    return _config(spark, path).select(
        F.posexplode(get("churn_prototypes", "array<string>")).alias("proto_index", "text"),
        F.coalesce(get("threshold", "double"), F.lit(70.0)).alias("threshold"),
        F.coalesce(get("enabled", "boolean"), F.lit(False)).alias("enabled"),
    )


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One text per line; blank lines are left out."""
    return spark.read.text(path).select(F.trim("value").alias("text")).filter(not_blank(F.col("text")))


# ---- checks ---------------------------------------------------------------------------------------

REQUIRED_TABLES = ["segments", "processed_calls", "processing_status", "error_log", "call_summary"]


def check_tables(db: Tables, required: list[str]) -> DataFrame:
    """Per required table: present, columns missing, and its row count."""
    reports = []
    for name in required:
        if name not in db:
            row = [(name, False, None, None)]
            reports.append(db.spark.createDataFrame(row, "table_name string, present boolean, missing string, rows bigint"))
            continue
        table = getattr(db, name)
        wanted = [part.split()[0] for part in SCHEMAS[name].split(", ") if "<" not in part and ">" not in part]
        missing = ",".join(sorted(set(wanted) - set(table.columns)))
        counted = table.agg(F.count(F.lit(1)).alias("rows"))
        reports.append(
            counted.select(
                F.lit(name).alias("table_name"), F.lit(True).alias("present"), F.lit(missing).alias("missing"), "rows"
            )
        )
    return reduce(DataFrame.unionByName, reports)


# ---- messages --------------------------------------------------------------------------------------


# fields of a result message; each may be text, number, list or object, and is kept as its text
RESULT_FIELDS = [
    "type", "callId", "sourceId", "ban", "customerId", "subscriberNo", "subscriber_no", "callTime", "call_time", "summary",
    "sentiment", "classification", "classifications", "confidence", "churn_confidence", "products", "action_items",
    "unresolved_issues", "customer_satisfaction", "processingTime", "modelVersion",
]
_BROKEN = "_broken"


def read_results(messages: DataFrame, body: str = "body") -> DataFrame:
    """Result messages with their fields as texts and a verdict: `ok`, `bad_json` or `other_type`.

    The one-element array keeps later filters above it, so that a body is parsed once.
    """
    schema = ", ".join(f"`{name}` string" for name in [*RESULT_FIELDS, _BROKEN])
    parsed = F.from_json(body, schema, {"columnNameOfCorruptRecord": _BROKEN})

    def judged(value: Column) -> Column:
        broken = value.isNull() | value[_BROKEN].isNotNull()
        other = F.coalesce(value["type"], F.lit("")) != RESULT_MESSAGE
        verdict = F.when(broken, "bad_json").when(other, "other_type").otherwise("ok")
        return F.struct(value.alias("result"), verdict.alias("verdict"))

    return messages.select("*", F.inline(F.transform(F.array(parsed), judged)))


def result_errors(parsed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Bad messages as error rows; messages of other types are skipped, not errors."""
    bad = parsed.filter("verdict = 'bad_json'")
    return bad.select(
        F.regexp_extract("body", '"callId"\\s*:\\s*"([^"]*)"', 1).alias("call_id"),
        F.lit("message is not valid JSON").alias("error_message"),
        F.lit("PROCESSING_ERROR").alias("error_type"),
        F.col("body").alias("original_message"),
        *keep,
    )
