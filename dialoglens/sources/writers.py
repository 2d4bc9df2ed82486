"""Rows for the engine's tables, and keyed replace between frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dialoglens.functions.numbers import null_to_zero
from dialoglens.functions.timing import clock, interval_days, since
from dialoglens.sources.readers import CONVERSATION_MESSAGE

SENDER = "on-premises-cdc"
MAX_RETRIES = 3


def row_id(*natural_key: str | Column) -> Column:
    """Id from the natural key: the same row gets the same id on a re-run. NULL parts count as such."""
    parts = [F.col(k).cast("string") if isinstance(k, str) else k for k in natural_key]
    return F.md5(F.concat_ws("|", *[F.coalesce(p, F.lit("\0")) for p in parts]))


# ---- conversations out -------------------------------------------------------------------------


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """One outbound message per conversation (part): JSON body and attribute columns."""
    body = F.to_json(
        F.struct(
            F.lit(CONVERSATION_MESSAGE).alias("type"),
            F.col("call_id").alias("callId"),
            "ban",
            F.col("subscriber_no").alias("subscriberNo"),
            F.col("call_time").alias("callTime"),
            "messages",
            F.col("message_count").alias("messageCount"),
            F.col("assembled_at").alias("assembledAt"),
            F.lit(SENDER).alias("source"),
            F.col("source_type").alias("sourceId"),
            "part",
            "parts",
        )
    )
    return conversations.select(
        F.col("call_id").alias("key"),
        body.alias("body"),
        F.lit(CONVERSATION_MESSAGE).alias("message_type"),
        F.lit(SENDER).alias("source"),
        "call_id",
        F.col("source_type").alias("source_id"),
        F.col("assembled_at").alias("timestamp"),
    )


def write_messages(messages: DataFrame, path: str) -> None:
    messages.write.mode("append").json(path)


# ---- keyed replace -------------------------------------------------------------------------------


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`new` in place of the rows of `old` with the same keys."""
    replaced = new.select(*keys).distinct()
    return old.join(replaced, keys, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_call_summary(old: DataFrame, new: DataFrame) -> DataFrame:
    return replace_by_key(old, new, ["call_id"])


def upsert_conversation_summary(old: DataFrame, new: DataFrame) -> DataFrame:
    return replace_by_key(old, new, ["source_type", "source_id"])


def replace_categories(old: DataFrame, new: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """New category rows of each touched conversation; one with none left loses all it had."""
    keys = ["source_id", "source_type"]
    touched = new if touched is None else touched
    kept = old.join(touched.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


# ---- ledger ----------------------------------------------------------------------------------------

LEDGER_KEYS = ["source_type", "call_id"]


def mark_processed(
    handled: DataFrame, segments: DataFrame, ledger: DataFrame, as_of, window_days: float = 1200 / 1440
) -> DataFrame:
    """Ledger rows for handled calls that it does not hold yet, with their last segment time.

    `handled` has `source_type, call_id, sqs_message_id` (message id or skip reason).
    """
    last = since(segments, "call_time", window_days, as_of).groupBy("call_id").agg(F.max("call_time").alias("text_time"))
    fresh = handled.dropDuplicates(LEDGER_KEYS).join(ledger.select(*LEDGER_KEYS), LEDGER_KEYS, "left_anti")
    return fresh.join(last, "call_id", "left").select(
        *LEDGER_KEYS, clock(as_of).alias("processed_at"), "text_time", "sqs_message_id"
    )


def mark_processed_backfill(handled: DataFrame, ledger: DataFrame, as_of) -> DataFrame:
    """As above for calls whose time came along with them; a missing time becomes now."""
    fresh = handled.dropDuplicates(LEDGER_KEYS).join(ledger.select(*LEDGER_KEYS), LEDGER_KEYS, "left_anti")
    return fresh.select(
        *LEDGER_KEYS,
        clock(as_of).alias("processed_at"),
        F.coalesce("text_time", clock(as_of)).alias("text_time"),
        "sqs_message_id",
    )


# ---- errors ------------------------------------------------------------------------------------------


def error_rows(failed: DataFrame, as_of) -> DataFrame:
    return failed.select(
        row_id("call_id", "error_type", "error_message").alias("error_id"),
        "call_id",
        "error_message",
        "error_type",
        F.lit(0).alias("retry_count"),
        clock(as_of).alias("error_timestamp"),
    )


def split_retries(failed: DataFrame, max_retries: int = MAX_RETRIES) -> tuple[DataFrame, DataFrame]:
    """Messages to queue again with one more attempt, and those that are out of attempts."""
    attempts = F.col("attempts") + 1
    counted = failed.withColumn("attempts", attempts)
    return counted.filter(F.col("attempts") < max_retries), counted.filter(F.col("attempts") >= max_retries)


def dead_letter_rows(failed: DataFrame, as_of) -> DataFrame:
    return failed.select(
        row_id("call_id", "original_message").alias("failure_id"),
        "call_id",
        "error_message",
        F.col("attempts").cast("int").alias("total_attempts"),
        "original_message",
        clock(as_of).alias("marked_failed_at"),
    )


# ---- status and batch log -------------------------------------------------------------------------------

# fixed values: modes and whether they start enabled
MODES = {"CDC_NORMAL_MODE": True, "CDC_HISTORICAL_MODE": False, "CDC_NORMAL_MODE_SF_OC": True}


def init_status(status: DataFrame, as_of, historical_start: str) -> DataFrame:
    """Status rows of the modes that have none yet."""
    rows = [(mode, enabled) for mode, enabled in MODES.items()]
    seeds = status.sparkSession.createDataFrame(rows, "table_name string, is_enabled boolean")
    mark = F.when(F.col("is_enabled"), clock(as_of) - interval_days(1)).otherwise(clock(historical_start))
    absent = seeds.join(status.select("table_name"), "table_name", "left_anti")
    return absent.select(
        "table_name",
        mark.alias("last_processed_timestamp"),
        F.lit(0).cast("bigint").alias("last_change_id"),
        F.lit(0).cast("bigint").alias("total_processed"),
        "is_enabled",
        clock(as_of).alias("created_at"),
        clock(as_of).alias("last_updated"),
    )


def update_status(status: DataFrame, handled: DataFrame, as_of) -> DataFrame:
    """Status table after a batch: `handled` has `table_name, processed_time`, one row per call."""
    batch = handled.groupBy("table_name").agg(
        F.max("processed_time").alias("_mark"), F.count(F.lit(1)).alias("_count")
    )
    joined = status.join(batch, "table_name", "left")
    touched = F.col("_count").isNotNull()
    changed = {
        "last_processed_timestamp": F.coalesce("_mark", "last_processed_timestamp"),
        "total_processed": F.col("total_processed") + null_to_zero(F.col("_count")),
        "last_updated": F.when(touched, clock(as_of)).otherwise(F.col("last_updated")),
    }
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in status.columns])


def batch_log(handled: DataFrame, batch_id: str, as_of) -> DataFrame:
    """One log row per handled call of a batch."""
    failed = F.col("error_message").isNotNull()
    return handled.select(
        F.lit(batch_id).alias("batch_id"),
        "call_id",
        F.lit("PUBLISH").alias("operation_type"),
        F.col("processing_time_ms").cast("bigint").alias("processing_time_ms"),
        F.when(failed, "FAILED").otherwise("SUCCESS").alias("status"),
        "error_message",
        clock(as_of).alias("created_at"),
    )


def pipeline_counters(log: DataFrame) -> DataFrame:
    """Totals over the batch log."""
    return log.agg(
        F.count_if(F.col("status") == "SUCCESS").alias("processed"),
        F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.countDistinct("batch_id").alias("cycles"),
        F.sum("processing_time_ms").alias("processing_time_ms"),
    )


# ---- feedback ----------------------------------------------------------------------------------------------


def feedback_rows(submitted: DataFrame, as_of) -> DataFrame:
    """Reviews as stored: no correction where the model was right, flag as 0/1."""
    return submitted.select(
        row_id("call_id", "reviewer", "ml_category").alias("feedback_id"),
        "call_id",
        "ml_category",
        F.when(~F.col("is_correct"), F.col("correct_category")).alias("correct_category"),
        F.col("is_correct").cast("int").alias("is_correct"),
        F.coalesce("reviewer", F.lit("dashboard_user")).alias("reviewer"),
        clock(as_of).alias("created_at"),
        F.lit(None).cast("string").alias("notes"),
    )


# ---- month partitions -----------------------------------------------------------------------------------------

def with_month(df: DataFrame, time_col: str) -> DataFrame:
    """Rows with their month; a row without time has no partition and is refused downstream."""
    return df.filter(F.col(time_col).isNotNull()).withColumn("month", F.trunc(time_col, "month"))


def write_partitioned(df: DataFrame, time_col: str, path: str, files_per_month: int = 8) -> None:
    """Month folders, each written by several tasks: one month may hold most rows."""
    spread = F.pmod(F.xxhash64(*df.columns[:2], time_col), F.lit(files_per_month))
    placed = with_month(df, time_col).repartition("month", spread)
    placed.write.mode("append").partitionBy("month").parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, key: str = "call_id", order: tuple[str, ...] = ("call_time", "seq"), buckets: int = 64) -> None:
    """Keep `df` as a catalog table whose files hold each value of `key` together, in order.

    Grouping, joining and assembling by the key then needs no shuffle. One bucket is one task: take as many as keep a
    bucket within a task's memory. Rows go to their buckets in one shuffle, so there is one file a bucket.
    """
    placed = df.repartition(buckets, key)
    placed.write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key, *order).saveAsTable(table)


def kept_months(df: DataFrame, keep_months: int, as_of) -> DataFrame:
    first = F.add_months(F.trunc(clock(as_of), "month"), 1 - keep_months)
    return df.filter(F.col("month") >= first)


def expire_partitions(spark: SparkSession, path: str, keep_months: int, as_of) -> list[str]:
    """Delete month folders older than the retention period. Only folder names are read."""
    first = spark.range(1).select(F.add_months(F.trunc(clock(as_of), "month"), 1 - keep_months)).first()[0]
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    dropped = []
    for entry in files.listStatus(root):
        name = entry.getPath().getName()
        if name.startswith("month=") and name[len("month="):] < first.isoformat():
            files.delete(entry.getPath(), True)
            dropped.append(name)
    return sorted(dropped)


