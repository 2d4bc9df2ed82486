"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoglens.functions import numbers, text, timing
from dialoglens.functions.vectors import dot, l2_normalize
from dialoglens.operators import assemble, results
from dialoglens.plans.registry import query

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def events(db, *columns):
    return db.events.select("event_id", *columns)


def derived(db, sql: str, name: str = "v"):
    return db.events.selectExpr("event_id", f"{sql} AS {name}")


# ---- products and lists ----------------------------------------------------------------------

RAW_PRODUCT = """CASE event_id % 12 WHEN 0 THEN 'quantity: 2 units' WHEN 1 THEN 'N/A' WHEN 2 THEN ' none ' WHEN 3 THEN ':'
  WHEN 4 THEN 'price' WHEN 5 THEN 'model: x' WHEN 6 THEN concat('iphone 7 ', event_type) WHEN 7 THEN 'iPhone  12   pro'
  WHEN 8 THEN 'iphone 120' WHEN 9 THEN 'אייפון 7' WHEN 10 THEN concat(event_type, '   plan') ELSE '' END"""
query(
    "T01_normalize_product",
    """SELECT event_id, CASE event_id % 12 WHEN 6 THEN 'iphone 17 ' || event_type WHEN 7 THEN 'iphone 17 pro'
      WHEN 8 THEN 'iphone 120' WHEN 9 THEN 'iphone 17' WHEN 10 THEN event_type || ' plan' END AS product FROM events""",
)(lambda db: derived(db, RAW_PRODUCT).select("event_id", text.normalize_product(F.col("v")).alias("product")))
query(
    "T02_split_csv",
    """SELECT source_id, array_to_string([trim(x) FOR x IN string_split(products, ',') IF trim(x) <> ''], '|') AS parts
      FROM cs WHERE products IS NOT NULL""",
)(
    lambda db: db.conversation_summary.filter("products is not null").select(
        "source_id", F.array_join(text.split_csv(F.col("products")), "|").alias("parts")
    )
)
JSONISH = """CASE event_id % 6 WHEN 0 THEN concat('["', event_type, '", "x", 0, null, true]') WHEN 1 THEN concat('{"z": "', event_type, '", "a": 5}')
  WHEN 2 THEN concat('{"items": ["', event_type, '", "b"]}') WHEN 3 THEN concat('[''', event_type, ''', ''B'']')
  WHEN 4 THEN concat('{["', event_type, ' here"]}') ELSE NULL END"""
query(
    "T03_json_to_csv",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_type || ', x, true' WHEN 1 THEN 'z: ' || event_type || ', a: 5'
      WHEN 2 THEN 'items: ' || event_type || ', b' WHEN 3 THEN event_type || ', B' WHEN 4 THEN event_type || ' here'
      ELSE '' END AS csv FROM events""",
)(lambda db: derived(db, JSONISH).select("event_id", text.json_to_csv(F.col("v")).alias("csv")))
ACTIONS = """CASE event_id % 5 WHEN 0 THEN concat('[{"due": "x", "action": "call ', event_type, '"}, {"name": "None", "instructions": "write"}]')
  WHEN 1 THEN concat('["', event_type, '", "none", "b"]') WHEN 2 THEN concat('do [', event_type, '] now')
  WHEN 3 THEN concat('{"task": "', event_type, '"}') ELSE concat('["', repeat(concat(event_type, '", "'), 90), 'end"]') END"""
query(
    "T04_action_items_text",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'call ' || event_type || ', write' WHEN 1 THEN event_type || ', b'
      WHEN 2 THEN 'do ' || event_type || ' now' WHEN 3 THEN event_type
      ELSE array_to_string([event_type FOR x IN range(500 // (length(event_type) + 2))], ', ') END AS items FROM events""",
)(lambda db: derived(db, ACTIONS).select("event_id", text.action_items_text(F.col("v"), 500).alias("items")))

# ---- repair -------------------------------------------------------------------------------------

query(
    "T05_strip_abbrev_quotes",
    "SELECT event_id, 'שח וכו ' || event_type || ' \"x\" חול' AS clean FROM events",
)(
    lambda db: derived(db, "concat('ש\"ח וכו״ ', event_type, ' \"x\" חו״ל')").select(
        "event_id", text.strip_abbrev_quotes(F.col("v")).alias("clean")
    )
)
query(
    "T06_strip_control",
    "SELECT event_id, event_type || chr(9) || 'x' || chr(10) AS clean FROM events",
)(
    lambda db: derived(db, "concat(event_type, chr(1), chr(9), 'x', chr(127), chr(10))").select(
        "event_id", text.strip_control(F.col("v")).alias("clean")
    )
)
query(
    "T07_repair_json",
    "SELECT call_id, if(CAST(call_id AS BIGINT) % 6 = 5, NULL, 's ' || call_id) AS summary FROM responses",
)(
    lambda db: db.responses.withColumn("fixed", F.try_parse_json(text.repair_json(F.col("response")))).select(
        "call_id",
        F.coalesce(*[F.try_variant_get("fixed", f"$.{key}", "string") for key in ("summary", "Summary", "סיכום")]).alias("summary"),
    )
)
query(
    "T08_truncation_class",
    """SELECT call_id, CASE CAST(call_id AS BIGINT) % 6 WHEN 4 THEN 'repairable' WHEN 5 THEN 'severe' ELSE 'complete' END AS class
      FROM responses""",
)(lambda db: db.responses.select("call_id", text.truncation_class(F.col("response")).alias("class")))
query(
    "T09_normalize_keys",
    "SELECT event_id, 'categories=' || event_type || ';other=c;summary=b' AS pairs FROM events",
)(
    lambda db: events(
        db,
        text.normalize_keys(
            F.create_map(
                F.lit("Summary"), F.lit("a"), F.lit("קטגוריה"), F.col("event_type"), F.lit("סיכום"), F.lit("b"),
                F.lit("Other"), F.lit("c"),
            )
        ).alias("m"),
    ).select(
        "event_id",
        F.array_join(
            F.sort_array(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";"
        ).alias("pairs"),
    )
)
query(
    "T10_is_hebrew",
    """SELECT event_id, event_id % 2 = 0 AS hebrew FROM events""",
)(
    lambda db: derived(db, "CASE WHEN event_id % 2 = 0 THEN concat(event_type, ' שיחה עם לקוח') ELSE event_type END").select(
        "event_id", text.is_hebrew(F.col("v")).alias("hebrew")
    )
)
query(
    "T10_script_share",
    """SELECT doc_id, coalesce(round(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / nullif(length(text), 0), 4), 0) AS share
      FROM documents""",
)(lambda db: db.documents.select("doc_id", F.round(text.script_share(F.col("text"), "A-Za-z"), 4).alias("share")))
query(
    "T11_sentiment_to_int",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN 5 WHEN 3 THEN 3 WHEN 4 THEN 1
      ELSE 3 END AS score FROM events""",
)(
    lambda db: derived(
        db,
        "CASE event_id % 6 WHEN 0 THEN ' Positive' WHEN 1 THEN 'שלילי' WHEN 2 THEN '7' WHEN 3 THEN event_type "
        "WHEN 4 THEN '-2' ELSE NULL END",
    ).select("event_id", text.sentiment_to_int(F.col("v")).alias("score"))
)
query(
    "T12_satisfaction_to_int",
    "SELECT event_id, least(5, greatest(1, event_id % 8)) AS score FROM events",
)(
    lambda db: events(db, text.satisfaction_to_int((F.col("event_id") % 8).cast("string")).alias("score"))
)
query(
    "T21_tail_truncate",
    """SELECT doc_id, if(length(text) > 500, '...[תחילת השיחה קוצרה]...' || chr(10) || right(text, 500), text) AS tail
      FROM documents""",
)(lambda db: db.documents.select("doc_id", text.tail_truncate(F.col("text"), 500).alias("tail")))
query("T23_pad_id", "SELECT trim(subscriber_no) AS id FROM sub")(
    lambda db: db.subscriber.select(text.pad_free(F.col("subscriber_no")).alias("id"))
)
query("T24_churn_score_100", "SELECT event_id, round(event_id % 100 / 100 * 100, 6) AS score FROM events")(
    lambda db: events(db, F.round(numbers.churn_score_100(F.col("event_id") % 100 / 100), 6).alias("score"))
)
query(
    "T15_coerce_list",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type || '|b' WHEN 1 THEN event_type || '|c' ELSE '' END AS products,
      CASE event_id % 3 WHEN 0 THEN event_type || ', b' WHEN 1 THEN event_type || '|c' ELSE '' END AS items FROM events""",
)(
    lambda db: derived(
        db,
        """CASE event_id % 3 WHEN 0 THEN concat('"', event_type, ', b"') WHEN 1 THEN concat('["', event_type, '", "c"]')
        ELSE '5' END""",
    ).select(
        "event_id",
        F.array_join(text.coerce_list(F.try_parse_json("v"), True), "|").alias("products"),
        F.array_join(text.coerce_list(F.try_parse_json("v"), False), "|").alias("items"),
    )
)

# ---- time and numbers -------------------------------------------------------------------------------

query(
    "D01_fmt_ts",
    """SELECT event_id, strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%Y-%m-%d %H:%M') AS m,
      strftime(ts, '%Y-%m-%d %H:%M:%S') AS s FROM events""",
)(
    lambda db: events(
        db,
        timing.fmt_ts(F.col("ts"), timing.DATE).alias("d"),
        timing.fmt_ts(F.col("ts"), timing.MINUTE).alias("m"),
        timing.fmt_ts(F.col("ts"), timing.SECOND).alias("s"),
    )
)
query("D02_trunc_day", "SELECT event_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day FROM events")(
    lambda db: events(db, timing.trunc_day(F.col("ts")).alias("day"))
)
query("D03_day_of_week0", "SELECT event_id, dayofweek(ts) AS dow FROM events")(
    lambda db: events(db, timing.day_of_week0(F.col("ts")).alias("dow"))
)
query("D04_hour24", "SELECT event_id, date_part('hour', ts) AS hour FROM events")(
    lambda db: events(db, timing.hour24(F.col("ts")).alias("hour"))
)
query("D05_parse_iso", "SELECT event_id, ts FROM events")(
    lambda db: events(db, timing.parse_iso(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("ts"))
)
query("D06_to_iso", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso FROM events")(
    lambda db: events(db, timing.to_iso(F.col("ts")).alias("iso"))
)
query("D07_age_days", f"SELECT event_id, round((epoch_us({AS_OF}) - epoch_us(ts)) / 86400000000, 6) AS age FROM events")(
    lambda db: events(db, F.round(timing.age_days(F.col("ts"), db.as_of), 6).alias("age"))
)
query(
    "D08_delta",
    """WITH d AS (SELECT event_id, if(event_id % 9 = 0, 0, event_id % 7) AS c, if(event_id % 5 = 0, 0, event_id % 8) AS p FROM events)
    SELECT event_id, if(p = 0, c, c - p) AS value, if(p = 0, if(c > 0, 100, 0), round((c - p) * 100 / p, 1)) AS percent,
      CASE WHEN c > p THEN 'up' WHEN c < p THEN 'down' ELSE 'same' END AS direction FROM d""",
)(
    lambda db: db.events.selectExpr(
        "event_id", "if(event_id % 9 = 0, NULL, event_id % 7) AS c", "if(event_id % 5 = 0, 0, event_id % 8) AS p"
    )
    .select("event_id", numbers.delta(F.col("c"), F.col("p")).alias("d"))
    .select("event_id", "d.*")
)
query(
    "D09_safe_percent",
    "SELECT event_id, coalesce(round(event_id % 7 * 100 / nullif(event_id % 11, 0), 1), 0) AS percent FROM events",
)(lambda db: events(db, numbers.safe_percent(F.col("event_id") % 7, F.col("event_id") % 11).alias("percent")))
query("D10_null_to_zero", "SELECT source_id, coalesce(churn_score, 0) AS score FROM cs")(
    lambda db: db.conversation_summary.select("source_id", numbers.null_to_zero(F.col("churn_score")).alias("score"))
)
query(
    "T20_rescale_score",
    """WITH s AS (SELECT event_id, least(value, 100) / 100 AS sim FROM events),
      r AS (SELECT *, greatest(0, least(100, (sim - 0.5::DOUBLE) / (0.82::DOUBLE - 0.5::DOUBLE) * 100)) AS score FROM s)
    SELECT event_id, score >= 70 AS is_churn, round(score / 100, 3) AS churn_confidence, CAST(floor(score) AS INT) AS churn_score,
      round(sim, 4) AS raw_similarity FROM r""",
)(
    lambda db: events(db, numbers.rescale_score(F.least("value", F.lit(100.0)) / 100).alias("r")).select("event_id", "r.*")
)
query(
    "T19_dot",
    """SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 5) AS norm2,
      round(list_dot_product(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 5) AS mirrored FROM embeddings""",
)(
    lambda db: db.embeddings.select(
        "vec_id",
        F.round(dot(l2_normalize(F.col("embedding")), F.col("embedding")), 5).alias("norm2"),
        F.round(dot(F.col("embedding"), F.reverse("embedding")), 5).alias("mirrored"),
    )
)

# ---- sets ----------------------------------------------------------------------------------------------

query(
    "U03_distinct_categories",
    "SELECT event_id, event_type || ',x' AS labels FROM events",
)(
    lambda db: events(
        db,
        F.array_join(
            results.distinct_categories(F.array(F.col("event_type"), F.lit(""), F.lit("x"), F.col("event_type"), F.lit(" "))), ","
        ).alias("labels"),
    )
)
query(
    "U04_missing_channels",
    """SELECT call_id, array_to_string([x FOR x IN ['A', 'C'] IF NOT list_contains(list(owner), x)], ',') AS missing
      FROM seg GROUP BY 1""",
)(
    lambda db: db.segments.groupBy("call_id")
    .agg(F.collect_set("owner").alias("seen"))
    .select("call_id", F.array_join(assemble.missing_channels(("A", "C"), F.col("seen")), ",").alias("missing"))
)
query("U06_distinct_calls", "SELECT DISTINCT call_id FROM seg")(lambda db: db.segments.select("call_id").dropDuplicates())
query(
    "U05_max_of_sources",
    """SELECT event_id, greatest(event_id % 50, event_id % 70) AS churn_score,
      if(event_id % 70 > event_id % 50, 'summary', 'transcription') AS churn_source FROM events""",
)(
    lambda db: db.events.selectExpr(
        "event_id",
        "named_struct('is_churn', false, 'churn_confidence', 0D, 'churn_score', event_id % 50) AS t",
        "named_struct('is_churn', false, 'churn_confidence', 0D, 'churn_score', event_id % 70) AS s",
    )
    .select("event_id", results.max_of_sources(F.col("t"), F.col("s")).alias("m"))
    .select("event_id", "m.churn_score", "m.churn_source")
)
