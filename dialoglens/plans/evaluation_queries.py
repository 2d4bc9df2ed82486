"""Churn evaluation, keywords, classification and churn detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoglens.functions.vectors import hashing_embedder
from dialoglens.operators import classify, evaluation
from dialoglens.operators.joins import churner_calls, transcripts
from dialoglens.plans.evaluation import weekly_evaluation
from dialoglens.plans.registry import query
from dialoglens.plans.report_queries import CHURNER_CALLS
from dialoglens.session import materialize

STATUSES = ["C"]
WORDS = ["part 1", "part 22", "part 3"]
PATTERN = "part 1|part 22|part 3"


def _calls(db):
    return churner_calls(db.subscriber, db.segments, db.conversation_summary, STATUSES, 30, db.as_of)


def _churned(db):
    return evaluation.churned_customers(_calls(db))


# ---- churners ------------------------------------------------------------------------------------

CHURNED = f"""SELECT subscriber_no, churn_status, churn_date, max(churn_score) AS max_churn_score,
    count(DISTINCT call_id) AS call_count, arg_max(call_id, (call_time, call_id)) AS latest_call
    FROM ({CHURNER_CALLS}) GROUP BY 1, 2, 3"""
MISSED = f"SELECT * FROM ({CHURNED}) WHERE coalesce(max_churn_score, 0) < 40"
# every call of a churner counts as missed here, so that the text operators have many transcripts
TEXTS = f"""SELECT call_id, string_agg(text, ' ' ORDER BY call_time, seq, owner, text) AS transcript FROM seg
    WHERE call_id IN (SELECT latest_call FROM ({CHURNED})) GROUP BY 1"""
query("A28_churned_customers", CHURNED)(_churned)
query(
    "A28_churner_call_lists",
    f"""SELECT subscriber_no, churn_date, string_agg(call_id, ',' ORDER BY call_time DESC, call_id) AS call_ids
      FROM ({CHURNER_CALLS}) GROUP BY 1, 2""",
)(lambda db: evaluation.churner_call_lists(_calls(db)).select("subscriber_no", "churn_date", "call_ids"))
RECALL = f"""SELECT count(*) AS total_churned, count(max_churn_score) AS with_score,
    count(*) - count(max_churn_score) AS without_score, count(*) FILTER (max_churn_score >= 70) AS high_risk_caught,
    count(*) FILTER (max_churn_score >= 40) AS medium_plus_caught,
    coalesce(round(avg(max_churn_score), 6), 0) AS avg_churn_score,
    coalesce(count(*) FILTER (max_churn_score >= 70) / nullif(count(max_churn_score), 0), 0) AS recall_high,
    coalesce(count(*) FILTER (max_churn_score >= 40) / nullif(count(max_churn_score), 0), 0) AS recall_medium,
    coalesce(count(*) FILTER (max_churn_score >= 40) / nullif(count(max_churn_score), 0), 0) AS recall,
    coalesce(count(max_churn_score) / nullif(count(*), 0), 0) AS coverage FROM ({CHURNED})"""
query("A29_churn_recall", RECALL)(
    lambda db: evaluation.churn_recall(_churned(db)).withColumn("avg_churn_score", F.round("avg_churn_score", 6))
)
query("J17_missed_transcripts", f"SELECT subscriber_no, t.call_id, transcript FROM ({CHURNED}) c JOIN ({TEXTS}) t ON latest_call = t.call_id")(
    lambda db: evaluation.missed_transcripts(_churned(db), db.segments).select("subscriber_no", "call_id", "transcript")
)
KEYWORD_COUNTS = f"""SELECT keyword, count(*) AS count, count(*) >= greatest(1, (SELECT count(*) FROM ({CHURNED})) * 0.1) AS significant
    FROM (SELECT unnest(regexp_extract_all(transcript, '{PATTERN}')) AS keyword
      FROM ({CHURNED}) c JOIN ({TEXTS}) t ON latest_call = t.call_id) GROUP BY 1"""
query("A30_missed_keywords", f"SELECT * FROM ({KEYWORD_COUNTS}) ORDER BY count DESC, keyword LIMIT 20")(
    lambda db: evaluation.top_keywords(
        evaluation.missed_keywords(evaluation.missed_transcripts(_churned(db), db.segments), _churned(db), WORDS)
    )
)
# short texts with sentences: the conversations, searched for common words of their languages
PHRASE_WORDS = ["die", "que", "der", "the", "les"]
query(
    "A32_sample_phrases",
    f"""WITH t AS (SELECT call_id, string_agg(text, ' ' ORDER BY call_time, seq, owner, text) AS transcript FROM tseg GROUP BY 1),
      h AS (SELECT call_id, transcript, regexp_extract_all(transcript, '{'|'.join(PHRASE_WORDS)}')[1:2] AS hits FROM t),
      s AS (SELECT call_id, hits, unnest(string_split(transcript, '.')) AS sentence,
        generate_subscripts(string_split(transcript, '.'), 1) - 1 AS pos FROM h)
    SELECT call_id, pos, trim(sentence, ' ') AS phrase FROM s WHERE length(sentence) < 200
      AND (contains(sentence, hits[1]) OR contains(sentence, hits[2])) ORDER BY call_id, pos LIMIT 10""",
)(lambda db: evaluation.sample_phrases(transcripts(db.text_segments), PHRASE_WORDS))

# ---- the weekly job ----------------------------------------------------------------------------------


def _weekly(db, part: str):
    return weekly_evaluation(db, STATUSES, WORDS)[part]


query("K07_weekly_evaluation", RECALL)(
    lambda db: _weekly(db, "metrics").withColumn("avg_churn_score", F.round("avg_churn_score", 6))
)
query(
    "S18_append_evaluation",
    f"""SELECT total_churned AS churned_count, with_score AS with_score_count, CAST(recall AS DECIMAL(5,4)) AS recall_rate,
      CAST(coverage AS DECIMAL(5,4)) AS coverage_rate, CAST(avg_churn_score AS DECIMAL(5,2)) AS avg_churn_score FROM ({RECALL})""",
)(
    lambda db: _weekly(db, "history").select(
        "churned_count", "with_score_count", "recall_rate", "coverage_rate", "avg_churn_score"
    )
)


def _recommended(db):
    """Churners and transcripts feed several branches: each is worked out once."""
    churned = materialize(_churned(db), "churned")
    texts = materialize(evaluation.missed_transcripts(churned, db.segments), "missed")
    return evaluation.generate_recommendations(
        evaluation.churn_recall(churned).withColumns({"recall": F.col("recall") / 4, "coverage": F.col("coverage") / 4}),
        evaluation.missed_keywords(texts, churned, WORDS),
        evaluation.sample_phrases(texts, WORDS),
        F.lit(0),
    )


# a report of low figures: the rates are halved before the recommendations are made
WRONG = "SELECT sum(n) AS n FROM (SELECT count(*) AS n FROM fb WHERE is_correct = 0 AND created_at > TIMESTAMP '2024-01-01' GROUP BY ml_category, correct_category HAVING count(*) >= 3)"
query(
    "K06_generate_recommendations",
    f"""WITH m AS ({RECALL}), k AS (SELECT count(*) AS n FROM ({KEYWORD_COUNTS}) WHERE significant)
    SELECT 'churn_threshold' AS rec_type, printf('%.1f', recall / 4 * 100) || '% of the churners had a high score; a lower threshold finds more of them' AS reason FROM m
    UNION ALL SELECT 'pipeline_coverage', printf('%.1f', coverage / 4 * 100) || '% of the churners have a score, ' || without_score || ' have none' FROM m
    UNION ALL SELECT 'churn_keywords', n || ' keywords are frequent in the calls of missed churners' FROM k WHERE n > 0""",
)(
    lambda db: _recommended(db).select("rec_type", F.get_json_object("rec_details", "$.reason").alias("reason"))
)
query(
    "S17_append_recommendations",
    f"""SELECT 'classification_fix' AS rec_type, 'PENDING' AS status,
      'reviewers changed these labels ' || CAST(n AS BIGINT) || ' times' AS reason FROM ({WRONG}) WHERE n > 0""",
)(
    lambda db: evaluation.recommendation_rows(
        evaluation.classification_recommendation(evaluation.misclassifications(db.feedback, db.as_of)), db.as_of
    ).select("rec_type", "status", F.get_json_object("rec_details", "$.reason").alias("reason"))
)

# ---- keywords ---------------------------------------------------------------------------------------------


def _keywords(db):
    """Two strong and two weak keywords per event type."""
    entries = F.array(
        F.struct(F.lit("strong").alias("strength"), F.upper("event_type").alias("keyword")),
        *[
            F.struct(F.lit(strength).alias("strength"), F.lit(word).alias("keyword"))
            for strength, word in [("strong", '"k": 77'), ("weak", " 1"), ("weak", '"k": 6')]
        ],
    )
    kinds = db.events.select("event_type").distinct()
    return kinds.select(F.col("event_type").alias("category"), F.explode(entries).alias("e")).select("category", "e.*").orderBy("category")


KW = """k AS (SELECT event_type AS category, unnest([{'s': 'strong', 'w': event_type}, {'s': 'strong', 'w': '"k": 77'},
    {'s': 'weak', 'w': ' 1'}, {'s': 'weak', 'w': '"k": 6'}]) AS e FROM (SELECT DISTINCT event_type FROM events)),
  hit AS (SELECT source_id, category, e.s AS strength, e.w AS keyword FROM cs JOIN k ON contains(lower(summary), e.w))"""


def _matched(db):
    return classify.match_keywords(db.conversation_summary.select("source_id", "summary"), _keywords(db), "summary")


query("J19_match_keywords", f"WITH {KW} SELECT * FROM hit")(
    lambda db: _matched(db).select("source_id", F.explode("matches").alias("m")).select("source_id", "m.category", "m.strength", "m.keyword")
)
query(
    "T17_keyword_boost",
    f"""WITH {KW}, g AS (SELECT source_id, count(*) FILTER (strength = 'strong') AS strong, count(*) FILTER (strength = 'weak') AS weak
      FROM hit WHERE category = 'click' GROUP BY 1)
    SELECT source_id, coalesce(if(strong > 0, 0.15::DOUBLE, 0) + if(weak >= 2, 0.05::DOUBLE, 0), 0) AS boost FROM cs LEFT JOIN g USING (source_id)""",
)(lambda db: _matched(db).select("source_id", classify.keyword_boost(F.col("matches"), F.lit("click")).alias("boost")))
query(
    "T18_keyword_category",
    f"""WITH {KW}, p AS (SELECT source_id, category, sum(if(strength = 'strong', 3, 1)) AS score FROM hit GROUP BY 1, 2
      QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY score DESC, category) = 1)
    SELECT source_id, if(score >= 2, category, NULL) AS keyword_category, CAST(if(score >= 2, score, NULL) AS INT) AS keyword_score
      FROM cs LEFT JOIN p USING (source_id)""",
)(
    lambda db: classify.keyword_category(_matched(db)).select("source_id", "keyword_category", "keyword_score")
)

# ---- vectors ------------------------------------------------------------------------------------------------------


def _prototypes(db):
    """The vector with the lowest id of each label."""
    first = db.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return first.withColumn("proto_index", F.col("label"))


def _categories(db):
    return _prototypes(db).select(
        F.col("label").alias("pos"),
        F.concat(F.lit("id"), F.col("label").cast("string")).alias("category_id"),
        F.concat(F.lit("label "), F.col("label").cast("string")).alias("name"),
        "embedding",
    )


PROTOS = """p AS (SELECT label AS pos, arg_min(embedding, vec_id)::DOUBLE[] AS proto FROM embeddings GROUP BY 1),
  s AS (SELECT vec_id, pos, list_dot_product(embedding::DOUBLE[], proto) AS sim FROM embeddings, p)"""
query("J18_score_against", f"WITH {PROTOS} SELECT vec_id, pos, round(sim, 4) AS similarity FROM s")(
    lambda db: classify.score_against(db.embeddings, _prototypes(db), "proto_index")
    .select("vec_id", F.posexplode("scores").alias("pos", "s"))
    .select("vec_id", "pos", F.round("s", 4).alias("similarity"))
)
BEST = f"""WITH {PROTOS}, b AS (SELECT vec_id, round(sim, 4) AS best, pos AS idx FROM s
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 4) DESC, pos) = 1)"""
query("W01_best_prototype", f"{BEST} SELECT vec_id, best AS similarity, idx AS index FROM b")(
    lambda db: classify.score_against(db.embeddings, _prototypes(db), "proto_index")
    .select("vec_id", classify.best_prototype(F.col("scores")).alias("b"))
    .select("vec_id", "b.*")
)
CHURN = f"""{BEST}, f AS (SELECT *, greatest(0, least(100, (best - 0.5::DOUBLE) / (0.82::DOUBLE - 0.5::DOUBLE) * 100)) AS score FROM b)
    SELECT vec_id, score >= 70 AS is_churn, round(score / 100, 3) AS churn_confidence, CAST(floor(score) AS INT) AS churn_score,
      best AS raw_similarity, idx AS best_prototype_index FROM f"""
query("X03_detect_churn", CHURN)(
    lambda db: classify.detect_churn(db.embeddings, _prototypes(db)).select(
        "vec_id", "is_churn", "churn_confidence", "churn_score", "raw_similarity", "best_prototype_index"
    )
)
query(
    "A39_churn_batch_summary",
    f"""SELECT count(*) AS total, count(*) FILTER (is_churn) AS churn, round(count(*) FILTER (is_churn) * 100 / count(*), 1) AS churn_percent,
      count(*) FILTER (NOT is_churn) AS clean FROM ({CHURN})""",
)(lambda db: classify.churn_batch_summary(classify.detect_churn(db.embeddings, _prototypes(db))))


def _texts(db):
    return db.embeddings.withColumn("text", F.concat(F.lit("about LABEL "), (F.col("vec_id") % 10).cast("string"), F.lit(" and more")))


def _label_words(db):
    return db.embeddings.select("label").distinct().select(
        F.concat(F.lit("label "), F.col("label").cast("string")).alias("category"),
        F.lit("strong").alias("strength"),
        F.concat(F.lit("Label "), F.col("label").cast("string")).alias("keyword"),
    )


SCORED = f"""WITH {PROTOS}, c AS (SELECT vec_id, pos, sim + if(vec_id % 10 = pos, 0.15::DOUBLE, 0) AS confidence,
    if(vec_id % 10 = pos, 0.15::DOUBLE, 0) AS keyword_boost FROM s)"""
TOP2 = f"""{SCORED}, t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY confidence DESC, pos) AS rank FROM c
    WHERE confidence >= 0.35 QUALIFY rank <= 2),
  full_list AS (SELECT * FROM t UNION ALL SELECT vec_id, 3, 0, 0, 1 FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM t))"""


def _classified(db):
    return classify.classify(_texts(db), _categories(db), _label_words(db), fallback="label 3")


query(
    "X02_classify",
    f"{TOP2} SELECT vec_id, rank, 'label ' || pos AS name, round(confidence, 4) AS confidence, keyword_boost FROM full_list",
)(
    lambda db: _classified(db)
    .select("vec_id", F.posexplode("classes").alias("i", "c"))
    .select("vec_id", (F.col("i") + 1).alias("rank"), "c.name", F.round("c.confidence", 4).alias("confidence"), "c.keyword_boost")
)
query(
    "W02_top_k_categories",
    f"""WITH {PROTOS}, r AS (SELECT vec_id, pos, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, pos) AS rank FROM s
      WHERE sim >= 0.1 QUALIFY rank <= 3) SELECT vec_id, rank, pos FROM r""",
)(
    lambda db: classify.score_against(db.embeddings, _categories(db), "pos")
    .select(
        "vec_id",
        F.posexplode(
            classify.top_k_categories(
                F.transform("scores", lambda s, i: F.struct(s.alias("confidence"), i.alias("pos"))), 3, 0.1
            )
        ).alias("i", "c"),
    )
    .select("vec_id", (F.col("i") + 1).alias("rank"), "c.pos")
)
query(
    "A41_enrichment_stats",
    f"""{TOP2}, n AS ({CHURN.replace('WITH ' + PROTOS + ',', 'WITH ' + PROTOS.replace('p AS', 'p2 AS').replace('s AS', 's2 AS').replace(', p)', ', p2)') + ',').replace('AS idx FROM s', 'AS idx FROM s2')})
    SELECT (SELECT count(*) FROM embeddings) AS classifications, count(*) FILTER (keyword_boost > 0) AS keyword_boosts_applied,
      (SELECT count(*) FROM n) AS churn_detections, (SELECT count(*) FROM n WHERE is_churn) AS churn_positives FROM full_list""",
)(lambda db: classify.enrichment_stats(classify.detect_churn(_classified(db), _prototypes(db))))
query(
    "X01_embedder",
    "SELECT doc_id, text <> '' AS embedded, 64 AS dimensions, if(text = '', 0, 1) AS norm FROM (SELECT doc_id, trim(text) AS text FROM documents)",
)(
    lambda db: db.documents.select("doc_id", hashing_embedder()(F.col("text")).alias("v")).select(
        "doc_id",
        F.exists("v", lambda x: x != 0).alias("embedded"),
        F.size("v").alias("dimensions"),
        F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)), 3).alias("norm"),
    )
)

# ---- labels ------------------------------------------------------------------------------------------------------------


def _valid(db):
    kinds = db.events.select("event_type").distinct().agg(F.sort_array(F.collect_list("event_type")).alias("names"))
    return kinds.select(F.posexplode("names").alias("pos", "name"))


LABELS = """CASE event_id % 5 WHEN 0 THEN array(event_type, ' ') WHEN 1 THEN array('3') WHEN 2 THEN array(concat('8. ', event_type))
  WHEN 3 THEN array('nothing like it') ELSE array('99', concat(event_type, 's')) END"""
query(
    "T16_validate_categories",
    """SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'purchase' WHEN 3 THEN 'לא מסווג' ELSE event_type END AS label FROM events""",
)(
    lambda db: classify.validate_categories(db.events.selectExpr("event_id", f"{LABELS} AS labels"), _valid(db)).select(
        "event_id", F.array_join("labels", "|").alias("label")
    )
)
query(
    "X04_ratio_match",
    "SELECT event_id, event_type AS matched FROM events",
)(
    lambda db: db.events.select(
        "event_id",
        F.get(classify.ratio_match(["click", "error", "purchase", "signup", "view"])(F.array(F.concat(F.lit("1. "), "event_type", F.lit("s")))), 0).alias("matched"),
    )
)
