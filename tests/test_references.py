"""References beyond the size of a plan beside brute force and beside the planned way."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialoglens.operators import classify


@pytest.fixture(scope="module")
def texts(spark):
    draw = np.random.default_rng(2)
    rows = [(k, [float(x) for x in draw.standard_normal(8)] if k % 9 else None, f"about name {k % 40} and NAME 7 again") for k in range(60)]
    return spark.createDataFrame(rows, "id int, embedding array<double>, text string").repartition(3)


def categories(spark, n):
    draw = np.random.default_rng(1)
    vectors = draw.standard_normal((n, 8)).round(1)
    vectors[n // 2] = vectors[3]
    rows = [(10 * k, f"id{k}", f"name {k}", [float(x) for x in v]) for k, v in enumerate(vectors)]
    return vectors, spark.createDataFrame(rows, "pos int, category_id string, name string, embedding array<double>")


def words(spark):
    return spark.createDataFrame([(f"name {k}", "strong" if k % 2 else "weak", w) for k in range(20) for w in (f"name {k} ", f"e {k} ")], "category string, strength string, keyword string")


def test_blocks_give_what_the_plan_gives(spark, texts):
    _, known = categories(spark, 200)
    same = lambda df: sorted((r.id, [(round(c.confidence, 9), c.keyword_boost, c.category_id, c.name) for c in r.classes or []]) for r in df.collect())
    for threshold in (0.35, 99.0):
        by_plan = classify.classify(texts, known, words(spark), "name 5", 3, threshold)
        by_blocks = classify.classify(texts, known, words(spark), "name 5", 3, threshold, in_plan=10)
        told = {i: c for i, c in same(by_plan)}
        # a text without a vector has no scores; both ways give it the stand-in
        assert {i: c for i, c in same(by_blocks) if i % 9} == {i: c for i, c in told.items() if i % 9}
        assert by_blocks.columns == by_plan.columns
    scores = lambda n: {r.id: r.scores for r in classify.score_against(texts, known, "pos", in_plan=n).collect()}
    planned, blocked = scores(1000), scores(10)
    assert all(planned[i] is None and blocked[i] is None if i % 9 == 0 else np.allclose(planned[i], blocked[i], atol=1e-12) for i in planned)


def test_many_references(spark, texts):
    vectors, known = categories(spark, 50_000)
    found = classify.classify(texts.select("id", "embedding", F.lit("").alias("text")), known, words(spark), None, 4, 0.1)
    for r in found.filter("embedding IS NOT NULL").collect():
        scores = vectors @ np.array(r.embedding)
        best = sorted(range(len(scores)), key=lambda k: (-scores[k], k))[:4]
        assert np.allclose([c.confidence for c in r.classes], scores[best], atol=1e-12) and len({c.name for c in r.classes}) == 4
    best = classify.detect_churn(texts.filter("id < 12").select("id", "embedding"), known.withColumnRenamed("pos", "proto_index"))
    for r in best.filter("embedding IS NOT NULL").collect():
        scores = (vectors @ np.array(r.embedding)).round(4)
        assert abs(scores[r.best_prototype_index] - scores.max()) < 2e-4 and len(r.prototype_scores) == 50_000
