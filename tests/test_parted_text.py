"""Searches over texts in parts beside the same searches over whole texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from dialoglens.operators import evaluation, parted_text
from dialoglens.operators.joins import transcripts

KEYWORDS = ["cancel the contract", "cancel", "aa", "aba", "bab", "leave. now", "é x"]
SCHEMA = "call_id string, call_time timestamp, seq long, owner string, text string"


def segments(spark, calls: dict[str, list[str]]):
    rows = [(call, None, k, "A", text) for call, texts in calls.items() for k, text in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("call_time", F.timestamp_seconds(F.col("seq")))


@pytest.fixture(scope="module")
def calls():
    draw = random.Random(3)
    told = {
        "border": ["please cancel", "the contract", "now", "i cancel", "x. he is aa", "a", "aaa", "é", "x"],
        "chain": ["aaa"] * 9 + ["a" * k for k in range(1, 9)],
        "short": ["a", "b", "a", "b", "a b", "", "ab"] * 3,
        "one": ["please cancel the contract. aa. leave. now. done."],
        "sentences": ["we talk", "and talk. you cancel", "it", "today. short aa. " + "long " * 60, "aa", "end. a", "aba"],
        "nothing": ["hello", "world", "x", "y"],
        "dots": ["..", ".", "cancel.", ".", "aa", "."],
    }
    for n in range(6):
        told[f"random{n}"] = ["".join(draw.choice("ab. é x") for _ in range(draw.randrange(9))) for _ in range(draw.randrange(5, 40))]
    return told


def whole_hits(calls):
    pattern = re.compile(parted_text.keyword_pattern(KEYWORDS))
    return {call: pattern.findall(" ".join(texts)) for call, texts in calls.items()}


@pytest.mark.parametrize("part_size", [2, 4, 7, 10_000])
def test_counts_and_phrases_do_not_depend_on_the_parts(spark, calls, part_size):
    texts = transcripts(segments(spark, calls), part_size=part_size)
    missed = spark.range(20)
    hits = whole_hits(calls)
    wanted = {}
    for found in hits.values():
        for keyword in found:
            wanted[keyword] = wanted.get(keyword, 0) + 1
    counted = evaluation.missed_keywords(texts, missed, KEYWORDS).collect()
    assert {r.keyword: r["count"] for r in counted} == wanted and all(r.significant == (r["count"] >= 2) for r in counted)
    phrases = []
    for call, said in sorted(calls.items()):
        for pos, sentence in enumerate(" ".join(said).split(".")):
            if len(sentence) < evaluation.PHRASE_CHARS and any(hit in sentence for hit in hits[call][:2]):
                phrases.append((call, pos, sentence.strip(" ")))
    shown = evaluation.sample_phrases(texts, KEYWORDS, limit=1000).collect()
    assert [tuple(r) for r in shown] == phrases
    assert len(evaluation.sample_phrases(texts, KEYWORDS).collect()) == evaluation.PHRASES_SHOWN


def test_a_call_named_twice_counts_twice(spark, calls):
    texts = transcripts(segments(spark, {"border": calls["border"]}), part_size=2)
    once = {r.keyword: r["count"] for r in evaluation.missed_keywords(texts, spark.range(1), KEYWORDS).collect()}
    twice = {r.keyword: r["count"] for r in evaluation.missed_keywords(texts.union(texts), spark.range(1), KEYWORDS).collect()}
    assert once["cancel the contract"] == 1 and twice == {k: 2 * n for k, n in once.items()}


def test_scan_of_every_reach():
    pattern = re.compile(f"(?=({parted_text.keyword_pattern(KEYWORDS)}))")
    whole = re.compile(parted_text.keyword_pattern(KEYWORDS))
    draw = random.Random(5)
    for _ in range(300):
        own, head = ("".join(draw.choice("aab ") for _ in range(draw.randrange(30))) for _ in range(2))
        longest = max(map(len, KEYWORDS))
        for reach, (out, counts, leading) in enumerate(parted_text.scan(own, head[:longest], pattern, longest)):
            if reach > len(own):
                assert out == reach - len(own) and not counts
                continue
            hits = [m for m in whole.finditer(own + head[:longest], reach) if m.start() < len(own)]
            assert sum(counts.values()) == len(hits) and leading == [m.group() for m in hits[:2]]
            assert out == max(0, (hits[-1].end() if hits else reach) - len(own))
