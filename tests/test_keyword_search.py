"""Keyword search by grams beside plain search."""

import random
import time

import pytest

from dialoglens.operators import classify, keyword_search


def searched(texts, keywords, **how):
    found = keyword_search.with_matches(texts, keywords, "text", **how)
    return {r.id: [(m.category, m.strength, m.keyword) for m in r.matches] for r in found.collect()}


@pytest.mark.parametrize("how", [{}, {"in_plan": 3}, {"in_plan": 3, "in_slice": 4}])
def test_short_nested_and_odd_keywords(spark, how):
    words = ["ab", "ABC", "bc", "", "x", "שירות", "לא מרוצה", "a\nb", "😀é", "abcabc", None, "abc", "zz"]
    rows = [(f"c{k % 3}" if k % 5 else None, "strong" if k % 2 else "weak", w) for k, w in enumerate(words)]
    keywords = spark.createDataFrame(rows, "category string, strength string, keyword string").coalesce(1)
    told = ["", None, "AbCaBc", "xyz", "אני לא מרוצה מהשירות שלכם", "a\nb", "😀É", "ab", "c" * 5000 + "abc"]
    texts = spark.createDataFrame(list(enumerate(told)), "id int, text string")
    wanted = {k: [(c, s, w.lower()) for c, s, w in rows if w is not None and w.lower() in (t or "").lower()] for k, t in enumerate(told)}
    assert searched(texts, keywords, **how) == wanted


def test_many_keywords(spark):
    draw = random.Random(4)
    word = lambda n: "".join(draw.choice("abcdefgh") for _ in range(n))
    words = list(dict.fromkeys(word(draw.choice([2, 4, 5, 6, 9])) for _ in range(23_000)))
    assert len(words) > 15_000
    words += [word(7) + str(k) for k in range(20_000 - len(words))] if len(words) < 20_000 else []
    keywords = spark.createDataFrame([(f"cat {k % 700}", "strong" if k % 3 else "weak", w) for k, w in enumerate(words)], "category string, strength string, keyword string").coalesce(1)
    told = [" ".join(word(draw.randrange(1, 14)) for _ in range(60)) for _ in range(300)]
    texts = spark.createDataFrame(list(enumerate(told)), "id int, text string")
    begin = time.time()
    found = {r.id: r for r in classify.keyword_category(keyword_search.with_matches(texts, keywords, "text")).collect()}
    assert time.time() - begin < 60
    for k, text in enumerate(told):
        hits = [(i, w) for i, w in enumerate(words) if w in text]
        assert [m.keyword for m in found[k].matches] == [w for _, w in hits]
        points = {}
        for i, _ in hits:
            points[i % 700] = points.get(i % 700, 0) + (3 if i % 3 else 1)
        best = min(points.items(), key=lambda x: (-x[1], x[0]), default=(None, 0))
        assert (found[k].keyword_category, found[k].keyword_score) == ((f"cat {best[0]}", best[1]) if best[1] >= 2 else (None, None))
