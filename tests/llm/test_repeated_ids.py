"""Token ids of fuzzed texts, and documents with several texts in the similarity join."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from dialoglens.llm import jaccard, rans

WORDS = public_tokenizers.path("word_bpe_49k.json")
SIGNS = [*"abYyHhJjTtWw019 '`{}<|>_-=.,!éÉ×÷ÀÿÅ\t\n\x0b\r\x85\x1c", *"̸̱̊̌̈́", "İ", "Σ", "ß", "日", "😀", "'s", "'LL", " <|endoftext|>", " ", " "]


def test_fuzzed_texts_give_the_ids_of_whole_texts():
    """Also capitals that compose with a mark behind them otherwise than their small letters do."""
    draw = random.Random(1)
    texts = ["".join(draw.choice(SIGNS) for _ in range(draw.randrange(14))) for _ in range(30_000)]
    texts += ["{Y̊`", "H̱", "J̌", "T̈", "W̊", "", None]
    run = rans.PartEncoder(WORDS)
    assert run.by_part
    ids, lengths = run.encode(pa.array(texts), 2)
    whole = [c.ids + [2] for c in run.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == whole


def test_other_tokenizers_are_not_parted(tmp_path):
    import json

    with open(WORDS, encoding="utf-8") as file:
        told = json.load(file)
    told["normalizer"]["normalizers"] = told["normalizer"]["normalizers"][:2]
    path = tmp_path / "cased.json"
    path.write_text(json.dumps(told))
    run, texts = rans.PartEncoder(str(path)), ["Some Words, here", "", "B"]
    assert not run.by_part
    ids, lengths = run.encode(pa.array(texts), 2)
    whole = [c.ids + [2] for c in run.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == whole


def shingles(text):
    words = [w.lower() for w in (text or "").split()]
    return {" ".join(words[k:k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {" ".join(words)} if words else set()


def brute(rows):
    """(doc_id, n_shingles, component_id) of each document, all its texts compared with all others."""
    texts = {}
    for doc, text in rows:
        texts.setdefault(doc, []).append(shingles(text))
    parent = {d: d for d in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in texts[a] for y in texts[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted((d, max(map(len, s)), root(d)) for d, s in texts.items())


def found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(tuple(r) for r in jaccard.similarity_classes(docs).collect())


def prose(seed, n=60):
    draw = random.Random(seed)
    return ["".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


def test_a_copy_among_the_texts_of_a_document_hides_none_of_the_others(spark):
    base, other = prose(1), prose(2)
    nine, twenty = base[:-1], [*base[1:], "x"]
    rows = [(3, " ".join(other)), (5, " ".join(base)), (5, " ".join(other)), (9, " ".join(nine)), (20, " ".join(twenty))]
    assert found(spark, rows) == brute(rows)
    assert {c for *_, c in found(spark, rows)} == {3}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts_under_repeated_ids(spark, seed):
    draw = random.Random(seed)
    bases = [prose(100 + k, draw.choice([4, 20, 60])) for k in range(12)]
    rows = []
    for _ in range(90):
        words = list(draw.choice(bases))
        for _ in range(draw.choice([0, 0, 1, 2, 4])):
            words[draw.randrange(len(words))] = draw.choice("xyz")
        rows.append((draw.randrange(40), draw.choice([" ".join(words), " ".join(words), "", None]) if draw.random() < 0.2 else " ".join(words)))
    assert found(spark, rows) == brute(rows)
