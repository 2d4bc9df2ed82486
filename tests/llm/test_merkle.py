"""The Merkle manifest beside a plain version, on odd rows, and with small steps so that trees have many bands."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from dialoglens.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree int, pos int, path string, next int, total int"


def told(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row: dict) -> str:
    return told("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in merkle.FRAMED))


def levels(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([told("".join(out[-1][k:k + 2])) for k in range(0, len(out[-1]), 2)])
    return out


def climb(tree: list[list[str]], at: int, value: str) -> tuple[str, str]:
    siblings = ""
    for row in tree[:-1]:
        run = row[at & ~1:(at & ~1) + 2]
        siblings += "".join(x for k, x in enumerate(run, at & ~1) if k != at)
        run[at & 1] = value
        value, at = told("".join(run)), at // 2
    return siblings, value


def expected(rows: list[dict]) -> list[tuple]:
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row["lang"], []).append(row)
    order = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in order:
        by_lang[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees.append(levels([leaf(r) for r in by_lang[lang]]))
    top = levels([t[-1][0] for t in trees])
    root, out = top[-1][0], []
    for k, (lang, tree) in enumerate(zip(order, trees, strict=True)):
        for at, row in enumerate(by_lang[lang]):
            hit = row["doc_id"] is not None and row["n_chars"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0
            claim = leaf(row | {"n_chars": row["n_chars"] + 1}) if hit else leaf(row)
            low, folded = climb(tree, at, claim)
            high, folded = climb(top, k, folded)
            out.append((row["doc_id"], leaf(row), tree[-1][0], root, told(low + high), folded, folded == root))
    return sorted(out, key=repr)


def found(docs, stride=merkle.STRIDE):
    return sorted((tuple(r) for r in merkle.verify_documents(docs, {"n_chars": merkle.tampered_count()}, stride).collect()), key=repr)


def made(n: int, langs: list, seed: int) -> list[dict]:
    draw = random.Random(seed)
    return [{"doc_id": k * 3, "text": "é" * draw.randrange(5), "lang": draw.choice(langs), "source": draw.choice([None, "", "s"]), "n_chars": draw.choice([None, 5, 2**63 - 1])} for k in range(n)]


def frame(spark, rows: list[dict]):
    return spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], 1, 2, "x", 3, 4) for r in rows], SCHEMA)


def test_documents_beside_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert found(docs) == expected([r.asDict() for r in docs.collect()])


@pytest.mark.parametrize("n, langs", [(150, ["a", None, "", "é", "zz"]), (40, ["en"]), (70, [f"l{k}" for k in range(30)]), (1, ["x"])])
def test_trees_of_many_bands(spark, n, langs):
    rows = made(n, langs, n)
    assert found(frame(spark, rows), 1) == expected(rows)


def test_odd_rows(spark):
    rows = made(9, ["en", None], 4)
    rows += [rows[0], rows[0], rows[3] | {"text": None}, rows[2] | {"doc_id": None}, rows[2] | {"doc_id": None}, rows[1] | {"text": "lorem " * 50_000}]
    assert found(frame(spark, rows)) == expected(rows)
    assert found(frame(spark, rows).limit(0)) == []


def test_only_what_is_tampered_fails(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    checked = merkle.verify_documents(docs, {"text": F.when(F.col("doc_id") == 7, "other").otherwise(F.col("text"))})
    assert [r.doc_id for r in checked.filter("NOT verified").collect()] == [7]
