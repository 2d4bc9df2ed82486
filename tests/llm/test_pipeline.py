"""The pipeline beside plain Python on the smallest tables."""

import corpus_pipeline
from conftest import SF_DIR
from dialoglens.llm import pieces, pii, quality
from test_llm_operators import MODEL, shingle_classes


def words(text):
    import re

    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def holds(text, item):
    """Whether a text has twelve words of the item, or four fifths of a short one, on its diagonals of equal 8-word windows."""
    t, i = words(text), words(item)
    starts = {tuple(i[k:k + 5]): k for k in range(len(i) - 4)}
    found = set()
    for at in range(len(t) - 4):
        if (k := starts.get(tuple(t[at:at + 5]))) is not None:
            found.update(range(k, k + 5))
    return len(found) >= min(12, -(-len(i) * 4 // 5))


def test_pipeline_is_its_stages(spark):
    tables = {n: spark.read.parquet(f"{SF_DIR}/{n}.parquet") for n in ("documents", "labels", "benchmark")}
    texts = {r.doc_id: r.text for r in tables["documents"].collect()}
    good = {r.doc_id for r in quality.classify(tables["documents"], tables["labels"]).filter("predicted = 1").collect()}
    classes = shingle_classes([(i, texts[i]) for i in good])
    kept = [i for i in good if classes[i][1] == i]
    items = [r.text for r in tables["benchmark"].collect()]
    clean = [i for i in kept if not any(holds(texts[i], item) for item in items)]
    hidden = {r.doc_id: r.text for r in pii.with_pseudonyms(tables["documents"]).collect()}
    run = pieces.coder(MODEL)
    found = {r.doc_id: (r.n_pieces, r.text, r.round_trip) for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    assert found.keys() == set(clean) and 0 < len(clean) < len(texts)
    assert found == {i: (len(run.own.encode(hidden[i] or "")), hidden[i] or "", True) for i in clean}


def test_stages_on_odd_rows(spark):
    base = tuple(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").first())
    rows = [base, base, (None, None, None, None, None), (-1, "", None, "x", 0), (-2, "word " * 50_000, "en", None, None)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score int, row int")
    for _, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.limit(0)):
            made = stage(spark, given, SF_DIR)
            assert stage is corpus_pipeline.STAGES[-1][1] or made.columns == docs.columns
            assert made.count() <= given.count()
    assert corpus_pipeline.drop_near_duplicates(spark, docs, SF_DIR).count() == 4
