import pytest
from pyspark.sql import functions as F

from dialoglens.functions import numbers, text, timing


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def column(spark, texts, make):
    return [r[0] for r in values(spark, [(t,) for t in texts], "c string", make(F.col("c")))]


# fixed values: inputs and outputs of the list rendering
CSV_CASES = [
    ('["Product A", "Product B", "Product C"]', "Product A, Product B, Product C"),
    ("[\"Product 'A'\", \"Service 'B'\"]", "Product A, Service B"),
    ('["Item1", "Item2", "Item3"]', "Item1, Item2, Item3"),
    ('{"key1": "value1", "key2": "value2"}', "key1: value1, key2: value2"),
    ('{"product": "iPhone", "price": "999"}', "product: iPhone, price: 999"),
    ('{"items": ["a", "b"]}', "items: a, b"),
    ("['Item A', 'Item B']", "Item A, Item B"),
    ("", ""),
    (None, ""),
    ('["Mobile Plan", "Internet Package", "TV Bundle"]', "Mobile Plan, Internet Package, TV Bundle"),
    ('["Follow up with customer", "Send invoice", "Schedule callback"]', "Follow up with customer, Send invoice, Schedule callback"),
    ('{["value\'s here"]}', "values here"),
    ('["חבילת סלולר", "אינטרנט"]', "חבילת סלולר, אינטרנט"),
    # empty values go, nested ones are spaced
    ('[0, false, null, "", "x", {"a": 1, "b": "p,q"}]', "x, a: 1, b: p,q"),
    ("plain,  text , ", "plain, text"),
]


def test_json_to_csv(spark):
    assert column(spark, [c[0] for c in CSV_CASES], text.json_to_csv) == [c[1] for c in CSV_CASES]


def test_action_items(spark):
    long = "[" + ", ".join(f'"item {i:03d}"' for i in range(100)) + "]"
    assert column(spark, [long], text.action_items_text)[0].endswith("item 099")
    got = column(
        spark,
        ['[{"due": "x", "action": "call"}, {"name": "None", "instructions": "write"}]', '["a", "none", "b"]', "do [it]", "{\"task\": \"t\"}", "5", None, long],
        lambda c: text.action_items_text(c, 500),
    )
    assert got[:6] == ["call, write", "a, b", "do it", "t", "", ""]
    assert len(got[6]) <= 500 and got[6].endswith("item 049")


def test_products(spark):
    cases = {
        "quantity: 2": None, "N/A": None, "none": None, ":": None, "price": None, "model: x": None, "iphone 7": "iphone 17",
        "iphone 12 pro": "iphone 17 pro", "iphone 120": "iphone 120", "אייפון 12": "iphone 17", "a   b": "a b", "  ": None,
    }
    assert column(spark, list(cases), text.normalize_product) == list(cases.values())


def test_repair(spark):
    cases = {
        '{"a": 1}': '{"a": 1}',
        'so: {"a": 1} ok': '{"a": 1}',
        '{"a": 1,}': '{"a": 1}',
        '{"a": "x"\n"b": 2}': '{"a": "x",\n"b": 2}',
        '{"a": {"b": 1}': '{"a": {"b": 1}}',
        '{"a": "100 ש"ח"}': '{"a": "100 שח"}',
        "no json": None,
    }
    assert column(spark, list(cases), text.repair_json) == list(cases.values())


def test_scores_and_missing_values(spark):
    assert column(spark, ["positive", "שלילי", "7", "-2", "2.7", "x", None], text.sentiment_to_int) == [4, 2, 5, 1, 2, 3, 3]
    assert column(spark, ["4", "x", None, "4.5", "0"], text.satisfaction_to_int) == [4, 3, 3, 3, 1]
    rows = values(spark, [(0.66,), (0.2,), (0.9,), (None,)], "s double", numbers.rescale_score(F.col("s"))["churn_score"])
    assert [r[0] for r in rows] == [50, 0, 100, 0]


def test_delta(spark):
    cases = {(5, 0): (5, 100, "up"), (0, 0): (0, 0, "same"), (-1, 4): (-5, -125, "down"), (4, 4): (0, 0, "same"), (None, 2): (-2, -100, "down")}
    got = values(spark, list(cases), "c int, p int", numbers.delta(F.col("c"), F.col("p")).alias("d"))
    assert [tuple(r[0]) for r in got] == list(cases.values())


def test_iso_round_trip(spark):
    for iso in ("2024-01-02T03:04:05", "2024-01-02T03:04:05.120000"):
        assert column(spark, [iso], lambda c: timing.to_iso(timing.parse_iso(c))) == [iso]
    assert column(spark, ["yesterday"], timing.parse_iso) == [None]


@pytest.mark.parametrize("value,unit,days", [(90, "minutes", 0.0625), (36, "hours", 1.5), (2, "days", 2)])
def test_to_days(value, unit, days):
    assert timing.to_days(value, unit) == days


def test_filter_reaches_the_scan(db):
    plan = timing.since(db.conversation_summary, "conversation_time", 7, db.as_of)._jdf.queryExecution().toString()
    assert "GreaterThan(ts," in plan


def test_embedder_counts_words(spark):
    import zlib

    import numpy as np

    from dialoglens.functions.vectors import hashing_embedder

    told = ["Some words, some more words", "  lead and trail \n", "", None, "שירות גרוע", "x" * 1000]
    frame = spark.createDataFrame(list(enumerate(told)), "id int, text string").repartition(2)
    found = {r.id: r.v for r in frame.select("id", hashing_embedder(16)("text").alias("v")).collect()}
    for k, text in enumerate(told):
        vector = np.zeros(16)
        for word in (text or "").lower().split():
            code = zlib.crc32(word.encode())
            vector[code % 16] += 1 if code & 0x80000000 else -1
        norm = np.linalg.norm(vector)
        assert np.allclose(found[k], vector / norm if norm else vector, atol=1e-6)
