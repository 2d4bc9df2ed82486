"""Clean-up of texts: what is dear is done only where it can matter."""

import re

from pyspark.sql import functions as F

from dialoglens.functions import text


def test_strip_is_the_pattern(spark):
    blanks = ["", " ", " a b ", "\t\n\x0b\f\ra\r\n", "a  ", "  a \x85", "\xa0a\xa0", "a   ", None]
    frame = spark.createDataFrame([(b,) for b in blanks], "v string")
    both = frame.select(text.strip(F.col("v")).alias("now"), F.regexp_replace("v", r"^\s+|\s+$", "").alias("pattern")).collect()
    assert [r.now for r in both] == [r.pattern for r in both]


def test_an_item_is_rendered_once(spark):
    items = spark.createDataFrame([('["a", " b ", "none", 0, 7, true, {"task": "c"}, " "]',), ("do [it] now",), ("+5",), ("NaN",), ("5",)], "v string")
    plan = items.select(F.transform(F.try_parse_json("v").cast("array<variant>"), text._plain_item))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"as string", plan)) == 1
    assert [r[0] for r in items.select(text.action_items_text(F.col("v"))).collect()] == ["a, b, 7, true, c", "do it now", "+5", "NaN", ""]
    guarded = items.select(text._read_json(F.col("v")))._jdf.queryExecution().optimizedPlan().toString()
    assert "substring" in guarded
