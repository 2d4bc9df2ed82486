"""The leveled change log beside a plain dictionary, and the files that it opens."""

import random

import pytest
from pyspark.sql import functions as F

from dialoglens.session import fresh_path
from dialoglens.sources.store import ChangeTable

SCHEMA = "k string, v int, at timestamp"


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, v int, s long").select("k", "v", F.timestamp_seconds("s").alias("at"))


def stored(table, first=None):
    return sorted(((r.k or "", r.v) for r in table.read(first).collect()))


def opened(table, first=None):
    return len(table.changes(first).inputFiles())


def test_files_opened_do_not_grow_with_the_history(spark):
    """Many batches of one month, and a few rows of another month at the beginning."""
    table = ChangeTable(spark, fresh_path(spark, "levels"), SCHEMA, ["k"], time="at", fanout=3)
    want, most, month = {}, [], 90 * 86_400
    table.put(frame(spark, [("old", 0, 5)]), 0)
    for batch in range(1, 28):
        rows = [(f"k{batch % 5}", batch, month), (f"n{batch}", batch, month + 60)]
        want |= {k: v for k, v, _ in rows}
        table.put(frame(spark, rows), batch)
        most.append(len(table.current("1970-04-01")))
    assert stored(table) == sorted([*want.items(), ("old", 0)])
    assert stored(table, "1970-04-01") == sorted(want.items())
    assert max(most) <= 3 * 4 and len([r for r in table.current() if r.month == "1970-01-01"]) == 1
    # folders of merged runs are gone, so that listing doesn't grow either
    assert len(table.runs()) <= 3 * 6
    assert opened(table, "1970-04-01") < opened(table) <= 4 * len(table.current())
    plan = table.changes(F.lit("1970-04-01").cast("date"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    table.compact()
    assert stored(table) == sorted([*want.items(), ("old", 0)]) and len(table.current()) == len(table.runs()) == 2


@pytest.mark.parametrize("keep", ["last", "first"])
def test_any_history_gives_the_winning_versions(spark, keep):
    """Repeated batches, also ones that were merged long ago, keys that are taken away, and keys without a time."""
    draw = random.Random(len(keep))
    table = ChangeTable(spark, fresh_path(spark, "history"), SCHEMA, ["k"], time="at", keep=keep, fanout=2)
    batches: dict[int, tuple] = {}

    def made():
        rows = [(draw.choice(["a", "b", "c", "d", None]), draw.randrange(100), draw.choice([5, 40 * 86_400, 70 * 86_400, None])) for _ in range(2)]
        rows = [rows[0], *[r for r in rows[1:] if r[0] != rows[0][0]]]
        return rows, [(draw.choice("abcd"),)] if draw.random() < 0.3 else []

    def wanted():
        versions = {}
        for batch, (rows, gone) in batches.items():
            for k, v, _ in rows:
                versions.setdefault(k, {}).setdefault(batch, []).append(v)
            for (k,) in gone:
                versions.setdefault(k, {}).setdefault(batch, [])
        pick = max if keep == "last" else min
        return sorted((k or "", v) for k, of in versions.items() for v in of[pick(of)])

    for step, batch in enumerate([0, 1, 2, 2, 3, 4, 5, 1, 6, 7, 7, 8]):
        rows, gone = made()
        if batch in batches:  # a repeated batch has the keys that it had
            gone, rows = batches[batch][1], [(k, draw.randrange(100), t) for k, _, t in batches[batch][0]]
        batches[batch] = (rows, gone)
        table.put(frame(spark, rows), batch, spark.createDataFrame(gone, "k string") if gone else None)
        if step > 6:
            assert stored(table) == wanted()
    table.compact()
    assert stored(table) == wanted()
    batches[9] = ([("a", 1, 5)], [])
    table.put(frame(spark, [("a", 1, 5)]), 9)
    assert stored(table) == wanted()
