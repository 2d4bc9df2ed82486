"""Connected components and joins with small sides, as Spark jobs."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dialoglens.session import materialize

SMALL_ROWS = 1_000_000
BATCH_ROWS = 3000


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Jobs run inside hand whole texts to Python in batches of at most `rows`, which bounds the memory of a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def counted_small(table: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """`table`, a stored frame of few narrow columns, to be broadcast where its rows are counted to be few enough."""
    return F.broadcast(table) if table.count() <= most else table


def row_key() -> Column:
    """What tells a row of documents from others, also without an id; equal rows share it."""
    return F.xxhash64("doc_id", "text")


def components(edges: DataFrame) -> DataFrame:
    """`node` and `component`, its smallest reachable node, for all nodes of the edges (a, b).

    Large-star and small-star steps alternate until the edges stay; each node then hangs on its component's smallest.
    The joins are on single nodes, which the adaptive join splits where one node has very many edges.
    """
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        before = now
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        edges = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", "m")).distinct()
        edges = materialize(edges, "edges")
