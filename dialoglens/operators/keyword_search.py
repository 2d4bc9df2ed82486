"""Any number of keywords against texts, in one pass over each text and without a shuffle of texts.

A few keywords are conditions of the plan. More are found by q-grams: each keyword stands under its rarest gram of
`GRAM` characters, a text's grams are looked up once, and only keywords whose gram occurs are searched for. Keywords of
fewer characters stand under themselves. The table of grams goes to the tasks in slices of bounded size; further slices
are further passes over the text, never over the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from dialoglens.operators.skew import number_rows
from dialoglens.session import materialize

PLAN_KEYWORDS = 256
SLICE_KEYWORDS = 500_000
GRAM = 3
MATCH = "struct<category:string,strength:string,keyword:string,category_pos:bigint>"
MATCH_FIELDS = "category string, strength string, keyword string, category_pos bigint"


def ordered_keywords(keywords: DataFrame) -> DataFrame:
    """pos (the order of the frame), category, the category's first place, strength and lower-cased keyword."""
    rows = keywords.select("category", "strength", F.lower("keyword").alias("keyword")).withColumn("_order", F.monotonically_increasing_id())
    rows = materialize(rows.filter("keyword IS NOT NULL"), "keywords")
    rows = rows.withColumn("category_pos", F.min("_order").over(Window.partitionBy("category")))
    return materialize(number_rows(rows, F.col("_order"), name="pos").drop("_order"), "ordered")


def with_grams(ordered: DataFrame) -> DataFrame:
    """Add `gram`: the keyword's gram that the fewest keywords have, or the whole of a short one."""
    grams = F.array_distinct(F.regexp_extract_all("keyword", F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))
    each = ordered.select("pos", F.explode(F.when(F.length("keyword") < GRAM, F.array("keyword")).otherwise(grams)).alias("gram"))
    counts = each.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = each.join(counts, "gram").groupBy("pos").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    return ordered.join(rarest, "pos")


class GramTable:
    """Keywords under their grams, for one pass over texts."""

    def __init__(self, grams: list[str], keywords: list[str], matches: pa.StructArray):
        self.keywords, self.matches = keywords, matches
        self.under: dict[str, list[int]] = {}
        for k, gram in enumerate(grams):
            self.under.setdefault(gram, []).append(k)
        self.known = set(self.under)
        self.lengths = sorted({len(g) for g in grams})

    def found(self, text: str) -> list[int]:
        """Numbers of the keywords that the text contains, in order."""
        hits = []
        for n in self.lengths:
            grams = {text[k:k + n] for k in range(len(text) - n + 1)} if n else {""}
            for gram in grams & self.known:
                hits += [k for k in self.under[gram] if self.keywords[k] in text]
        return sorted(hits)


def with_gram_matches(texts: DataFrame, lowered: Column, tables: list) -> DataFrame:
    """Add `matches` by the gram tables that the broadcast variables `tables` hold, which are in the keywords' order."""
    rows = texts.withColumn("_lowered", lowered)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [table.value for table in tables]
        for batch in batches:
            ends, hits = [0], [[] for _ in known]
            for text in batch.column(batch.num_columns - 1).to_pylist():
                for found, table in zip(hits, known, strict=True):
                    found.append(table.found(text))
                ends.append(ends[-1] + sum(len(found[-1]) for found in hits))
            # a text's matches of all tables, one after the other
            bases = np.cumsum([0, *(sum(map(len, found)) for found in hits)])[:-1].tolist()
            taken = pa.concat_arrays([t.matches.take(pa.array([k for one in found for k in one], pa.int64())) for found, t in zip(hits, known, strict=True)])
            order, at = [], list(bases)
            for row in range(batch.num_rows):
                for i, found in enumerate(hits):
                    order += range(at[i], at[i] + len(found[row]))
                    at[i] += len(found[row])
            matches = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), taken.take(pa.array(order, pa.int64())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], matches], names=[*batch.schema.names[:-1], "matches"])

    return rows.mapInArrow(run, T.StructType([*texts.schema.fields, T.StructField("matches", T.ArrayType(T.StructType.fromDDL(MATCH_FIELDS)))]))


def tables(spark: SparkSession, ordered: DataFrame, n: int, most: int) -> Iterator[GramTable]:
    """The keywords as gram tables of at most `most` keywords, in order."""
    graded = materialize(with_grams(ordered), "grams")
    for begin in range(0, n, most):
        part = graded.filter((F.col("pos") > begin) & (F.col("pos") <= begin + most)).orderBy("pos")
        rows = part.select("gram", "category", "strength", "keyword", "category_pos").toArrow().combine_chunks()
        columns = {c: rows.column(c).combine_chunks() for c in rows.column_names}
        names = ["category", "strength", "keyword", "category_pos"]
        yield GramTable(columns["gram"].to_pylist(), columns["keyword"].to_pylist(), pa.StructArray.from_arrays([columns[c] for c in names], names=names))


def planned_matches(lowered: Column, rows: list[tuple]) -> Column:
    """The same by one condition for each keyword (category, strength, keyword and the category's place)."""
    names = ("category", "strength", "keyword", "category_pos")
    entry = lambda row: F.struct(*[F.lit(value).alias(name) for name, value in zip(names, row, strict=True)])
    entries = [F.when(F.contains(lowered, F.lit(row[2])), entry(row)) for row in rows]
    return F.array_compact(F.array(*entries)).cast(f"array<{MATCH}>")


def with_matches(texts: DataFrame, keywords: DataFrame, text: str, in_plan: int = PLAN_KEYWORDS, in_slice: int = SLICE_KEYWORDS) -> DataFrame:
    """Add `matches`: the keywords that occur in the text, case ignored, in their order."""
    spark = texts.sparkSession
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    few = keywords.limit(in_plan + 1).collect()
    if len(few) <= in_plan:
        # a short list keeps its order on the driver, without a job of its own
        places = list(dict.fromkeys(r.category for r in few if r.keyword is not None))
        rows = [(r.category, r.strength, r.keyword.lower(), places.index(r.category)) for r in few if r.keyword is not None]
        return texts.withColumn("matches", planned_matches(lowered, rows))
    ordered = ordered_keywords(keywords)
    parts = [spark.sparkContext.broadcast(t) for t in tables(spark, ordered, ordered.count(), in_slice)]
    return with_gram_matches(texts, lowered, parts)
