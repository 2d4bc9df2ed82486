"""Benchmark decontamination by spaced-seed hashing.

Fixed masks look at some tokens of a stretch and pass over the others, so a seed still matches where a passed token was
replaced. Seeds of all training texts are joined with those of the benchmark items; a hit names an item and a diagonal
(place in the text less place in the item). Along each such diagonal the words are compared one by one: a word counts
where it is equal and dense, that is, with at least `DENSE` equal words among the five around it. A text holds an item
where `ENOUGH` words of it count, or `SHARE` of a short item.

Words are runs of letters and digits, lower-cased. Everything is DataFrame functions; the text side isn't shuffled
before the hits are known.

Defined results: a NULL or empty text or item has no words and no hits; an item with fewer words than the shortest mask
spans isn't searched; rows repeated with one doc_id give one row for each item; a row without doc_id is reported with
NULL; items with equal texts are all reported; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dialoglens.llm.graph import counted_small, row_key
from dialoglens.session import materialize

#: 1: the token counts, 0: it is passed over.
MASKS = ("11011011", "111010011", "110100111")
DENSE = 3
ENOUGH = 12
SHARE = 0.8


def words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def seeds_of(hashes: Column, n: Column, mask: str, number: int) -> Column:
    """Hash of the tokens that `mask` looks at, at each place where the mask fits."""
    offsets = [k for k, bit in enumerate(mask) if bit == "1"]
    places = F.slice(hashes, F.lit(1), F.greatest(n - len(mask) + 1, F.lit(0)))
    return F.transform(places, lambda x, i: F.xxhash64(x, *(F.get(hashes, i + k) for k in offsets[1:]), F.lit(number)))


def seeds(texts: DataFrame, keep: list[str], masks: tuple[str, ...] = MASKS) -> DataFrame:
    """`keep`, seed and place of every seed of the column `text`."""
    hashed = texts.select(*keep, F.transform(words("text"), lambda w: F.xxhash64(w)).alias("_h")).withColumn("_n", F.size("_h"))
    all_seeds = F.concat(*(seeds_of(F.col("_h"), F.col("_n"), mask, k) for k, mask in enumerate(masks)))
    return hashed.select(*keep, "_n", F.posexplode(all_seeds).alias("_at", "seed")).select(*keep, "seed", place_of("_at", "_n", masks).alias("place"))


def place_of(at: str, n: str, masks: tuple[str, ...]) -> Column:
    """Place in the text of number `at` of the seeds of all masks, which stand one mask after the other."""
    out, before = F.col(at), F.lit(0)
    for mask in masks:
        out = F.when(F.col(at) >= before, F.col(at) - before).otherwise(out)
        before = before + F.greatest(F.col(n) - len(mask) + 1, F.lit(0))
    return out


def seed_hits(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """row (key), item_id and diagonal of all hits; the item's seeds are broadcast where they are counted to be few."""
    item_seeds = materialize(seeds(benchmark.select("item_id", "text"), ["item_id"], masks), "item-seeds")
    item_seeds = item_seeds.withColumnRenamed("place", "item_place")
    text_seeds = seeds(docs.select(row_key().alias("row"), "text"), ["row"], masks)
    return (
        text_seeds.join(counted_small(item_seeds), "seed")
        .select("row", "item_id", (F.col("place") - F.col("item_place")).alias("diagonal")).distinct()
    )


def counted_words(text: Column, item: Column, diagonal: Column) -> Column:
    """Places in the item whose words are equal and dense on the diagonal."""
    first = F.greatest(F.lit(0), -diagonal)
    last = F.least(F.size(item), F.size(text) - diagonal)
    equal = F.transform(
        F.slice(item, first + 1, F.greatest(last - first, F.lit(0))),
        lambda w, i: F.when(w == F.get(text, i + first + diagonal), 1).otherwise(0),
    )
    around = F.transform(
        equal,
        lambda e, i: F.when(
            (e == 1) & (e + sum(F.coalesce(F.get(equal, i + k), F.lit(0)) for k in (-2, -1, 1, 2)) >= DENSE), i + first
        ),
    )
    return F.filter(around, lambda p: p.isNotNull())


def leaks(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """row, doc_id, item_id, n_matched, item_words and the first and last place of the item in the text."""
    items = benchmark.select("item_id", words("text").alias("item")).filter(F.size("item") > 0)
    hits = materialize(seed_hits(docs, benchmark, masks), "seed-hits")
    rows = docs.select(row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = rows.join(hits, "row").withColumn("text", words("text")).join(counted_small(materialize(items, "items")), "item_id")
    counted = held.select(
        "row", "doc_id", "item_id", F.size("item").alias("item_words"), "diagonal",
        F.explode(counted_words(F.col("text"), F.col("item"), F.col("diagonal"))).alias("place"),
    )
    each = counted.groupBy("row", "doc_id", "item_id", "item_words", "place").agg(
        F.min("diagonal").alias("low"), F.max("diagonal").alias("high")
    )
    found = each.groupBy("row", "doc_id", "item_id", "item_words").agg(
        F.count("*").alias("n_matched"),
        F.min(F.col("place") + F.col("low")).cast("long").alias("first_word"),
        F.max(F.col("place") + F.col("high")).cast("long").alias("last_word"),
    )
    return found.filter((F.col("n_matched") >= ENOUGH) | (F.col("n_matched") >= F.ceil(F.col("item_words") * SHARE)))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item that it holds."""
    return leaks(docs, benchmark).groupBy("doc_id", "item_id").agg(
        F.max("n_matched").alias("n_matched"), F.max("item_words").cast("long").alias("item_words"),
        F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"),
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    held = materialize(leaks(docs, benchmark).select(F.col("row").alias("_row")).distinct(), "leaks")
    return docs.join(counted_small(held), row_key() == F.col("_row"), "left_anti")
