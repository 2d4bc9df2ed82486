"""Exact set-similarity join on word shingles with a token-group matrix.

1. Documents with equal sets become one class, kept by its smallest doc_id.
2. Similar classes become groups: classes that share two-minhash keys are compared with the smallest of their key, and
   verified links make connected groups, which are cut into blocks of about `BLOCK` members.
3. The matrix holds the tokens of each block's union. All sets order their tokens alike, common ones last, and two
   sets with the wanted similarity share a token among their first ones (the prefix), so the matrix needs only those.
4. A query set meets the blocks of other groups that share prefix tokens with it. The number shared bounds the overlap
   with every member; blocks that can't reach the threshold are dropped.
5. For the rest the full union of a block bounds the overlap once more, and only blocks that still qualify are opened:
   members are compared until one links, since the members of a block are connected already.

The order of the tokens decides the work, never the result. Common tokens are those that repeat within batches of
documents all over the corpus; there can be only so many, as each must be in a fixed share of the documents.

Defined results: a document without text or words has no shingles and links with nothing; rows with one doc_id count
as one document whose texts are all compared and whose n_shingles is that of the largest set; a row without doc_id links
with nothing and has no component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from dialoglens.llm.graph import components, counted_small, small_batches
from dialoglens.llm.shingles import mixed, odd_numbers, shingle_sets, text_slices
from dialoglens.session import materialize

KEYS = 4
BATCH_BYTES = 8_000_000
BLOCK = 64
QUERIES_A_BLOCK = 256
#: A token is common when batches that hold it at least twice count so many documents, and so large a share of all.
COMMON_DOCUMENTS, COMMON_SHARE = 64, 1e-4

SKETCH_SCHEMA = "doc_id long, n long, sign_a long, sign_b long, keys array<long>, prefix array<long>"
SEEDS = odd_numbers(11, 2 * KEYS)


def needed(a, b):
    """Least overlap of sets of sizes a and b with 100 * overlap >= 75 * union."""
    return -(-3 * (a + b) // 7)


def prefix_length(n: int) -> int:
    return n - -(-3 * n // 4) + 1


# ---- numpy on batches ----------------------------------------------------------------------------------------------

def batch_sets(batch: pa.RecordBatch) -> Iterator[tuple[int | None, np.ndarray]]:
    """doc_id and shingle set of each row of (doc_id, text)."""
    for begin, end in text_slices(batch.column(1)):
        yield from zip(batch.column(0)[begin:end].to_pylist(), shingle_sets(batch.column(1)[begin:end]), strict=True)


def repeated_tokens(docs: DataFrame) -> DataFrame:
    """token, documents: tokens that are in two documents of some batch, and in how many of such batches' documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in text_slices(batch.column(0), BATCH_BYTES):
                sets = [s for x, y in text_slices(batch.column(0)[begin:end]) for s in shingle_sets(batch.column(0)[begin:end][x:y])]
                tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
                again = counts > 1
                yield pa.RecordBatch.from_arrays([pa.array(tokens[again].view(np.int64)), pa.array(counts[again])], names=["token", "documents"])

    return docs.select("text").mapInArrow(count, "token long, documents long").groupBy("token").agg(F.sum("documents").alias("documents"))


def sketches(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """Size, signature, minhash keys and prefix of each document's set; `common` tokens are last in the order."""
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(common))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = shared.value
        for batch in batches:
            ids, sizes, sign_a, sign_b, keys, prefixes = [], [], [], [], [], []
            for doc_id, tokens in batch_sets(batch):
                n = len(tokens)
                ids.append(doc_id)
                sizes.append(n)
                sign_a.append(int(mixed(tokens).sum().astype(np.int64)) if n else 0)
                sign_b.append(int(mixed(tokens ^ SEEDS[0]).sum().astype(np.int64)) if n else 0)
                if not n or doc_id is None:
                    keys.append(np.empty(0, np.int64))
                    prefixes.append(np.empty(0, np.int64))
                    continue
                least = np.array([(tokens * s ^ (tokens >> np.uint64(29))).min() for s in SEEDS])
                keys.append(mixed(least[::2] + mixed(least[1::2] + SEEDS[:KEYS])).view(np.int64))
                p = prefix_length(n)
                if len(late):
                    at = np.minimum(np.searchsorted(late, tokens), len(late) - 1)
                    hot = late[at] == tokens
                    tokens = np.concatenate([tokens[~hot][:p], tokens[hot]])
                prefixes.append(tokens[:p].view(np.int64))
            if ids:
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in some])]), pa.int32()), pa.array(np.concatenate(some))) for some in (keys, prefixes)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sign_a, pa.int64()), pa.array(sign_b, pa.int64()), *lists],
                    names=["doc_id", "n", "sign_a", "sign_b", "keys", "prefix"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sketch, SKETCH_SCHEMA)


def stored_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and set (sorted 64-bit numbers) of the documents in `ids`, computed anew from their texts."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in text_slices(batch.column(1)):
                sets = [s.tobytes() for s in shingle_sets(batch.column(1)[begin:end])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[begin:end], pa.array(sets, pa.binary())], names=["id", "tokens"])

    wanted = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(counted_small(ids), "id", "left_semi")
    # a document's empty text links with nothing
    return materialize(wanted.mapInArrow(make, "id long, tokens binary").filter(F.octet_length("tokens") > 0), "sets")


@F.pandas_udf(T.BooleanType())
def linked(left: pd.Series, right: pd.Series) -> pd.Series:
    def one(a: bytes, b: bytes) -> bool:
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        return len(np.intersect1d(x, y, assume_unique=True)) >= needed(len(x), len(y))

    return pd.Series([one(a, b) for a, b in zip(left, right, strict=True)], dtype=bool)


def open_blocks(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
    """Links of the query sets with a block: its union bounds each overlap, and only then are members compared."""
    sets = [np.frombuffer(t, np.uint64) for t in members["others"]]
    found = []
    if sets:
        union, ids = np.unique(np.concatenate(sets)), members["member"].tolist()
        for query, tokens in zip(queries["id"].tolist(), queries["tokens"], strict=True):
            own = np.frombuffer(tokens, np.uint64)
            at = np.minimum(np.searchsorted(union, own), len(union) - 1)
            most = int((union[at] == own).sum())
            if 4 * most < 3 * len(own):
                continue
            for other, theirs in zip(ids, sets, strict=True):
                least = needed(len(own), len(theirs))
                if least <= min(most, len(theirs)) and len(np.intersect1d(own, theirs, assume_unique=True)) >= least:
                    found.append((query, other))
                    break
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


# ---- jobs ----------------------------------------------------------------------------------------------------------

def common_tokens(docs: DataFrame, n_docs: int) -> np.ndarray:
    """Tokens to put last. Each is in a fixed share of all documents, which bounds their number."""
    least = max(COMMON_DOCUMENTS, int(COMMON_SHARE * n_docs))
    rows = repeated_tokens(docs).filter(F.col("documents") >= least).select("token").toArrow()
    return rows.column(0).to_numpy().astype(np.int64).view(np.uint64)


def minhash_links(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Verified links (a, b) of classes with the smallest class of each of their minhash keys."""
    keyed = kept.select("id", F.posexplode("keys").alias("k", "key"))
    first = keyed.groupBy("k", "key").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first <> last").drop("last")
    pairs = materialize(keyed.join(first, ["k", "key"]).filter("id <> first").select("id", "first").distinct(), "pairs")
    ids = materialize(pairs.select("id").union(pairs.select("first")).distinct(), "ids")
    sets = stored_sets(docs, ids)
    both = pairs.join(sets, "id").join(sets.select(F.col("id").alias("first"), F.col("tokens").alias("others")), "first")
    return materialize(both.filter(linked("tokens", "others")).select(F.col("id").alias("a"), F.col("first").alias("b")).distinct(), "links")


def with_blocks(kept: DataFrame, grouped: DataFrame) -> DataFrame:
    """Add group and block. A group's members fall into blocks by their hash."""
    sizes = grouped.groupBy("component").agg(F.count("*").alias("members"))
    placed = materialize(
        grouped.join(sizes, "component").select(
            F.col("node").alias("id"), F.col("component").alias("group"),
            F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / BLOCK)).cast("int").alias("block"),
        ),
        "groups",
    )
    return kept.join(counted_small(placed), "id", "left").select(
        "id", "n", "prefix", F.coalesce("group", "id").alias("group"), F.coalesce("block", F.lit(0)).alias("block")
    )


def candidate_blocks(members: DataFrame) -> DataFrame:
    """(id, group, block): query sets and the blocks of smaller groups that may hold a set linked with them."""
    tokens = members.select("id", "n", "group", "block", F.explode("prefix").alias("token"))
    across = tokens.groupBy("token").agg(F.min("group").alias("x"), F.max("group").alias("y")).filter("x <> y").select("token")
    shared = materialize(tokens.join(across, "token", "left_semi"), "shared")
    matrix = shared.groupBy("token", F.col("group").alias("g"), F.col("block").alias("b")).agg(F.min("n").alias("low"), F.max("n").alias("high"))
    met = (
        shared.join(matrix, "token").filter("group > g AND 4 * high >= 3 * n AND 3 * low <= 4 * n")
        .groupBy("id", "n", "g", "b").agg(F.count("*").alias("met"), F.min("low").alias("low"), F.max("high").alias("high"))
    )
    # the overlap is at most `met` and what lies behind the prefix of the set whose prefix ends first
    low = F.greatest("low", F.ceil(F.col("n") * 3 / 4))
    high = F.least("high", F.floor(F.col("n") * 4 / 3))

    def least(other):
        behind = F.ceil(F.greatest(F.col("n"), other) * 3 / 4) - 1
        return F.ceil((F.col("n") + other) * 3 / 7) - behind

    # up to n the least number grows with the size; above it falls, but for single steps up: two sizes more never need more
    sizes = (low, high, F.greatest(low, high - 1))
    return met.filter(F.col("met") >= F.least(*map(least, sizes))).select("id", "g", "b")


def block_links(docs: DataFrame, members: DataFrame, candidates: DataFrame) -> DataFrame:
    """Verified links (a, b) between query sets and members of their candidate blocks.

    A block with many queries is opened by several tasks, each with some of the queries and all of its members.
    """
    candidates = materialize(candidates, "candidates")
    parts = candidates.groupBy("g", "b").agg(F.ceil(F.count("*") / QUERIES_A_BLOCK).cast("int").alias("parts"))
    opened = materialize(
        members.select("id", F.col("group").alias("g"), F.col("block").alias("b")).join(parts, ["g", "b"])
        .select("id", "g", "b", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")),
        "opened",
    )
    asked = candidates.join(parts, ["g", "b"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    ids = materialize(candidates.select("id").union(opened.select("id")).distinct(), "ids")
    sets = stored_sets(docs, ids)
    queries = asked.join(sets, "id").select("g", "b", "part", "id", "tokens")
    theirs = sets.select(F.col("id").alias("member"), F.col("tokens").alias("others"))
    others = opened.withColumnRenamed("id", "member").join(theirs, "member").select("g", "b", "part", "member", "others")
    key = ["g", "b", "part"]
    return queries.groupBy(*key).cogroup(others.groupBy(*key)).applyInPandas(open_blocks, "a long, b long")


def links_of_texts(placed: DataFrame) -> DataFrame:
    """Links (a, b) between the classes that hold texts of one document."""
    several = placed.groupBy("doc_id").agg(F.min("id").alias("b"), F.max("id").alias("last")).filter("b <> last").drop("last")
    return placed.join(several, "doc_id").filter("id <> b").select(F.col("id").alias("a"), "b").distinct()


def similarity_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    with small_batches(docs.sparkSession):
        common = common_tokens(docs, docs.count())
        sketched = materialize(sketches(docs, common), "sketches")
        sign = ["sign_a", "sign_b", "n"]
        known = sketched.filter("doc_id IS NOT NULL AND n > 0")
        classes = known.groupBy(*sign).agg(F.min("doc_id").alias("id"))
        placed = materialize(known.select("doc_id", *sign).join(classes, sign).select("doc_id", *sign, "id"), "classes")
        # a document's other texts stay where one of them is a copy
        copies = materialize(placed.filter("doc_id <> id").select("doc_id", *sign).distinct(), "copies")
        kept = known.join(counted_small(copies), ["doc_id", *sign], "left_anti").select(F.col("doc_id").alias("id"), "n", "keys", "prefix")
        first = minhash_links(docs, kept)
        members = with_blocks(kept, materialize(components(first), "groups"))
        links = materialize(block_links(docs, members, candidate_blocks(members)), "links")
        own = links_of_texts(placed)
        alike = materialize(components(first.union(links).union(own)), "components")
    found = placed.join(counted_small(alike.withColumnRenamed("node", "id")), "id", "left").select("doc_id", "n", F.coalesce("component", "id").alias("component"))
    empty = sketched.filter("doc_id IS NOT NULL AND n = 0").select("doc_id", "n", F.col("doc_id").alias("component"))
    each = found.unionByName(empty).groupBy("doc_id").agg(F.max("n").alias("n_shingles"), F.min("component").alias("component_id"))
    nameless = sketched.filter("doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return each.unionByName(nameless)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The document with the smallest doc_id of each component, once, with all its columns."""
    dropped = similarity_classes(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(counted_small(materialize(dropped, "dropped")), "doc_id", "left_anti").select(*docs.columns)
    again = materialize(kept.groupBy("doc_id").agg(F.count("*").alias("_rows")).filter("_rows > 1 AND doc_id IS NOT NULL").select("doc_id"), "repeated")
    if again.isEmpty():
        return kept
    first = Window.partitionBy("doc_id").orderBy("text")
    once = kept.join(counted_small(again), "doc_id", "left_semi").withColumn("_first", F.row_number().over(first)).filter("_first = 1")
    return kept.join(counted_small(again), "doc_id", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))
