"""Merkle manifest of a dataset: one tree for each language, their roots in one more, and proofs by a recursive query.

A leaf is the digest of a row's framed values. The leaves of a language, in ascending order, get a position; runs of
2 ** `STRIDE` nodes climb `STRIDE` levels in one step, until one node of the tree remains. What is built is stored as node
rows: the row of a node has the way to its ancestor `STRIDE` levels above (for each level what stands left and right of
the node there) and a link to that ancestor's row. The row of a language's last node links to the tree of languages.

The recursive query begins with every leaf, meets the row that its link names, appends the siblings found there to the
proof, folds the digest over them, and goes on with the row's own link until there is none. Rows above two steps
are stored once for each run of 65,536 leaves, so no node row meets more leaves than that, however large the tree.

Defined results: NULL values are framed as `-`; a NULL doc_id or lang comes first; rows with one doc_id are ordered by
their leaf, and equal rows, which are interchangeable, have a place each; a NULL n_chars is not tampered with, and the
largest long counts on; an empty table gives no rows; other columns are not part of a leaf.
"""

from __future__ import annotations

import contextlib
import dataclasses
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dialoglens.llm.graph import counted_small, small_batches
from dialoglens.operators.skew import number_rows
from dialoglens.session import materialize

#: Levels of a step; node rows above two steps are stored once for each run of 4 ** STRIDE leaves.
STRIDE = 8
#: Level numbers of the tree of languages begin here.
CROWN = 1000
GROUPS_A_BATCH = 64
TAMPERED_EACH = 7

FRAMED = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:binary,right:binary>>"
RESULT_SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


# ---- leaves --------------------------------------------------------------------------------------------------------

def framed(value: Column) -> Column:
    """UTF-8 byte count, `:` and value, or `-`."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    """Binary sha256 of the framed values, one after the other."""
    return F.unhex(F.sha2(F.concat(*map(framed, values)).cast("binary"), 256))


def leaves_of(docs: DataFrame, claimed: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, lang, leaf, and in `claim` the leaf of the row with the columns `claimed` in place of its own."""
    own = [F.col(c) for c in FRAMED]
    told = [(claimed or {}).get(c, F.col(c)) for c in FRAMED]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", digest(*own).alias("leaf"), digest(*told).alias("claim"))


def tampered_count() -> Column:
    """n_chars, one more in the rows whose id's checksum seven divides."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED_EACH == 0
    return F.col("n_chars").cast("decimal(20,0)") + F.when(hit, 1).otherwise(0)


def with_places(leaves: DataFrame) -> DataFrame:
    """Add tree (the number of the language in order), pos in it, and total, the tree's number of leaves."""
    stored = materialize(leaves.withColumn("key", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-"))), "leaves")
    ranked = number_rows(stored.withColumn("tie", F.monotonically_increasing_id()), F.col("key"), F.asc_nulls_first("doc_id"), F.col("leaf"), F.col("tie"))
    ranked = materialize(ranked, "ranked")
    trees = ranked.groupBy("key").agg(F.min("rank").alias("first"), F.count("*").alias("total"))
    trees = materialize(number_rows(trees, F.col("key"), name="place").withColumn("tree", F.col("place") - 1).drop("place"), "trees")
    return ranked.join(counted_small(trees), "key").select("tree", (F.col("rank") - F.col("first")).alias("pos"), "total", F.col("leaf").alias("digest"), "doc_id", "claim")


# ---- building ------------------------------------------------------------------------------------------------------

def climb_run(digests: list[bytes], levels: int | None) -> tuple[list[list[tuple[bytes, bytes]]], bytes]:
    """For each node of a run its neighbours left and right on the way up, and what the run becomes.

    The run climbs `levels` levels, or until one node remains.
    """
    paths: list[list[tuple[bytes, bytes]]] = [[] for _ in digests]
    level = 0
    while len(digests) > 1 if levels is None else level < levels:
        for k, path in enumerate(paths):
            at = k >> level
            if at & 1:
                path.append((digests[at - 1], b""))
            else:
                path.append((b"", digests[at + 1] if at + 1 < len(digests) else b""))
        digests = [hashlib.sha256(b"".join(d.hex().encode() for d in digests[k:k + 2])).digest() for k in range(0, len(digests), 2)]
        level += 1
    return paths, digests[0]


def climb_batches(batches: Iterator[pa.RecordBatch], stride: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        members = batch.column("members")
        known = members.flatten().field("digest").to_pylist()
        ends = members.offsets.to_pylist()
        tops, counts, left, right = [], [], [], []
        for begin, end, total in zip(ends, ends[1:], batch.column("total").to_pylist(), strict=False):
            begin, end = begin - ends[0], end - ends[0]
            paths, top = climb_run(known[begin:end], stride if total > 1 << stride else None)
            tops.append(top)
            for path in paths:
                counts.append(len(path))
                left += [x for x, _ in path]
                right += [y for _, y in path]
        steps = pa.StructArray.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["left", "right"])
        each = pa.ListArray.from_arrays(pa.array(offsets_of(counts), pa.int32()), steps)
        paths = pa.ListArray.from_arrays(pa.array([e - ends[0] for e in ends], pa.int32()), each)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tops, pa.binary()), paths], names=[*batch.schema.names, "top", "paths"])


def offsets_of(counts: list[int]) -> list[int]:
    out = [0]
    for n in counts:
        out.append(out[-1] + n)
    return out


def band(nodes: DataFrame, carried: list[str], stride: int) -> DataFrame:
    """tree, run, total, members and, for each run of nodes, their paths and the node that they become."""
    run = F.shiftright("pos", stride).alias("run")
    member = F.struct("pos", "digest", *carried)
    grouped = nodes.groupBy("tree", run, "total").agg(F.sort_array(F.collect_list(member)).alias("members"))
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in grouped.schema)}, top binary, paths array<{PATH}>"
    return grouped.mapInArrow(lambda batches: climb_batches(batches, stride), schema)


def levels_of(nodes: DataFrame, carried: list[str], stride: int) -> tuple[list[DataFrame], DataFrame]:
    """The stored bands of all trees from below, and the top of each tree."""
    bands, tops, most = [], [], 1 << stride
    while True:
        grouped = materialize(band(nodes, [] if bands else carried, stride), "band")
        bands.append(grouped)
        tops.append(grouped.filter(F.col("total") <= most).select("tree", "top"))
        above = grouped.filter(F.col("total") > most)
        if above.isEmpty():
            break
        nodes = above.select("tree", F.col("run").alias("pos"), F.col("top").alias("digest"), F.ceil(F.col("total") / most).cast("long").alias("total"))
    found = tops[0]
    for more in tops[1:]:
        found = found.union(more)
    return bands, materialize(found, "tops")


def members_of(grouped: DataFrame, level: int, stride: int, last: int | None) -> DataFrame:
    """One row for each node of a band; `next` is the level of the row that it links to."""
    each = grouped.select("tree", "total", F.explode(F.arrays_zip("members", "paths")).alias("m")).select("tree", "total", "m.members.*", F.col("m.paths").alias("path"))
    return each.withColumn("next", F.when(F.col("total") > 1 << stride, F.lit(level + stride)).otherwise(F.lit(last).cast("int"))).drop("total")


@dataclasses.dataclass
class Manifest:
    """Stored trees: `leaves` with their way through the first levels, linked `nodes`, and the tops."""

    leaves: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    root: bytes | None
    stride: int


def build_manifest(placed: DataFrame, stride: int = STRIDE) -> Manifest:
    spark = placed.sparkSession
    with small_batches(spark, GROUPS_A_BATCH):
        bands, subroots = levels_of(placed, ["doc_id", "claim"], stride)
        upper, root = levels_of(
            subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(subroots.count()).cast("long").alias("total"), F.col("top").alias("digest")), [], stride
        )
    root = root.first()
    # a lone language's top is the root: its path has no step, and no row of the tree of languages is needed
    several = subroots.count() > 1
    last = CROWN if several else None
    leaves = members_of(bands[0], 0, stride, last).withColumnRenamed("digest", "leaf")
    columns = ["tree", "level", "slot", "digest", "path", "next"]
    runs = materialize(bands[0].select("tree", F.shiftright("run", stride).alias("slot")).distinct(), "runs")
    nodes = spark.createDataFrame([], f"tree long, level int, slot long, digest binary, path {PATH}, next int")
    for k, grouped in enumerate(bands[1:], 1):
        rows = members_of(grouped, k * stride, stride, last).withColumn("level", F.lit(k * stride))
        if k > 2:
            place = F.shiftright("slot", (k - 2) * stride)
            rows = runs.withColumn("pos", place).join(rows, ["tree", "pos"])
        else:
            rows = rows.withColumnRenamed("pos", "slot")
        nodes = nodes.union(rows.select(columns))
    for k, grouped in enumerate(upper if several else []):
        rows = members_of(grouped, CROWN + k * stride, stride, None).withColumn("level", F.lit(CROWN + k * stride)).drop("tree")
        rows = runs.withColumn("pos", F.shiftright("tree", k * stride)).join(rows, "pos")
        nodes = nodes.union(rows.select(columns))
    return Manifest(leaves, materialize(nodes, "nodes"), subroots, bytes(root["top"]) if root else None, stride)


# ---- proofs --------------------------------------------------------------------------------------------------------

FOLDED = "aggregate({path}, {start}, (a, s) -> unhex(sha2(concat(lower(hex(s.left)), lower(hex(a)), lower(hex(s.right))), 256)))"
SIBLINGS = "aggregate({path}, {start}, (a, s) -> concat(a, s.left, s.right))"

CLIMB = f"""
WITH RECURSIVE climb AS (
  SELECT doc_id, tree, pos, next, leaf, {SIBLINGS.format(path="path", start="binary('')")} AS proof,
    {FOLDED.format(path="path", start="claim")} AS folded
  FROM {{leaves}}
  UNION ALL
  SELECT c.doc_id, c.tree, c.pos, n.next, c.leaf, {SIBLINGS.format(path="n.path", start="c.proof")},
    {FOLDED.format(path="n.path", start="c.folded")}
  FROM climb c JOIN {{nodes}} n
    ON n.tree = c.tree AND n.level = c.next AND n.slot = shiftright(c.pos, least(c.next, {{shared}})))
SELECT doc_id, tree, leaf, proof, folded FROM climb WHERE next IS NULL
"""


@contextlib.contextmanager
def unlimited_recursion(spark: SparkSession) -> Iterator[None]:
    """Recursive queries run inside may return any number of rows; the number of steps stays limited."""
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def climbed(manifest: Manifest) -> DataFrame:
    """doc_id, tree, leaf, proof (all siblings) and folded, the digest that the claimed leaf leads to."""
    spark = manifest.leaves.sparkSession
    with unlimited_recursion(spark):
        return materialize(spark.sql(CLIMB, leaves=manifest.leaves, nodes=manifest.nodes, shared=2 * manifest.stride), "climbed")


def hexed(column: Column) -> Column:
    return F.lower(F.hex(column))


def verify_documents(docs: DataFrame, claimed: dict[str, Column] | None = None, stride: int = STRIDE) -> DataFrame:
    """Leaf, subroot, root and proof of every row of `docs`, and whether the row as `claimed` leads to the root."""
    spark = docs.sparkSession
    manifest = build_manifest(with_places(leaves_of(docs, claimed)), stride)
    if manifest.root is None:
        return spark.createDataFrame([], RESULT_SCHEMA)
    root = F.lit(manifest.root.hex())
    found = climbed(manifest).join(counted_small(manifest.subroots), "tree")
    return found.select(
        "doc_id", hexed("leaf").alias("leaf"), hexed("top").alias("subroot"), root.alias("root"),
        F.sha2(hexed("proof").cast("binary"), 256).alias("proof_sha256"), hexed("folded").alias("folded_root"), (hexed("folded") == root).alias("verified"),
    )
