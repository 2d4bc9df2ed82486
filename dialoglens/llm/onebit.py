"""Nearest neighbours by inner product from randomly rotated one-bit codes, with error bounds and exact reranking.

Vectors fall to the nearest of a few centres, fitted on a bounded sample, and every vector of the table goes into a block
of its centre. A block stores, for each vector x with residual r = x - c from the block's mean c: the packed signs of
r after a fixed random rotation, the length of r, and the cosine f between r and its sign vector. For a query q

    <q, x>  is about  <q, c> + |r| * <signs, rotated q> / (sqrt(D) * f)

with an error that rarely exceeds `EPSILON` * |r| * |q| * sqrt((1 - f*f) / (f*f * (D - 1))). Only vectors whose estimate
plus this bound reaches the query's least wanted score are compared exactly.

The queries of a block search their own block first, which gives each a least wanted score; then each block's queries
go through runs of other blocks, in tasks of bounded size, and that score rises as they go. A block is left out for a
query where the mean's product and the greatest residual can't reach it.

Equal vectors are one point with its smallest ids; a query that several rows ask is asked once.

Defined results: vectors that are NULL, empty, zero or hold NULL or non-finite components, and rows without vec_id, take
no part; vectors of different lengths are never compared; rows repeated with one vec_id and vector count once, and
a vec_id is never its own neighbour; with fewer candidates than asked for, all are returned; equal scores are ordered by
vec_id; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from dialoglens.llm.files import read_whole, write_whole
from dialoglens.session import fresh_path, materialize

NEIGHBOURS = 20
QUERY_EACH = 20
BLOCK = 8192
CENTRES, SAMPLE, ROUNDS = 256, 8192, 8
#: Standard errors that an estimate's bound allows for.
EPSILON = 2.5
#: Below this many components only the certain bound of an estimate is used.
FEW = 16
BLOCKS_A_TASK = 16
SLICE = 256
SEED = 20_240

FOUND = "query long, id long, score double"
MANIFEST = "block long, path string, points long, queries long"


# ---- codes ---------------------------------------------------------------------------------------------------------

@functools.lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    """The same random rotation wherever it is needed."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(rows: np.ndarray) -> dict[str, np.ndarray]:
    """Mean, packed signs and correction scalars of a block's vectors."""
    centre = rows.mean(axis=0)
    rest = (rows - centre) @ rotation(rows.shape[1]).T
    length = np.sqrt((rest * rest).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        aligned = np.abs(rest).sum(axis=1) / (length * math.sqrt(rows.shape[1]))
    return {"centre": centre, "codes": np.packbits(rest >= 0, axis=1), "length": length, "aligned": np.where(length > 0, aligned, 1.0)}


class Block:
    """Points of a block: ids, vectors, codes and which of them are queries."""

    def __init__(self, data: dict[str, np.ndarray]):
        self.ids, self.vectors, self.asked = data["ids"], data["vectors"], data["asked"]
        self.centre, self.codes, self.length, self.aligned = data["centre"], data["codes"], data["length"], data["aligned"]
        self.dim = self.vectors.shape[1]

    @functools.cached_property
    def signs(self) -> np.ndarray:
        """Opened codes, scaled to unit length."""
        return (np.unpackbits(self.codes, axis=1, count=self.dim).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(self.dim))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """What the inner product of each query with each point will hardly exceed."""
        long = np.sqrt((queries * queries).sum(axis=1))[:, None]
        met = (queries @ rotation(self.dim).T).astype(np.float32) @ self.signs.T
        base = (queries @ self.centre)[:, None]
        off = np.sqrt(np.maximum(0.0, 1.0 - self.aligned ** 2))
        if self.dim < FEW:
            return base + self.length * (met * self.aligned + off * np.sqrt(np.maximum(0.0, long ** 2 - met.astype(np.float64) ** 2)))
        return base + self.length * (met / self.aligned + long * (EPSILON * off / self.aligned / math.sqrt(self.dim - 1)))

    def reach(self, queries: np.ndarray) -> np.ndarray:
        """What no inner product with a point of this block exceeds."""
        return queries @ self.centre + np.sqrt((queries * queries).sum(axis=1)) * self.length.max()


@functools.lru_cache(maxsize=3)
def load_block(path: str) -> Block:
    with np.load(io.BytesIO(read_whole(path))) as data:
        return Block({k: data[k] for k in data.files})


def exact(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", queries, vectors)


class Best:
    """The best points found so far of each query: ids and scores, best first, ties to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    @property
    def least(self) -> np.ndarray:
        return self.scores[:, -1]

    def take(self, row: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merge new points of the queries `row` (ascending)."""
        if not len(row):
            return
        some = np.unique(row)
        where = np.concatenate([np.repeat(some, self.k), row])
        ids, scores = np.concatenate([self.ids[some].reshape(-1), ids]), np.concatenate([self.scores[some].reshape(-1), scores])
        order = np.lexsort((ids, -scores, where))
        where, ids, scores = where[order], ids[order], scores[order]
        first = np.searchsorted(where, some)
        at = (first[:, None] + np.arange(self.k)).reshape(-1)
        self.ids[some], self.scores[some] = ids[at].reshape(-1, self.k), scores[at].reshape(-1, self.k)


def search_block(block: Block, queries: np.ndarray, best: Best) -> None:
    """Estimate all, then compare exactly what may still be wanted: first the most promising, then what their scores leave."""
    able = np.flatnonzero(~(block.reach(queries) < best.least))
    for begin in range(0, len(able), SLICE):
        some = able[begin:begin + SLICE]
        bounds = block.bounds(queries[some])
        wanted = ~(bounds < best.least[some][:, None])
        if block.ids.size > 4 * best.k:
            top = np.argpartition(-bounds, 2 * best.k, axis=1)[:, :2 * best.k]
            early = np.zeros(wanted.shape, bool)
            np.put_along_axis(early, top, True, axis=1)
            early &= wanted
            compare(block, queries, some, early, best)
            wanted &= ~early & ~(bounds < best.least[some][:, None])
        compare(block, queries, some, wanted, best)


def compare(block: Block, queries: np.ndarray, some: np.ndarray, chosen: np.ndarray, best: Best) -> None:
    row, at = np.nonzero(chosen)
    for begin in range(0, len(row), 200_000):
        r, a = row[begin:begin + 200_000], at[begin:begin + 200_000]
        scores = exact(queries[some[r]], block.vectors[a])
        good = scores >= best.least[some[r]]
        best.take(some[r[good]], block.ids[a[good]], scores[good])


# ---- jobs ----------------------------------------------------------------------------------------------------------

def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def points_of(rows: DataFrame, keep: int) -> DataFrame:
    """One point for equal vectors: id, its `keep` smallest ids in order, vector, and whether any of its rows asks."""
    order = Window.partitionBy("vector").orderBy("vec_id")
    first = rows.withColumn("place", F.dense_rank().over(order)).filter(F.col("place") <= keep).groupBy("vector").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    asked = rows.filter(F.col("vec_id") % QUERY_EACH == 0).select("vector").distinct().withColumn("asked", F.lit(True))
    return first.join(asked, "vector", "left").select(F.col("ids")[0].alias("id"), "ids", "vector", F.coalesce("asked", F.lit(False)).alias("asked"))


def centres_of(points: DataFrame, n: int) -> np.ndarray:
    """Means of a bounded sample's nearest vectors."""
    rows = points.select("vector").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow().column(0)
    sample = np.array(rows.to_pylist(), np.float64)
    centres = sample[: max(1, min(CENTRES, len(sample), -(-n // BLOCK)))]
    for _ in range(ROUNDS):
        near = nearest(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        counts = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(counts > 0, sums / np.maximum(1, counts), centres)
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2.0 * (rows @ centres.T)).argmin(axis=1)


def write_blocks(points: DataFrame, n: int, folder: str) -> DataFrame:
    """Index every point; returns the stored list of blocks."""
    centres = centres_of(points, n)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            cell = nearest(rows, centres) if len(rows) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=["id", "vector", "asked", "cell"])

    placed = materialize(points.select("id", "vector", "asked").mapInArrow(place, "id long, vector array<double>, asked boolean, cell int"), "placed")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    parted = placed.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")

    def build(key: tuple, group: pa.Table) -> pa.Table:
        cell, part = key[0].as_py(), key[1].as_py()
        group = group.sort_by("id")
        rows = group["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(group.num_rows, -1)
        asked = group["asked"].to_numpy()
        out, path = io.BytesIO(), f"{folder}/block-{cell:04d}-{part:06d}.npz"
        np.savez(out, ids=group["id"].to_numpy(), vectors=rows, asked=np.flatnonzero(asked), **encode(rows))
        write_whole(path, [out.getvalue()])
        return pa.table({"block": [cell * 10_000_000 + part], "path": [path], "points": [group.num_rows], "queries": [int(asked.sum())]})

    return materialize(parted.groupBy("cell", "part").applyInArrow(build, MANIFEST), "blocks")


def rows_of(block: Block, best: Best) -> pa.RecordBatch:
    row, at = np.nonzero(best.scores > -np.inf)
    asking = block.ids[block.asked][row]
    return pa.RecordBatch.from_arrays([pa.array(asking), pa.array(best.ids[row, at]), pa.array(best.scores[row, at])], names=["query", "id", "score"])


def search_blocks(blocks: DataFrame, k: int) -> DataFrame:
    """The best points of every query in its own block and in every run of other blocks."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                block = load_block(path)
                best = Best(len(block.asked), k)
                search_block(block, block.vectors[block.asked], best)
                write_whole(f"{path}.least", [best.least.astype("<f8").tobytes()])
                yield rows_of(block, best)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, run in zip(batch.column("path").to_pylist(), batch.column("run").to_pylist(), strict=True):
                block = load_block(path)
                queries, best = block.vectors[block.asked], Best(len(block.asked), k)
                # what the own block gave holds the place of the last wanted one, under no id
                best.scores[:, -1] = np.frombuffer(read_whole(f"{path}.least"), "<f8")
                held = best.scores[:, -1:].copy()
                best.scores[:] = held
                for other in run:
                    if other != path:
                        search_block(load_block(other), queries, best)
                best.scores[best.ids == np.iinfo(np.int64).max] = -np.inf
                yield rows_of(block, best)

    asking = materialize(blocks.filter("queries > 0").select("path"), "asking")
    n = max(1, asking.count())
    first = materialize(asking.repartition(n).mapInArrow(own, FOUND), "own")
    runs = blocks.withColumn("run", F.pmod(F.xxhash64("block"), F.lit(max(1, -(-blocks.count() // BLOCKS_A_TASK))))).groupBy("run").agg(F.sort_array(F.collect_list("path")).alias("run_paths"))
    # the stated queries meet all blocks, a block of queries and a run of blocks at a time
    tasks = materialize(asking.withColumn("all", F.lit(1)).join(runs.withColumn("all", F.lit(1)), "all").select("path", F.col("run_paths").alias("run")), "tasks")
    met = tasks.repartition(max(1, tasks.count()), "path", "run").mapInArrow(others, FOUND)
    return first.union(materialize(met, "others"))


def nearest_neighbours(vectors: DataFrame, k: int = NEIGHBOURS, folder: str | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the `k` nearest found of every query."""
    folder = folder or fresh_path(vectors.sparkSession, "one-bit")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.filter(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    points = materialize(points_of(rows, k + 1), "points")
    found = None
    for length, n in [tuple(r) for r in points.groupBy(F.size("vector")).count().collect()]:
        more = search_blocks(write_blocks(points.filter(F.size("vector") == length), n, f"{folder}/{length}"), k + 1)
        found = more if found is None else found.union(more)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], FOUND)
    by_query = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    best = materialize(found.withColumn("place", F.row_number().over(by_query)).filter(F.col("place") <= k + 1).drop("place"), "best")
    each = best.join(points.select("id", "ids"), "id").select("query", "score", F.explode("ids").alias("vec_id"))
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    each = materialize(each.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= k + 1).drop("place"), "each")
    asking = rows.filter(F.col("vec_id") % QUERY_EACH == 0).distinct().join(points.select("vector", F.col("id").alias("query")), "vector").select(F.col("vec_id").alias("query_id"), "query")
    own = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    met = asking.join(each, "query").filter("vec_id <> query_id").withColumn("rank", F.row_number().over(own))
    return met.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
