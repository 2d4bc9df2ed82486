"""Exact pairs of near-duplicate vectors by dual traversal of cover trees.

Vectors are compared as points of the unit sphere, where a cosine is a distance. A few pivots, spread over the whole
table, are the top of the tree; each vector falls to its nearest pivot, and what falls to a pivot is cut into blocks of
bounded size. A block's tree has nested levels with halving radii: each node's centre is one of its points, its
children lie within half its radius, and it knows its true covering radius. Trees are stored as files in the shared
folder. Pairs of blocks, then pairs of nodes level by level, are dropped where the distance of their centres less both
covering radii is above the threshold, and linked as a whole where it is below with both added; what is left at the
lowest level is compared point by point in double precision.

Equal vectors are one point with a weight. Each pair of blocks returns counts for its points and a spanning forest of
its links, never its pairs.

Defined results: a vector that is NULL, zero or has NULL or non-finite components links with nothing; vectors of
different lengths don't link; repeated rows are vectors of their own; a row without vec_id links with nothing and is
not kept; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dialoglens.llm.files import read_whole, write_whole
from dialoglens.llm.graph import components
from dialoglens.session import fresh_path, materialize

COSINE = 0.95
BLOCK = 4096
PIVOTS = 1024
SAMPLE = 8192
LEVELS = (1.0, 0.5, 0.25, 0.125, 0.0625)
#: Bounds are widened by this much against rounding.
SLACK = 1e-7
#: The same for outlines, which are in single precision.
ROUGH = 1e-3
RUN = 200_000
THIN = 0.05
#: Rows of a matrix product, whose result stays in a core's cache; nodes by which a level is judged; pairs of a product
#: that cost about as much as one opened pair of nodes.
ROWS, TRIED, OPENING = 256, 64, 64
#: Blocks on each side of a task's square of block pairs, and the bytes of points that a task keeps of one side.
SIDE, SIDE_BYTES = 8, 32 << 20

MANIFEST_SCHEMA = "block long, cell int, path string, points long"
FOUND_SCHEMA = "id long, links long, other long"


# ---- one tree ------------------------------------------------------------------------------------------------------

def unit(rows: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that squares neither vanish nor overflow."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


def build_tree(points: np.ndarray) -> list[np.ndarray]:
    """For each level the node of each point; nodes have the number of their centre, and each centre is its own node."""
    node, out = np.zeros(len(points), np.int64), []
    for radius in LEVELS:
        new = np.full(len(points), -1, np.int64)
        least = 1.0 - radius * radius / 2.0
        order = np.argsort(node, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
            rest = group
            while len(rest):
                near = points[rest] @ points[rest[0]] >= least
                near[0] = True
                new[rest[near]] = rest[0]
                rest = rest[~near]
        node = new
        out.append(node)
    return out


class Tree:
    """Points of a block with their ids, weights and levels; `radius` is each centre's true covering radius."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, points: np.ndarray, levels: np.ndarray):
        self.ids, self.weights, self.points, self.levels = ids, weights, points, levels
        self.radius = []
        for node in levels:
            away = chord((points * points[node]).sum(axis=1))
            most = np.zeros(len(ids))
            np.maximum.at(most, node, away)
            self.radius.append(most)

    @functools.cached_property
    def outlines(self) -> np.ndarray:
        """The first third of each point's components and the length of the rest, in single precision.

        Outlines are never farther apart than their points, so what their distance prunes is pruned rightly.
        """
        k = max(1, self.points.shape[1] // 3)
        rest = np.sqrt((self.points[:, k:] ** 2).sum(axis=1, keepdims=True))
        return np.hstack([self.points[:, :k], rest]).astype(np.float32)

    @functools.cached_property
    def centres(self) -> list[np.ndarray]:
        return [np.unique(node) for node in self.levels]

    @functools.cached_property
    def below(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each level: what its nodes hold one level lower, as places in a list by node number."""
        out = []
        for k, node in enumerate(self.levels):
            lower = self.centres[k + 1] if k + 1 < len(self.levels) else np.arange(len(self.ids))
            order = lower[np.argsort(node[lower], kind="stable")]
            counts = np.bincount(node[order], minlength=len(self.ids))
            out.append((order, np.cumsum(counts) - counts, counts))
        return out

    @functools.cached_property
    def sums(self) -> list[np.ndarray]:
        """For each level the weight of each node."""
        return [np.bincount(node, weights=self.weights, minlength=len(self.ids)).astype(np.int64) for node in self.levels]

    def members(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Points of the nodes one level lower than `level`, and for each the place of its node in `nodes`."""
        order, begins, counts = self.below[level]
        n = counts[nodes]
        at = np.repeat(np.arange(len(nodes)), n)
        return order[np.repeat(begins[nodes] - (np.cumsum(n) - n), n) + np.arange(n.sum())], at

    def packed(self) -> list[bytes]:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, weights=self.weights, points=self.points, levels=self.levels)
        return [out.getvalue()]


def load_tree(path: str) -> Tree:
    with np.load(io.BytesIO(read_whole(path))) as data:
        return Tree(data["ids"], data["weights"], data["points"], data["levels"])


# ---- two trees -----------------------------------------------------------------------------------------------------

class Links:
    """Link counts of the points of one or two blocks, and a forest that connects what is linked."""

    def __init__(self, left: Tree, right: Tree | None):
        self.ids = left.ids if right is None else np.concatenate([left.ids, right.ids])
        self.shift = 0 if right is None else len(left.ids)
        self.counts = np.zeros(len(self.ids), np.int64)
        self.parent = np.arange(len(self.ids))

    def roots(self, x: np.ndarray) -> np.ndarray:
        at = self.parent[x]
        while (at != self.parent[at]).any():
            at = self.parent[at]
        return at

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Connect each a with its b; only pairs that aren't connected yet cost a step."""
        while True:
            x, y = self.roots(a), self.roots(b)
            apart = x != y
            if not apart.any():
                self.parent = self.roots(np.arange(len(self.parent)))
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids with links, their counts, and an id that each is connected with."""
        some = np.flatnonzero(self.counts)
        return self.ids[some], self.counts[some], self.ids[self.roots(some)]


def runs(counts: np.ndarray, most: int) -> Iterator[slice]:
    """Slices whose counts add up to about `most`, or of one entry."""
    sums, begin = np.cumsum(counts), 0
    while begin < len(counts):
        done = sums[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sums, done + most, side="right")))
        yield slice(begin, end)
        begin = end


def cosines(left: Tree, other: Tree, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", left.points[u], other.points[v])


class Traversal:
    """Dual traversal of two trees, or of one with itself. Memory is bounded: pairs go down in runs of about `RUN`."""

    def __init__(self, left: Tree, right: Tree | None, cosine: float = COSINE):
        self.left, self.other, self.same, self.cosine = left, left if right is None else right, right is None, cosine
        self.limit = float(chord(np.array(cosine)))
        self.links = Links(left, right)
        level = self.top()
        for a, b in self.tops(level):
            self.descend(level, a, b, cosines(left, self.other, a, b))

    def in_reach(self, level: int, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Which nodes of two lists are in reach, by all components."""
        reach = self.limit + SLACK + self.left.radius[level][rows][:, None] + self.other.radius[level][columns]
        return chord(self.left.points[rows] @ self.other.points[columns].T) <= reach

    def top(self) -> int:
        """The highest level whose wide nodes leave few pairs in reach, judged by some of them.

        In many dimensions the widest nodes reach nearly all others: to open their pairs one by one costs more than to
        begin with the level below. The level decides the work alone.
        """
        for level in range(len(LEVELS) - 1):
            rows, columns = self.left.centres[level], self.other.centres[level]
            wide, across = (n[tree.radius[level][n] > THIN] for n, tree in ((rows, self.left), (columns, self.other)))
            some, others = (n[:: -(-len(n) // TRIED)] if len(n) else n for n in (wide, across))
            met = self.in_reach(level, some, columns).mean() * len(wide) * len(columns) if len(wide) else 0.0
            met += self.in_reach(level, rows[:: -(-len(rows) // TRIED)], others).mean() * len(rows) * len(across) if len(across) else 0.0
            if met * OPENING <= len(rows) * len(columns):
                return level
        return len(LEVELS) - 1

    def tops(self, level: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a level's nodes in reach: thin ones by their outlines, those with a wide node by all components."""
        rows, columns = (
            nodes[np.argsort(tree.radius[level][nodes], kind="stable")]
            for tree in (self.left, self.other) for nodes in [tree.centres[level]]
        )
        r, c = self.left.radius[level][rows], self.other.radius[level][columns]
        thin, across = (int(np.searchsorted(radii, THIN, side="right")) for radii in (r, c))
        outlines = np.ascontiguousarray(self.other.outlines[columns[:across]].T)
        for begin, stop, some, narrow in (
            (0, thin, columns[:across], True), (0, thin, columns[across:], False), (thin, len(rows), columns, False)
        ):
            for begin in range(begin, stop if len(some) else 0, ROWS):
                x = rows[begin:min(begin + ROWS, stop)]
                met = None
                if narrow:
                    # radii ascend: that of the last row bounds them all
                    reach = self.limit + ROUGH + self.left.radius[level][x[-1]] + c[:across]
                    met = self.left.outlines[x] @ outlines >= (1.0 - reach * reach / 2.0).astype(np.float32)
                if met is None or np.count_nonzero(met) * OPENING > met.size:
                    met = self.in_reach(level, x, some)
                at = np.flatnonzero(met)
                u, v = x[at // len(some)], some[at % len(some)]
                if self.same:
                    u, v = u[u <= v], v[u <= v]
                for part in runs(np.ones(len(u), np.int64), RUN):
                    yield u[part], v[part]

    def descend(self, level: int, a: np.ndarray, b: np.ndarray, near: np.ndarray) -> None:
        """Prune node pairs, link whole ones, and open the others."""
        away, r = chord(near), self.left.radius[level][a] + self.other.radius[level][b]
        whole = away + r + SLACK <= self.limit
        self.link_whole(level, a[whole], b[whole])
        open_ = (away - r - SLACK <= self.limit) & ~whole
        a, b = a[open_], b[open_]
        for part in runs(self.left.below[level][2][a], RUN):
            u, at = self.left.members(level, a[part])
            nodes, twice = b[part][at], (a[part] == b[part])[at] & self.same
            for inner in runs(self.other.below[level][2][nodes], RUN):
                v, where = self.other.members(level, nodes[inner])
                self.lower(level + 1, u[inner][where], v, twice[inner][where])

    def lower(self, level: int, u: np.ndarray, v: np.ndarray, twice: np.ndarray) -> None:
        """Go on with what node pairs hold; a node beside itself holds each pair twice."""
        points = level == len(LEVELS)
        keep = ~twice | ((u < v) if points else (u <= v))
        u, v = u[keep], v[keep]
        near = cosines(self.left, self.other, u, v)
        if not points:
            if len(u):
                self.descend(level, u, v, near)
            return
        u, v = u[near >= self.cosine], v[near >= self.cosine]
        np.add.at(self.links.counts, u, self.other.weights[v])
        np.add.at(self.links.counts, v + self.links.shift, self.left.weights[u])
        self.links.join(u, v + self.links.shift)

    def link_whole(self, level: int, a: np.ndarray, b: np.ndarray) -> None:
        """Link all points of node pairs without comparing them."""
        if not len(a):
            return
        left, other, links = self.left, self.other, self.links
        gain_left, gain_right = np.zeros(len(left.ids), np.int64), np.zeros(len(other.ids), np.int64)
        np.add.at(gain_left, a, other.sums[level][b])
        once = (a != b) if self.same else np.ones(len(a), bool)
        np.add.at(gain_right, b[once], left.sums[level][a[once]])
        if self.same:
            own = np.zeros(len(left.ids), bool)
            own[a[~once]] = True
            links.counts += (gain_left + gain_right)[left.levels[level]] - np.where(own[left.levels[level]], left.weights, 0)
        else:
            links.counts[: links.shift] += gain_left[left.levels[level]]
            links.counts[links.shift:] += gain_right[other.levels[level]]
        links.join(a, b + links.shift)
        for tree, nodes, shift in ((left, a, 0), (other, b, links.shift)):
            marks = np.zeros(len(tree.ids), bool)
            marks[nodes] = True
            points = np.flatnonzero(marks[tree.levels[level]])
            links.join(points + shift, tree.levels[level][points] + shift)


def traverse(left: Tree, right: Tree | None, cosine: float = COSINE) -> Links:
    """All links between two trees, or inside one."""
    return Traversal(left, right, cosine).links


# ---- jobs ----------------------------------------------------------------------------------------------------------

def valid(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def pivots_of(points: DataFrame, n: int) -> np.ndarray:
    """Pivots spread over a bounded sample of the vectors: each next one is the farthest from those before."""
    rows = points.select("vector").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow().column(0)
    sample = unit(np.array(rows.to_pylist()))
    chosen, near = [0], sample @ sample[0]
    while len(chosen) < min(len(sample), max(1, min(PIVOTS, -(-n // BLOCK)))):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, sample @ sample[chosen[-1]])
    return sample[chosen]


def with_cells(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the nearest pivot and the distance to it."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            if not len(rows):
                continue
            near = unit(rows) @ pivots.T
            cell = near.argmax(axis=1)
            away = chord(near[np.arange(len(cell)), cell])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(away)], names=["id", "weight", "vector", "cell", "away"])

    schema = "id long, weight long, vector array<double>, cell int, away double"
    return points.select("id", "weight", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(place, schema)


def write_trees(placed: DataFrame, sizes: dict[int, int], folder: str) -> DataFrame:
    """Build and store the tree of each block; returns their stored list. Blocks are numbered by cells."""
    spark = placed.sparkSession
    counts = {c: -(-n // BLOCK) for c, n in sorted(sizes.items())}
    firsts = np.cumsum([0, *counts.values()]).tolist()
    parts = spark.createDataFrame([(c, n, first) for (c, n), first in zip(counts.items(), firsts)], "cell int, parts int, first long")
    blocks = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        cell, part = int(group["cell"].iloc[0]), int(group["part"].iloc[0])
        group = group.sort_values("id")
        points = unit(np.stack(group["vector"].tolist()))
        tree = Tree(group["id"].to_numpy(), group["weight"].to_numpy(), points, np.array(build_tree(points)))
        path = f"{folder}/tree-{cell:06d}-{part:06d}.npz"
        write_whole(path, tree.packed())
        return pd.DataFrame({"block": [int(group["first"].iloc[0]) + part], "cell": [cell], "path": [path], "points": [len(group)]})

    return materialize(blocks.groupBy("cell", "part").applyInPandas(build, MANIFEST_SCHEMA), "trees")


def cell_pairs(pivots: np.ndarray, radius: dict[int, float], cosine: float) -> list[tuple[int, int]]:
    """Pairs of cells that may hold links. There are at most PIVOTS cells."""
    limit = float(chord(np.array(cosine)))
    away = chord(pivots @ pivots.T)
    return [(x, y) for x in radius for y in radius if x <= y and away[x, y] <= limit + radius[x] + radius[y] + SLACK]


def found_links(trees: DataFrame, pairs: list[tuple[int, int]], cosine: float, length: int) -> DataFrame:
    """id, links and a connected id, from all pairs of blocks of the cell pairs.

    A task gets a square of block pairs, so that it loads a tree once for a row of the square. The square shrinks with
    the number of blocks, for there to be tasks enough, and with the length of the vectors, whose trees a task keeps.
    """
    spark = trees.sparkSession
    side = max(1, min(SIDE, trees.count() // SIDE, SIDE_BYTES // (BLOCK * length * 8)))
    allowed = F.broadcast(spark.createDataFrame(pairs, "cell int, other_cell int"))
    right = trees.select(F.col("block").alias("other"), F.col("cell").alias("other_cell"), F.col("path").alias("other_path"))
    met = trees.select("block", "cell", "path").join(allowed, "cell").join(right, "other_cell").filter("cell < other_cell OR block <= other")
    square = F.struct(F.floor(F.col("block") / side).alias("row"), F.floor(F.col("other") / side).alias("column"))
    tasks = materialize(met.select("block", "path", "other", "other_path", square.alias("square")), "block-pairs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = functools.lru_cache(maxsize=side + 1)(load_tree)
        for batch in batches:
            for path, other in zip(batch.column("path").to_pylist(), batch.column("other_path").to_pylist(), strict=True):
                links = traverse(tree(path), None if path == other else tree(other), cosine)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in links.rows()], names=["id", "links", "other"])

    n = max(1, tasks.select("square").distinct().count())
    placed = tasks.repartitionByRange(n, "square").sortWithinPartitions("square", "block", "other")
    return placed.select("path", "other_path").mapInArrow(run, FOUND_SCHEMA)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, folder: str | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    folder = folder or fresh_path(vectors.sparkSession, "cover-trees")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    usable = valid(F.col("vector")) & F.col("vec_id").isNotNull()
    points = materialize(rows.filter(usable).groupBy("vector").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")), "points")
    found = None
    for length, n in [tuple(r) for r in points.groupBy(F.size("vector")).count().collect()]:
        own = points.filter(F.size("vector") == length)
        pivots = pivots_of(own, n)
        placed = materialize(with_cells(own, pivots), "cells")
        cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()
        trees = write_trees(placed, {c.cell: c.n for c in cells}, f"{folder}/{length}")
        links = found_links(trees, cell_pairs(pivots, {c.cell: c.radius for c in cells}, cosine), cosine, length)
        found = links if found is None else found.union(links)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], FOUND_SCHEMA)
    found = materialize(found, "found")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("id").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "id")
    by_point = points.join(counts, "id", "left").join(groups, "id", "left").select(
        "vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    linked = rows.filter(usable).join(by_point, "vector").select("vec_id", "n_links", "component_id")
    rest = rows.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
