"""Hard negatives by exact window searches in a multiway hyperplane tree of GNAT kind.

Each node of the tree has up to `DEGREE` split points, far from each other in a bounded sample of the node's vectors;
every vector falls to its nearest one. For each child the node stores the least and greatest distance from every split
point to what the child holds, and the child's range of squared norms. A window of inner products with an anchor is,
for given norms, an annulus of distances around it: a child is left out where, for some split point, the child's range
and the annulus around the anchor don't meet. Leaves hold at most `LEAF` vectors, which are compared exactly.

The tree is built and walked level by level in Spark jobs: nodes are rows, anchors go to the children that they can't
leave out, and each leaf meets its anchors in groups of bounded size. A search begins with the anchor's own leaf and
about the square root of all leaves, chosen by hash; what is found there narrows the windows for the others.

Vectors are integers: scores, ties and windows are exact. Equal vectors of one label are one point with its smallest
ids, of which no more than `POSITIVES + 1` can come into any result.

Defined results: rows without vec_id, label or vector, with NULL or non-finite components, without components, or so long
that distances would not fit a long (squared length of 2**60) take no part; vectors of different lengths are never
compared; rows repeated with one vec_id, label and vector count once; an anchor without positives or a positive without negatives has
no rows; an empty table gives no rows.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from dialoglens.session import materialize

DEGREE, LEAF = 16, 1024
SAMPLE = 256
GROUP = 4096
SCALE = 256
POSITIVES, NEGATIVES = 5, 5
ANCHOR_EACH, MOVED_EACH, LABELS = 100, 7, 10
#: A negative's score is between this part of the positive's score and all of it.
LOW_PARTS, PARTS = 80, 100
#: Bounds of distances are widened by this much, relative to their size, against rounding.
SLACK = 1e-9
LONGEST, FAR = 1 << 60, 1 << 62

FOUND = "ask long, w long, score long, id long, ids array<bigint>"


# ---- points --------------------------------------------------------------------------------------------------------

def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & (F.size(vector) > 0), F.lit(False))


def scaled_rows(vectors: DataFrame) -> DataFrame:
    """vec_id, label and whole-numbered vector of the rows that take part; some labels are moved to the next one."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))
    length = F.aggregate("vector", F.lit(0.0), lambda a, x: a + F.pow(F.abs(x) * SCALE + 1, 2.0))
    moved = F.when(F.col("vec_id") % MOVED_EACH == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return rows.filter(length < LONGEST).select("vec_id", moved.alias("label"), F.transform("vector", lambda x: F.floor(x * SCALE)).alias("vector"))


def points_of(rows: DataFrame, keep: int) -> DataFrame:
    """One point for equal vectors of a label: id, label, vector, and its `keep` smallest ids in order."""
    order = Window.partitionBy("vector", "label").orderBy("vec_id")
    first = rows.withColumn("place", F.dense_rank().over(order)).filter(F.col("place") <= keep)
    grouped = first.groupBy("vector", "label").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    return grouped.select(F.col("ids")[0].alias("id"), "label", "ids", "vector")


# ---- numpy on groups -----------------------------------------------------------------------------------------------

def matrix(column: pa.ChunkedArray, kind: type = np.int64) -> np.ndarray:
    """Rows of a list column, all of one length."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; in double precision where no partial sum can lose a bit."""
    longest = [float((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0)) for x in (left, right)]
    if math.sqrt(longest[0] * longest[1]) < 2.0 ** 52:
        return (left.astype(np.float64) @ right.T.astype(np.float64)).astype(np.int64)
    return left @ right.T


def squared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact squared distances."""
    return (left * left).sum(axis=1)[:, None] + (right * right).sum(axis=1) - 2 * products(left, right)


def lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.reshape(-1)))


def split_points(sample: np.ndarray) -> np.ndarray:
    """Up to DEGREE different vectors of the sample, each the farthest from those before it."""
    chosen, near = [0], squared(sample, sample[:1])[:, 0]
    while len(chosen) < DEGREE and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, squared(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def choose(key: tuple, sample: pa.Table) -> pa.Table:
    splits = split_points(matrix(sample["vector"]))
    return pa.table({"cell": [key[0].as_py()] * len(splits), "child": pa.array(range(len(splits)), pa.int32()), "split": lists(splits)})


def assign(points: pa.Table, splits: pa.Table) -> pa.Table:
    """The child of each point and its squared distance to every split point.

    Points that one split point alone can't part are dealt by their ids.
    """
    if not points.num_rows:
        return pa.table({"id": pa.array([], pa.int64()), "child": pa.array([], pa.int32()), "away": pa.array([], pa.list_(pa.int64()))})
    splits = splits.sort_by("child")
    away = squared(matrix(points["vector"]), matrix(splits["split"]))
    child = away.argmin(axis=1) if away.shape[1] > 1 else points["place"].to_numpy() % DEGREE
    return pa.table({"id": points["id"], "child": pa.array(child, pa.int32()), "away": lists(away)})


def descend(asks: pa.Table, nodes: pa.Table) -> pa.Table:
    """Children that the windows of each ask can't leave out; an ask at a leaf stays there."""
    if not asks.num_rows:
        return pa.table({"place": pa.array([], pa.int64()), "cell": pa.array([], pa.string()), "child": pa.array([], pa.int32())})
    if not nodes.num_rows:
        return pa.table({"place": asks["place"], "cell": asks["cell"], "child": pa.nulls(asks.num_rows, pa.int32())})
    vectors = matrix(asks["vector"])
    told = {c: np.array(nodes[c][0].as_py(), np.int64) for c in ("children", "splits", "low", "high", "shortest", "longest")}
    at = np.sqrt(squared(vectors, told["splits"].reshape(-1, vectors.shape[1])).astype(np.float64))
    low, high = (np.sqrt(told[c].astype(np.float64)).reshape(len(told["children"]), -1) for c in ("low", "high"))
    length = (vectors.astype(np.float64) ** 2).sum(axis=1)[:, None]
    most, least = (asks[c].to_numpy().astype(np.float64)[:, None] for c in ("most", "least"))
    outer = np.sqrt(np.maximum(0.0, length + told["longest"].astype(np.float64) - 2.0 * least))
    inner = np.sqrt(np.maximum(0.0, length + told["shortest"].astype(np.float64) - 2.0 * most))
    slack = SLACK * (outer + np.sqrt(length) + 1.0)
    kept = np.ones(outer.shape, bool)
    for i in range(at.shape[1]):
        away = at[:, i:i + 1]
        # the child's range around a split point and the annulus around the ask, `away` from it, have to meet
        kept &= (away - high[:, i] <= outer + slack) & (low[:, i] - away <= outer + slack) & (away + high[:, i] + slack >= inner)
    row, child = np.nonzero(kept)
    return pa.table({"place": asks["place"].to_numpy()[row], "cell": asks["cell"].take(pa.array(row)), "child": pa.array(told["children"][child], pa.int32())})


def best_in_windows(asks: pa.Table, points: pa.Table, same: bool, k: int) -> pa.Table:
    """For each window of each ask the `k` best points of the leaf, with the ask's label or with others."""
    empty = pa.table({"ask": pa.array([], pa.int64()), "w": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64()))})
    if not asks.num_rows or not points.num_rows:
        return empty
    points = points.sort_by("id")
    scores = products(matrix(asks["vector"]), matrix(points["vector"]))
    alike = asks["label"].to_numpy()[:, None] == points["label"].to_numpy()
    least, most = asks["least"].to_numpy()[:, None], asks["most"].to_numpy()[:, None]
    row, column = np.nonzero((alike if same else ~alike) & (scores >= least) & (scores <= most))
    found = scores[row, column]
    # best first in each ask; points come in ascending id
    order = np.lexsort((column, -found, row))
    row, column, found = row[order], column[order], found[order]
    windows = asks["windows"].combine_chunks()
    n = np.diff(windows.offsets.to_numpy())
    flat = windows.flatten()
    w, lo, hi = (flat.field(c).to_numpy() for c in ("w", "lo", "hi"))
    first = np.cumsum(n) - n
    out = []
    for j in range(int(n.max(initial=0))):
        some = n[row] > j
        at = first[row[some]] + j
        inside = (found[some] >= lo[at]) & (found[some] <= hi[at])
        picked = np.flatnonzero(some)[inside]
        new = np.concatenate([[True], np.diff(row[picked]) != 0]) if len(picked) else np.empty(0, bool)
        place = np.arange(len(picked)) - np.maximum.accumulate(np.where(new, np.arange(len(picked)), 0))
        out.append((picked[place < k], at[inside][place < k]))
    if not out:
        return empty
    picked, at = (np.concatenate(x) for x in zip(*out, strict=True))
    chosen = points.take(pa.array(column[picked]))
    return pa.table({"ask": asks["ask"].to_numpy()[row[picked]], "w": w[at], "score": found[picked], "id": chosen["id"], "ids": chosen["ids"]})


# ---- jobs ----------------------------------------------------------------------------------------------------------

@dataclasses.dataclass
class Tree:
    """Stored points with their leaf (`cell`), and the nodes of each level, one row each."""

    points: DataFrame
    levels: list[DataFrame]
    leaves: int


def meet(asks: DataFrame, rows: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """`run` on the asks and the rows of each cell. A cell with many asks is met by several groups, each with all its rows."""
    parts = asks.groupBy("cell").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    left = asks.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("place"), F.col("parts")).cast("int")).drop("parts")
    right = rows.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInArrow(run, schema)


def build_tree(points: DataFrame, leaf: int = LEAF) -> Tree:
    """Split cells until each has at most `leaf` points. The first cells hold vectors of one length each."""
    points = materialize(points, "points")
    placed = materialize(points.select("id", F.size("vector").cast("string").alias("cell")), "cells")
    levels = []
    while True:
        big = materialize(placed.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > leaf), "big")
        if big.isEmpty():
            break
        inside = materialize(placed.join(big, "cell").join(points.select("id", "vector"), "id"), "inside")
        by_hash = Window.partitionBy("cell").orderBy(F.xxhash64("id", F.lit(len(levels))), "id")
        sample = inside.withColumn("place", F.row_number().over(by_hash)).filter(F.col("place") <= SAMPLE)
        splits = materialize(sample.select("cell", "vector").groupBy("cell").applyInArrow(choose, "cell string, child int, split array<bigint>"), "splits")
        # here the points ask: groups of them meet the split points of their cell
        asking = inside.withColumn("place", F.shiftright(F.xxhash64("id", F.lit(len(levels))), 8).bitwiseAND(F.lit((1 << 40) - 1))).select("id", "cell", "vector", "place")
        moved = materialize(meet(asking, splits, assign, "id long, child int, away array<bigint>"), "moved")
        inside = inside.join(moved, "id")
        distances = [F.array(*[f(F.get(F.col("away"), F.lit(i))) for i in range(DEGREE)]) for f in (F.min, F.max)]
        length = F.aggregate("vector", F.lit(0).cast("long"), lambda a, x: a + x * x)
        ranges = inside.groupBy("cell", "child").agg(
            distances[0].alias("low"), distances[1].alias("high"), F.min(length).alias("shortest"), F.max(length).alias("longest"), F.max(F.size("away")).alias("n")
        )
        ranges = ranges.withColumns({c: F.slice(c, 1, F.col("n")) for c in ("low", "high")}).drop("n")
        nodes = ranges.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("child", "low", "high", "shortest", "longest"))).alias("c"))
        known = splits.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("child", "split"))).alias("s"))
        rows = nodes.join(known, "cell").select(
            "cell", F.flatten("s.split").alias("splits"), F.col("c.child").alias("children"), F.flatten("c.low").alias("low"), F.flatten("c.high").alias("high"),
            F.col("c.shortest").alias("shortest"), F.col("c.longest").alias("longest"),
        )
        levels.append(materialize(rows, "nodes"))
        kept = placed.join(big, "cell", "left_anti")
        placed = materialize(kept.unionByName(inside.select("id", F.concat_ws(".", "cell", "child").alias("cell"))), "cells")
    points = materialize(points.join(placed, "id"), "leaves")
    return Tree(points, levels, points.select("cell").distinct().count())


def walk(tree: Tree, asks: DataFrame) -> DataFrame:
    """ask and cell of every leaf that may hold what an ask's windows want."""
    bounds = asks.select("ask", "vector", F.array_min("windows.lo").alias("least"), F.array_max("windows.hi").alias("most"))
    bounds = materialize(bounds.filter("least IS NOT NULL"), "bounds")
    at = bounds.select("ask", F.size("vector").cast("string").alias("cell"))
    reached = None
    for level in tree.levels:
        facing = at.join(bounds, "ask").withColumn("place", F.col("ask"))
        stepped = materialize(meet(facing, level, descend, "place long, cell string, child int").withColumnRenamed("place", "ask"), "walk")
        done = stepped.filter("child IS NULL").select("ask", "cell")
        reached = done if reached is None else reached.union(done)
        at = stepped.filter("child IS NOT NULL").select("ask", F.concat_ws(".", "cell", "child").alias("cell"))
    return at if reached is None else reached.union(at)


def look(tree: Tree, asks: DataFrame, cells: DataFrame, same: bool, k: int) -> DataFrame:
    """What the asks find in the given leaves: FOUND rows."""
    wanted = asks.select("ask", "label", "vector", "windows", F.array_min("windows.lo").alias("least"), F.array_max("windows.hi").alias("most"), F.col("ask").alias("place"))
    facing = cells.join(wanted, "ask")
    run = lambda some, points: best_in_windows(some, points, same, k)
    return materialize(meet(materialize(facing, "facing"), tree.points, run, FOUND), "found")


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("ask", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def search(tree: Tree, asks: DataFrame, same: bool, k: int) -> DataFrame:
    """For each window of each ask its `k` best points in the whole tree (ASK rows give FOUND rows)."""
    share = int((1 << 20) / math.sqrt(max(1, tree.leaves)))
    early = F.pmod(F.xxhash64("cell"), F.lit(1 << 20)) < share
    some = [r.cell for r in tree.points.select("cell").distinct().filter(early).collect()]
    # first the own leaf and a few others of the same vector length
    near = F.filter(F.array(*map(F.lit, some)).cast("array<string>"), lambda c: F.split_part(c, F.lit("."), F.lit(1)) == F.split_part("own", F.lit("."), F.lit(1)))
    seeds = asks.select("ask", F.explode(F.array_union(F.array("own"), near)).alias("cell"))
    first = look(tree, asks, seeds, same, k)
    limits = best(first, k).filter(F.col("place") == k).groupBy("ask").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("limits"))
    narrowed = asks.join(limits, "ask", "left").withColumn(
        "windows", F.transform("windows", lambda x: F.struct(x["w"].alias("w"), F.greatest(x["lo"], F.coalesce(F.try_element_at("limits", x["w"]), x["lo"])).alias("lo"), x["hi"].alias("hi")))
    )
    narrowed = materialize(narrowed.drop("limits"), "narrowed")
    seen = F.array_contains(F.array(*map(F.lit, some)).cast("array<string>"), F.col("cell")) | (F.col("cell") == F.col("own"))
    rest = walk(tree, narrowed).join(narrowed.select("ask", "own"), "ask").filter(~seen).select("ask", "cell")
    return materialize(best(first.union(look(tree, narrowed, rest, same, k)), k).drop("place"), "best")


def each_id(found: DataFrame, k: int) -> DataFrame:
    """ask, w, score and vec_id of the `k` best rows behind the best points."""
    rows = found.select("ask", "w", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("ask", "w").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def hard_negatives(vectors: DataFrame, leaf: int = LEAF) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores, for all anchors and positives."""
    rows = materialize(scaled_rows(vectors), "rows")
    tree = build_tree(points_of(rows, POSITIVES + 1), leaf)
    anchors = rows.filter(F.col("vec_id") % ANCHOR_EACH == 0).join(tree.points.select("vector", "label", F.col("id").alias("ask"), F.col("cell").alias("own")), ["vector", "label"])
    anchors = materialize(anchors.select(F.col("vec_id").alias("anchor_id"), "ask", "own", "label", "vector").dropDuplicates(["anchor_id", "ask"]), "anchors")
    asking = anchors.dropDuplicates(["ask"]).select("ask", "own", "label", "vector")
    anyone = F.array(F.struct(F.lit(0).cast("long").alias("w"), F.lit(-FAR).alias("lo"), F.lit(FAR).alias("hi")))
    alike = search(tree, materialize(asking.withColumn("windows", anyone), "asks"), True, POSITIVES + 1)
    alike = each_id(alike, POSITIVES + 1).select("ask", F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id"))
    by_anchor = Window.partitionBy("anchor_id", "ask").orderBy(F.desc("positive_score"), "positive_id")
    positives = anchors.select("anchor_id", "ask").join(alike, "ask").filter("positive_id <> anchor_id")
    positives = materialize(positives.withColumn("place", F.row_number().over(by_anchor)).filter(F.col("place") <= POSITIVES).drop("place"), "positives")
    least = F.ceil(F.col("positive_score") * F.lit(LOW_PARTS).cast("decimal(20,0)") / PARTS).cast("long")
    windows = positives.select("ask", "positive_score").distinct().select("ask", F.struct(F.col("positive_score").alias("w"), least.alias("lo"), F.col("positive_score").alias("hi")).alias("window"))
    wanted = windows.filter("window.lo <= window.hi").groupBy("ask").agg(F.sort_array(F.collect_list("window")).alias("windows"))
    others = each_id(search(tree, materialize(asking.join(wanted, "ask"), "asks"), False, NEGATIVES), NEGATIVES)
    others = others.select("ask", F.col("w").alias("positive_score"), F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return positives.join(others, ["ask", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
