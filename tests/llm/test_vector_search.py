"""Hard negatives and nearest neighbours beside brute force, and on odd rows."""

import collections

import numpy as np
import pytest

from conftest import SF_DIR
from dialoglens.llm import gnat, onebit

SCHEMA = "vec_id long, embedding array<float>, label int, id long, ids array<long>, cell string, place int, score double"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, [2], "x", 3, 0.5) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def embeddings(spark):
    return spark.read.parquet(f"{SF_DIR}/embeddings.parquet")


def odd_rows(n, dim=8, seed=5):
    """Groups of near and equal vectors of several labels, ties, and rows that can't take part."""
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((12, dim))
    rows = []
    for k in range(n):
        vector = (centres[k % 12] + 0.2 * draw.standard_normal(dim)).round(1)
        rows.append((k, [float(x) for x in vector], int(draw.integers(0, 4))))
    same = rows[1][1]
    rows += [(n + k, same, k % 3) for k in range(60)]
    rows += [(10_000, None, 1), (10_100, [], 1), (10_200, [0.0] * dim, 1), (10_300, [float("nan")] * dim, 2), (10_400, [None] + [1.0] * (dim - 1), 2)]
    rows += [(10_500, [1.0, 2.0], 1), (10_600, [1.0, 1.0], 1), (10_700, [0.9, 1.9], 2), (10_800, same, None), (None, same, 1), (0, *rows[0][1:])]
    return rows


# ---- hard negatives ------------------------------------------------------------------------------------------------

def negatives(rows):
    known = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or not vector or any(x is None or not np.isfinite(x) for x in vector):
            continue
        whole = [int(np.floor(256 * float(np.float32(x)))) for x in vector]
        known[vec_id] = (whole, (label + 1) % 10 if vec_id % 7 == 0 else label)
    out = []
    for a, (vector, label) in known.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(vector, v, strict=True)), i, theirs) for i, (v, theirs) in known.items() if len(v) == len(vector) and i != a)
        for score, i, _ in [s for s in scored if s[2] == label][:5]:
            fitting = [(s, j) for s, j, theirs in scored if theirs != label and 80 * -score <= 100 * -s <= 100 * -score]
            out += [(a, i, k, j, -score, -s) for k, (s, j) in enumerate(fitting[:5], 1)]
    return sorted(out)


@pytest.mark.parametrize("leaf", [gnat.LEAF, 40])
def test_negatives_of_embeddings(embeddings, leaf):
    rows = [(r.vec_id, r.embedding, r.label) for r in embeddings.collect()]
    assert sorted(tuple(r) for r in gnat.hard_negatives(embeddings, leaf).collect()) == negatives(rows)


def test_negatives_of_odd_rows(spark):
    rows = odd_rows(700)
    found = sorted(tuple(r) for r in gnat.hard_negatives(frame(spark, rows), 20).collect())
    assert found == negatives(rows) and len(found) > 100
    assert gnat.hard_negatives(frame(spark, rows).limit(0)).count() == 0


def test_one_vector_with_many_labels_is_split(spark):
    rows = [(k, [0.5, 0.25], k) for k in range(300)] + [(300 + k, [0.5, 0.25], 100) for k in range(20)]
    assert sorted(tuple(r) for r in gnat.hard_negatives(frame(spark, rows), 10).collect()) == negatives(rows)


def test_nodes_leave_out_no_window():
    """Children that a node leaves out hold no score of the window, for any window and length of vectors."""
    draw = np.random.default_rng(3)
    points = (draw.standard_normal((400, 6)) * draw.choice([10, 300, 2000], (400, 1))).astype(np.int64)
    splits = gnat.split_points(points[:64])
    away = gnat.squared(points, splits)
    child = away.argmin(axis=1)
    some = np.unique(child)
    lengths = (points * points).sum(axis=1)
    import pyarrow as pa

    node = pa.table({
        "children": [some.tolist()], "splits": [splits.reshape(-1).tolist()],
        "low": [[int(x) for c in some for x in away[child == c].min(axis=0)]], "high": [[int(x) for c in some for x in away[child == c].max(axis=0)]],
        "shortest": [[int(lengths[child == c].min()) for c in some]], "longest": [[int(lengths[child == c].max()) for c in some]],
    })
    left_out = 0
    for _ in range(200):
        ask = points[draw.integers(0, 400)]
        scores = points @ ask
        least, most = sorted(int(x) for x in draw.choice(scores, 2))
        asks = pa.table({"place": [1], "cell": ["a"], "vector": [ask.tolist()], "least": [least], "most": [most]})
        kept = set(gnat.descend(asks, node)["child"].to_pylist())
        assert set(child[(scores >= least) & (scores <= most)].tolist()) <= kept
        left_out += len(some) - len(kept)
    assert left_out > 100


# ---- nearest neighbours --------------------------------------------------------------------------------------------

def neighbours(rows, k=20):
    known = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, vector in known.items():
        if q % 20 == 0:
            out[q] = sorted((-float(vector @ v), i) for i, v in known.items() if i != q and len(v) == len(vector))[:k]
    return out


def held_against(found, wanted):
    """Share of the wanted neighbours found; order, ranks and scores have to be right in any case."""
    by_query = collections.defaultdict(list)
    for q, rank, i, score in sorted(found):
        by_query[q].append((rank, i, score))
    hit = total = 0
    for q, best in wanted.items():
        told = by_query.pop(q, [])
        assert [r for r, *_ in told] == list(range(1, len(best) + 1))
        assert [i for _, i, _ in told] == [i for *_, i in sorted((-s, i) for _, i, s in told)] and q not in [i for _, i, _ in told]
        least = -best[-1][0] if best else 0
        hit += sum(score >= least - 1e-12 for *_, score in told)
        total += len(best)
    assert not by_query
    return hit / total


def test_neighbours_of_embeddings(embeddings):
    rows = [(r.vec_id, r.embedding, r.label) for r in embeddings.collect()]
    assert held_against([tuple(r) for r in onebit.nearest_neighbours(embeddings).collect()], neighbours(rows)) >= 0.98


def test_neighbours_of_odd_rows(spark):
    rows = odd_rows(700, 24)
    found = [tuple(r) for r in onebit.nearest_neighbours(frame(spark, rows)).collect()]
    assert held_against(found, neighbours(rows)) >= 0.98
    few = [(0, [1.0, 2.0, 3.0], 1), (20, [1.0, 2.0, 3.0], 1), (5, [3.0, 2.0, 1.0], 1)]
    assert sorted(tuple(r) for r in onebit.nearest_neighbours(frame(spark, few)).collect()) == [(0, 1, 20, 14.0), (0, 2, 5, 10.0), (20, 1, 0, 14.0), (20, 2, 5, 10.0)]
    assert onebit.nearest_neighbours(frame(spark, rows).limit(0)).count() == 0


def test_blocks_search_one_another():
    """Several blocks beside brute force, and what the bound lets through."""
    draw = np.random.default_rng(8)
    rows = draw.standard_normal((3000, 48))
    blocks = [onebit.Block({"ids": np.arange(b, 3000, 3), "vectors": rows[b::3], "asked": np.arange(40), **onebit.encode(rows[b::3])}) for b in range(3)]
    queries = blocks[0].vectors[blocks[0].asked]
    best = onebit.Best(len(queries), 20)
    for block in blocks:
        onebit.search_block(block, queries, best)
    scores = queries @ rows.T
    wanted = -np.sort(-scores, axis=1)[:, :20]
    assert (best.scores >= wanted[:, -1:] - 1e-9).mean() >= 0.98
    above = np.concatenate([(queries @ b.vectors.T <= b.bounds(queries)).reshape(-1) for b in blocks])
    assert 0.98 <= above.mean() < 1.0
    assert all((queries @ b.vectors.T <= b.reach(queries)[:, None] + 1e-9).all() for b in blocks)
