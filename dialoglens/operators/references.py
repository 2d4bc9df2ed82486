"""Vectors against reference vectors of any number.

References are stored once as a table of the shared folder. A task reads it block by block and multiplies its batches of
vectors with each block; the best few of each vector are kept from block to block, so that neither pairs nor scores
leave the task. No side is sent whole to the driver, broadcast or shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F, types as T

from dialoglens.operators.skew import number_rows
from dialoglens.session import fresh_path

BLOCK_ROWS, SLICE_ROWS = 4096, 1024
#: Scores that a slice of vectors holds at once.
SLICE_SCORES = 4_000_000
CLASSES = pa.list_(pa.struct([("confidence", pa.float64()), ("keyword_boost", pa.float64()), ("pos", pa.int64()), ("category_id", pa.string()), ("name", pa.string())]))
BEST = "confidence double, keyword_boost double, pos bigint, category_id string, name string"


def stored_references(references: DataFrame, order: str, names: tuple[str, ...] = ()) -> str:
    """Folder with pos (the place in `order`, from 0), the vector and the columns `names`."""
    path = fresh_path(references.sparkSession, "references")
    rows = number_rows(references, F.col(order), name="_place")
    rows.select((F.col("_place") - 1).alias("pos"), F.col("embedding").cast("array<double>").alias("embedding"), *names).write.parquet(path)
    return path


def blocks_of(path: str, rows: int = BLOCK_ROWS) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Places, vectors and rows of the stored references, a block at a time."""
    store, folder = fs.FileSystem.from_uri(path)
    for batch in ds.dataset(folder, filesystem=store, format="parquet").to_batches(batch_size=rows):
        if batch.num_rows:
            yield batch.column("pos").to_numpy(), matrix(batch.column("embedding")), batch


def matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(vectors), -1)


def present(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows that have a vector, and these vectors."""
    at = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
    return at, matrix(vectors.take(pa.array(at))) if len(at) else np.empty((0, 0))


def with_scores(vectors: DataFrame, path: str, n: int, vector: str) -> DataFrame:
    """Add `scores`: the product with each of the `n` references, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, SLICE_SCORES // n)
        for whole in batches:
            for begin in range(0, whole.num_rows, step):
                batch = whole.slice(begin, step)
                at, rows = present(batch.column(batch.schema.get_field_index(vector)))
                scores = np.empty((len(at), n))
                for place, block, _ in blocks_of(path) if len(at) else ():
                    scores[:, place] = rows @ block.T
                counts = np.zeros(batch.num_rows, np.int64)
                counts[at] = n
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32(), mask=np.append(counts == 0, False))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(scores.reshape(-1)))], names=[*batch.schema.names, "scores"])

    schema = T.StructType([*vectors.schema.fields, T.StructField("scores", T.ArrayType(T.DoubleType()))])
    return vectors.mapInArrow(run, schema)


def with_best(rows: DataFrame, path: str, k: int, threshold: float, vector: str, boosts: str) -> DataFrame:
    """Replace the column `boosts` (by name) by `classes`: the `k` best references at or above the threshold, ties in order."""
    kept = [c for c in rows.columns if c != boosts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(begin, SLICE_ROWS)
                column = {name: batch.column(batch.schema.get_field_index(name)) for name in batch.schema.names}
                out: list = [[] for _ in range(batch.num_rows)]
                at, found = present(column[vector])
                wanted = [{b["name"]: b["boost"] for b in column[boosts][int(r)].as_py() or ()} for r in at]
                for place, block, refs in blocks_of(path) if len(at) else ():
                    merge(out, at, found @ block.T, wanted, place, refs, k, threshold)
                yield pa.RecordBatch.from_arrays([*(column[c] for c in kept), pa.array(out, CLASSES)], names=[*kept, "classes"])

    return rows.mapInArrow(run, T.StructType([*rows.drop(boosts).schema.fields, T.StructField("classes", T.ArrayType(T.StructType.fromDDL(BEST)))]))


def merge(out: list, at: np.ndarray, scores: np.ndarray, wanted: list[dict], place: np.ndarray, refs: pa.RecordBatch, k: int, threshold: float) -> None:
    """Take over a block's references that are among the `k` best of a row so far."""
    boosted: dict[tuple[int, int], float] = {}
    if any(wanted):
        under: dict[str, list[int]] = {}
        for j, name in enumerate(refs.column("name").to_pylist()):
            under.setdefault(name, []).append(j)
        for i, boosts in enumerate(wanted):
            for name, boost in boosts.items():
                for j in under.get(name, ()):
                    scores[i, j] += boost
                    boosted[i, j] = boost
    least = np.array([max(threshold, out[r][-1]["confidence"]) if len(out[r]) == k else threshold for r in at])
    # the k-th best of the block bounds what it can add
    if scores.shape[1] > k:
        least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
    row, column = np.nonzero(scores >= least[:, None])
    for i, j in zip(row.tolist(), column.tolist(), strict=True):
        entry = {
            "confidence": float(scores[i, j]), "keyword_boost": boosted.get((i, j), 0.0), "pos": int(place[j]),
            "category_id": refs.column("category_id")[j].as_py(), "name": refs.column("name")[j].as_py(),
        }
        out[at[i]].append(entry)
    for r in set(at[row].tolist()):
        out[r] = sorted(out[r], key=lambda e: (-e["confidence"], e["pos"]))[:k]
