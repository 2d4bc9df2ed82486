"""Vector expressions and the pluggable text embedder."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def l2_normalize(vector: Column) -> Column:
    norm = F.sqrt(dot(vector, vector))
    return F.when(norm > 0, F.transform(vector, lambda x: (x.cast("double") / norm).cast("float"))).otherwise(vector)


def similarity_to(vectors: list[list[float]]) -> Callable[[Column], Column]:
    """Dot products of a vector column with a config-sized list, as one array per row.

    The matrix travels with the function; rows are not multiplied and nothing shuffles.
    """
    matrix = np.asarray(vectors, dtype=np.float64).T

    @F.pandas_udf("array<double>")
    def similarities(batch: pd.Series) -> pd.Series:
        scores: list = [None] * len(batch)
        present = np.flatnonzero(batch.notna().to_numpy())
        if len(present):
            stacked = np.stack([np.asarray(batch.iloc[i], dtype=np.float64) for i in present])
            for position, row in zip(present, stacked @ matrix):
                scores[position] = row
        return pd.Series(scores, dtype=object)

    return similarities


def hashing_embedder(dimensions: int = 64) -> Callable[[Column], Column]:
    """Default embedder: signed hashing of words into a unit vector. Needs no model.

    Each different word of a batch is hashed once; all texts of the batch are counted side by side.
    """

    @F.pandas_udf("array<float>")
    def embedded(batch: pd.Series) -> pd.Series:
        texts = pa.array(batch, pa.string(), from_pandas=True)
        words = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
        coded = words.flatten().dictionary_encode()
        known = coded.dictionary.to_pylist()
        codes = np.array([zlib.crc32(word.encode("utf-8")) for word in known], np.int64)
        # blanks at the ends of a text split off empty words
        signs = np.array([0.0 if not word else 1.0 if code & 0x80000000 else -1.0 for word, code in zip(known, codes.tolist(), strict=True)])
        row = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
        word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        at = row * dimensions + (codes % dimensions)[word] if len(known) else np.empty(0, np.int64)
        sums = np.bincount(at, weights=signs[word] if len(known) else None, minlength=len(texts) * dimensions)
        vectors = sums.reshape(-1, dimensions).astype(np.float32)
        norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
        vectors = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)
        return pd.Series(list(vectors))

    return embedded
