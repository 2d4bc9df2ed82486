"""Quality classifier: ridge regression on random Fourier features, calibrated by isotonic regression.

Each text becomes a row of statistics. Random Fourier features of the standardized statistics approximate a Gaussian
kernel. Partitions sum their part of the normal equations, whose size is fixed; the sums are solved on the driver.
The raw score then becomes a probability: labelled rows that were not fitted are counted in narrow bins of it, and
adjacent bins whose shares of good rows fall are pooled.

Labels are taken from rows whose crc32(doc_id) mod 4 is not 2: remainders 0 and 1 fit, 3 calibrates. No other column
than the text enters a score.

Defined results: NULL text counts as empty, and an empty text is scored like others; a label that is NULL or belongs to
no document is left out, and repeated labels all count; without labels of both kinds every score is the share of good
labels, or 1 where there are none; a document without id is scored and not held out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dialoglens.llm.graph import counted_small, row_key, small_batches
from dialoglens.llm.shingles import text_bytes, text_slices, word_hashes
from dialoglens.session import materialize

STATISTICS = (
    "bytes", "words", "upper", "lower", "digits", "signs", "marks", "other", "breaks", "word_length", "word_spread", "short_words",
    "distinct_words", "top_word", "distinct_pairs", "same_again", "distinct_lines", "entropy",
)
FEATURES = 256
RIDGE = 1e-3
BINS = 2000
THRESHOLD = 0.7
SEED = 5

KIND_OF = np.full(256, 7, np.int8)
KIND_OF[65:91], KIND_OF[97:123], KIND_OF[48:58] = 0, 1, 2
KIND_OF[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3
KIND_OF[[ord(c) for c in "#$%&*!|<>{}[]=~^\\"]] = 4
KIND_OF[128:] = 5
KIND_OF[10] = 6


# ---- statistics ----------------------------------------------------------------------------------------------------

def statistics(texts: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text, from all of its bytes, words and lines."""
    body, at = text_bytes(texts)
    words, word_at = word_hashes(texts)
    out = np.zeros((len(texts), len(STATISTICS)))
    gap = np.zeros(256, bool)
    gap[[32, *range(9, 14)]] = True
    for k in range(len(texts)):
        part, own = body[at[k]:at[k + 1]], words[word_at[k]:word_at[k + 1]]
        n, m = len(part), len(own)
        if not n:
            continue
        counts = np.bincount(part, minlength=256)
        share = np.bincount(KIND_OF, weights=counts, minlength=8) / n
        present = counts[counts > 0] / n
        out[k, :9] = np.log1p(n), np.log1p(m), *share[:7]
        out[k, 17] = -(present * np.log2(present)).sum()
        lines = part.tobytes().split(b"\n")
        out[k, 16] = len(set(lines)) / len(lines)
        if not m:
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[True], gap[part], [True]]).astype(np.int8)))
        lengths = edges[1::2] - edges[::2]
        many = np.unique(own, return_counts=True)[1]
        pairs = own[:-1] * np.uint64(31) + own[1:]
        out[k, 9:16] = (
            lengths.mean(), lengths.std(), (lengths <= 3).mean(), len(many) / m, many.max() / m,
            len(np.unique(pairs)) / max(1, m - 1), (own[:-1] == own[1:]).sum() / max(1, m - 1),
        )
    return out


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, row key and `x`, the statistics; stored, so that texts are read once."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in text_slices(batch.column(1)):
                rows = statistics(batch.column(1)[begin:end])
                offsets = pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32())
                x = pa.ListArray.from_arrays(offsets, pa.array(rows.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[begin:end], batch.column(2)[begin:end], x], names=["doc_id", "row", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("row"))
    with small_batches(docs.sparkSession):
        return materialize(rows.mapInArrow(make, "doc_id long, row long, x array<double>"), "statistics")


# ---- model ---------------------------------------------------------------------------------------------------------

@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None
    edges: np.ndarray | None = None
    values: np.ndarray | None = None
    share: float = 1.0

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant; statistics far outside the fitted range are held at its rim."""
        draw = np.random.default_rng(SEED)
        d = x.shape[1]
        turn = draw.normal(0, 1 / np.sqrt(d), (d, FEATURES))
        shift = draw.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ turn + shift), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.share)
        raw = self.raw(x)
        return np.clip(np.interp(raw, self.edges, self.values) if self.edges is not None else raw, 0, 1)


def rows_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    flat = batch.column(name).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, len(STATISTICS)))


def normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sums of z z' and z y over all rows (x, y), added up by partition and then by row of the matrix."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            z = model.features(rows_of(batch, "x"))
            total += z.T @ np.hstack([z, batch.column("y").to_numpy(zero_copy_only=False)[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1)), pa.array(list(total))], names=["i", "sums"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": rows["i"].iloc[:1], "sums": [np.sum(np.stack(rows["sums"].tolist()), axis=0)]})

    sums = rows.mapInArrow(part, "i long, sums array<double>").groupBy("i").applyInPandas(add, "i long, sums array<double>")
    whole = np.array([r["sums"] for r in sums.orderBy("i").collect()])
    return whole[:, :-1], whole[:, -1]


def pooled(centres: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent bins: centres and shares of the pools, in rising order."""
    pools: list[list[float]] = []
    for x, g, k in zip(centres, good, n, strict=True):
        pools.append([x * k, g, k])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def train(statistics: DataFrame, labels: DataFrame) -> Model:
    """Fit and calibrate on all labelled rows outside the held-out fold; only sums of fixed size reach the driver."""
    known = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    rows = materialize(statistics.join(known, "doc_id").withColumn("fold", fold()).filter("fold <> 2").select("fold", "x", "y"), "labelled")
    fitted, rest = rows.filter("fold < 2"), rows.filter("fold = 3")
    d = len(STATISTICS)
    means = [f(F.get("x", k)) for k in range(d) for f in (F.avg, F.stddev_pop)]
    first = fitted.agg(F.count("*"), F.avg("y"), *means).first()
    if not first[0] or first[1] in (0.0, 1.0):
        return Model(np.zeros(d), np.ones(d), share=1.0 if first[1] is None else first[1])
    moments = np.array(first[2:]).reshape(d, 2)
    model = Model(moments[:, 0], np.maximum(moments[:, 1], 1e-6), share=first[1])
    left, right = normal_equations(fitted.select("x", "y"), model)
    model.weights = np.linalg.solve(left + RIDGE * first[0] / FEATURES * np.eye(FEATURES + 1), right)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.clip(np.rint(model.raw(rows_of(batch, "x")) * BINS / 2), -BINS, 2 * BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("y")], names=["bin", "y"])

    bins = rest.select("x", "y").mapInArrow(binned, "bin long, y double").groupBy("bin").agg(F.sum("y").alias("good"), F.count("*").alias("n")).orderBy("bin").collect()
    if bins:
        model.edges, model.values = pooled(*(np.array([float(b[k]) for b in bins]) / (BINS / 2 if k == "bin" else 1) for k in ("bin", "good", "n")))
    return model


def scores(statistics: DataFrame, model: Model) -> DataFrame:
    """doc_id, row key and score of every document."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(model.score(rows_of(batch, "x")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), found], names=["doc_id", "row", "score"])

    return statistics.mapInArrow(score, "doc_id long, row long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    rows = document_statistics(docs)
    return scores(rows, train(rows, labels)).select(
        "doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score of `threshold` and more, with all their columns."""
    rows = document_statistics(docs)
    low = materialize(scores(rows, train(rows, labels)).filter(F.col("score") < threshold).select(F.col("row").alias("_row")).distinct(), "rejected")
    return docs.join(counted_small(low), row_key() == F.col("_row"), "left_anti")
