"""Hashed word shingles of texts, computed with numpy over the bytes of a whole batch.

A-Z are lower-cased; words are runs of bytes other than space and tab to carriage return. A text's set has a 64-bit hash
for each distinct shingle of `width` words; a text with fewer words has one shingle of all of them, and a text without
words the empty set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDTH = 5
SLICE_BYTES = 1_000_000

LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += 32
BREAK = np.zeros(256, bool)
BREAK[[32, *range(9, 14)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every bit of the result depends on every bit of `x`."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(seed: int, n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


PLACE = odd_numbers(7, 64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each begins, with the end of the last."""
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.empty(0, np.uint8)
    return body, at - at[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, in order, and the number of words before each text, with the total."""
    body, at = text_bytes(texts)
    if not len(body):
        return np.empty(0, np.uint64), np.zeros(len(at), np.int64)
    gap = BREAK[body]
    after_gap = np.concatenate([[True], gap[:-1]])
    after_gap[at[:-1][at[:-1] < len(body)]] = True
    before_gap = np.concatenate([gap[1:], [True]])
    before_gap[at[1:][at[1:] > 0] - 1] = True
    begins, ends = np.flatnonzero(~gap & after_gap), np.flatnonzero(~gap & before_gap) + 1
    if not len(begins):
        return np.empty(0, np.uint64), np.zeros(len(at), np.int64)
    lengths = ends - begins
    power = np.cumprod(np.full(int(lengths.max()), 0x100000001B3, np.uint64))
    letters = LOWER[body[~gap]] + np.uint64(1)
    first = np.cumsum(lengths) - lengths
    letters *= power[np.arange(len(letters)) - np.repeat(first, lengths)]
    return mixed(np.add.reduceat(letters, first) + lengths.astype(np.uint64)), np.searchsorted(begins, at)


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order."""
    words, at = word_hashes(texts)
    whole = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for j in range(width):
        whole += words[j:j + len(whole)] * PLACE[j]
    whole = mixed(whole)
    for begin, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if end - begin >= width:
            yield np.unique(whole[begin:end - width + 1])
        elif end > begin:
            few = np.uint64(end - begin)
            yield mixed((words[begin:end] * PLACE[width:width + end - begin]).sum(keepdims=True) + few)
        else:
            yield np.empty(0, np.uint64)


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `most` bytes of text; a longer text is a run of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(texts):
        done = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, done + most, side="right")))
        yield begin, end
        begin = end
