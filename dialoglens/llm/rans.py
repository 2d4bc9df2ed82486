"""Token files coded with a static range asymmetric numeral system (rANS).

A file holds whole documents in ascending order: a header, document ids and lengths, a frequency table shared by all
blocks of the file, a table of checkpoints, and the blocks. A block codes a fixed number of tokens on interleaved lanes
that share one stream of 32-bit words. Its checkpoint has the place and length of the stream, the state of each lane
and a checksum, so each block decodes alone; numpy decodes all blocks of a file side by side.

Texts become ids in two steps that give what the tokenizer gives for the whole text: texts are parted at ASCII white
space and between a letter and an ASCII sign, where a tokenizer of this kind always parts and drops the space, and each
different part of a batch is encoded once, many in one call with a mark between them. The tokenizer finds its added tokens (such as `<|endoftext|>`) in
the raw text, before anything is parted: a text that holds one is encoded whole. So are all texts where the tokenizer's
file names another normalizer or another way to part texts.

Defined results: a NULL or empty text is the end id alone; rows without doc_id come first; rows repeated with one id
follow each other; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from array import array
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from dialoglens.llm.files import read_whole, write_whole
from dialoglens.llm.graph import small_batches
from dialoglens.llm.shingles import text_bytes, text_slices
from dialoglens.session import fresh_path, materialize

MAGIC = b"RANSTOK1"
LANES, STEPS = 32, 2048
LOW = np.uint64(1 << 31)
FILE_TOKENS = 2_000_000
TEXT_SLICE, WHOLE_SLICE = 4_000_000, 1_000_000
CACHED_PARTS = 400_000

#: What a tokenizer file has to say for its texts to be parted.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Bytes that end a part and are dropped, letters, and signs before which a part behind a letter ends.
SPACE, LETTER, SIGN = (np.zeros(256, bool) for _ in range(3))
SPACE[[32, *range(9, 14)]] = True
LETTER[[*range(65, 91), *range(97, 123)]] = True
SIGN[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
SMALL = np.arange(256, dtype=np.uint8)
SMALL[65:91] += 32
#: Stands between parts that are encoded in one call.
MARK, PARTS_A_CALL = "\x01", 200
THREADS = 2

MANIFEST_SCHEMA = "part int, file int, path string, docs long, tokens long, bytes long"
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


# ---- tokens --------------------------------------------------------------------------------------------------------

def parts_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The parts of all texts, one after the other, and the number of parts of each text."""
    body, at = text_bytes(texts)
    gap, letter = SPACE[body], LETTER[body]
    if (body == 0xC3).any():
        # À to ÿ, but for the two signs among them
        letter[1:] |= (body[:-1] == 0xC3) & (body[1:] != 0x97) & (body[1:] != 0xB7)
    begins = np.empty(len(body), bool)
    begins[:1] = True
    begins[1:] = gap[:-1] | (letter[:-1] & SIGN[body[1:]])
    begins[at[:-1][at[:-1] < len(body)]] = True
    begins &= ~gap
    first = np.flatnonzero(begins)
    kept = np.concatenate([[0], np.cumsum(~gap)])
    offsets, body = np.append(kept[first], kept[-1]), body[~gap]
    if len(first):
        # parts of ASCII alone have small letters whatever the normalizer composes
        plain = np.maximum.reduceat(body, offsets[:-1]) < 128
        body = np.where(np.repeat(plain, np.diff(offsets)), SMALL[body], body)
    parts = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(body.tobytes()))
    return parts, np.diff(np.searchsorted(first, at))


class PartEncoder:
    """Ids of texts by a tokenizer that parts at white space and drops it; each different part is encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        steps = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_part = (told.get("normalizer") or {}).get("normalizers") == NORMALIZER and steps[0].get("pattern") == {"Regex": WORDS}
        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.by_part &= len(self.mark) == 1
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.begins, self.lengths, self.ids = array("q"), array("q"), array("I")

    def learn(self, parts: list[str]) -> None:
        # a part that holds the mark itself is encoded alone
        alone = [p for p in parts if MARK in p]
        parts = [p for p in parts if MARK not in p] if alone else parts
        between = f" {MARK} "
        calls = [between.join(parts[k:k + PARTS_A_CALL]) + between for k in range(0, len(parts), PARTS_A_CALL)]
        coded = self.tokenizer.encode_batch_fast(calls, add_special_tokens=False)
        ids = np.concatenate([np.empty(0, np.uint32), *(np.array(c.ids, np.uint32) for c in coded)])
        ends = np.flatnonzero(ids == self.mark[0])
        lengths = np.diff(np.concatenate([[-1], ends])) - 1
        self.keep(parts, ids[ids != self.mark[0]], lengths)
        for part, one in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            self.keep([part], np.array(one.ids, np.uint32), np.array([len(one.ids)]))

    def keep(self, parts: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.known.update(zip(parts, count(len(self.known))))
        self.begins.frombytes((len(self.ids) + np.cumsum(lengths) - lengths).astype(np.int64).tobytes())
        self.lengths.frombytes(lengths.astype(np.int64).tobytes())
        self.ids.frombytes(ids.astype(np.uint32).tobytes())

    def whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts that aren't parted, and the number of ids of each text."""
        ids, lengths = [np.empty(0, np.uint32)], []
        for begin, end in text_slices(texts, WHOLE_SLICE):
            for coded in self.tokenizer.encode_batch_fast(texts[begin:end].to_pylist(), add_special_tokens=False):
                ids.append(np.array(coded.ids, np.uint32))
                lengths.append(len(ids[-1]))
        return np.concatenate(ids), np.array(lengths, np.int64)

    def parted(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts that are parted."""
        words, counts = parts_of(texts)
        coded = words.dictionary_encode()
        parts = coded.dictionary.to_pylist()
        if len(self.known) > CACHED_PARTS:
            self.forget()
        self.learn([p for p in parts if p not in self.known])
        place = np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))
        place = place[coded.indices.to_numpy(zero_copy_only=False)]
        lengths = np.frombuffer(self.lengths, np.int64)[place] if len(place) else np.empty(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        if not ends[-1]:
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        at = np.repeat(np.frombuffer(self.begins, np.int64)[place] - ends[:-1], lengths) + np.arange(ends[-1])
        return np.frombuffer(self.ids, np.uint32)[at], np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, each text closed by `end_id`, and the number of ids of each text."""
        texts = pc.fill_null(texts, "")
        holds = np.full(len(texts), not self.by_part)
        for token in self.added if self.by_part else ():
            holds |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        lengths = np.zeros(len(texts), np.int64)
        some, lengths[~holds] = self.parted(texts.filter(pa.array(~holds)) if holds.any() else texts)
        late, lengths[holds] = self.whole(texts.filter(pa.array(holds))) if holds.any() else (np.empty(0, np.uint32), 0)
        out = np.full(int(lengths.sum()) + len(texts), end_id, np.uint32)
        inside = np.ones(len(out), bool)
        inside[np.cumsum(lengths + 1) - 1] = False
        if len(late):
            of_late = np.repeat(holds, lengths + 1)
            out[inside & of_late] = late
            inside &= ~of_late
        out[inside] = some
        return out, lengths + 1


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PartEncoder:
    return PartEncoder(path)


# ---- codec ---------------------------------------------------------------------------------------------------------

def shared_table(counts: np.ndarray) -> tuple[int, np.ndarray]:
    """Precision in bits and frequencies that sum to two to that power, one at least for each symbol."""
    bits = max(16, int(np.ceil(np.log2(max(1, len(counts))))) + 2)
    total = 1 << bits
    freq = np.maximum(1, counts * total // counts.sum())
    rest = total - int(freq.sum())
    order = np.argsort(-freq, kind="stable")
    if rest > 0:
        freq[order[0]] += rest
    for k in order:
        if rest >= 0:
            break
        taken = min(int(freq[k]) - 1, -rest)
        freq[k] -= taken
        rest += taken
    return bits, freq.astype(np.uint64)


def encode_blocks(codes: np.ndarray, freq: np.ndarray, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """States of the lanes and word stream of each block; `codes` is blocks x steps x lanes of symbol numbers."""
    blocks, steps, lanes = codes.shape
    first = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    state = np.full((blocks, lanes), LOW, np.uint64)
    words, sent = np.empty((steps, blocks, lanes), np.uint32), np.empty((steps, blocks, lanes), bool)
    room, shift, word = np.uint64(63 - bits), np.uint64(bits), np.uint64(32)
    for step in range(steps - 1, -1, -1):
        code = codes[:, step, :]
        f = freq[code]
        full = state >= (f << room)
        words[step] = state.astype(np.uint32)
        sent[step] = full
        state = np.where(full, state >> word, state)
        whole = state // f
        state = (whole << shift) + (state - whole * f) + first[code]
    return state, [words[:, b, :][sent[:, b, :]] for b in range(blocks)]


def decode_blocks(states: np.ndarray, stream: np.ndarray, begins: np.ndarray, steps: int, freq: np.ndarray, bits: int) -> np.ndarray:
    """Symbol numbers, blocks x steps x lanes; the stream of block b begins at word `begins[b]`."""
    first = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    symbol_at = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
    stream = np.append(stream, np.uint32(0)).astype(np.uint64)
    out = np.empty((len(states), steps, states.shape[1]), np.uint32)
    state, at = states.copy(), begins.astype(np.int64).copy()
    mask, shift, word, last = np.uint64((1 << bits) - 1), np.uint64(bits), np.uint64(32), len(stream) - 1
    for step in range(steps):
        slot = state & mask
        code = symbol_at[slot]
        out[:, step, :] = code
        state = freq[code] * (state >> shift) + slot - first[code]
        low = state < LOW
        taken = np.cumsum(low, axis=1)
        ahead = np.minimum(at[:, None] + taken - low, last)
        state = np.where(low, (state << word) | stream[ahead], state)
        at += taken[:, -1]
    return out


def pack_file(doc_ids: np.ndarray, has_id: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """Bytes of a file of whole documents."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts, number = counts[symbols], np.zeros(len(counts), np.uint32)
    number[symbols] = np.arange(len(symbols), dtype=np.uint32)
    codes = number[ids]
    bits, freq = shared_table(counts.astype(np.int64))
    steps = min(STEPS, -(-len(ids) // LANES))
    blocks = -(-len(ids) // (steps * LANES))
    padded = np.full(blocks * steps * LANES, int(np.argmax(counts)), np.uint32)
    padded[: len(ids)] = codes
    states, streams = encode_blocks(padded.reshape(blocks, steps, LANES), freq, bits)
    ends = np.cumsum([len(s) for s in streams])
    checks = [zlib.crc32(s.tobytes(), zlib.crc32(x.tobytes())) for x, s in zip(states, streams, strict=True)]
    head = np.array([len(doc_ids), len(ids), bits, len(symbols), steps, blocks], "<u8")
    return [
        MAGIC, head.tobytes(), doc_ids.astype("<i8").tobytes(), has_id.astype("u1").tobytes(), lengths.astype("<u4").tobytes(),
        symbols.astype("<u4").tobytes(), freq.astype("<u4").tobytes(),
        ends.astype("<u8").tobytes(), np.array(checks, "<u4").tobytes(), states.astype("<u8").tobytes(),
        *(s.astype("<u4").tobytes() for s in streams),
    ]


class TokenFile:
    """Reader of one file: documents by number, tokens by blocks."""

    def __init__(self, data: memoryview):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a token file")
        self.at = 8
        self.data = data
        n_docs, self.n_tokens, self.bits, n_symbols, self.steps, self.blocks = map(int, self.take("<u8", 6))
        self.doc_ids, self.has_id = self.take("<i8", n_docs), self.take("u1", n_docs).astype(bool)
        self.lengths = self.take("<u4", n_docs).astype(np.int64)
        self.symbols, self.freq = self.take("<u4", n_symbols), self.take("<u4", n_symbols).astype(np.uint64)
        self.ends, self.checks = self.take("<u8", self.blocks).astype(np.int64), self.take("<u4", self.blocks)
        self.states = self.take("<u8", self.blocks * LANES).reshape(self.blocks, LANES).astype(np.uint64)
        self.stream = self.take("<u4", int(self.ends[-1]) if self.blocks else 0)

    def take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self.data, kind, n, self.at)
        self.at += out.nbytes
        return out

    def tokens(self, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
        """Ids of blocks `first_block` to `last_block`, exclusive; reads nothing of the others."""
        last_block = self.blocks if last_block is None else last_block
        begins = np.concatenate([[0], self.ends])[first_block:last_block]
        ends = self.ends[first_block:last_block]
        states = self.states[first_block:last_block]
        for b, (x, y) in enumerate(zip(begins, ends, strict=True)):
            if zlib.crc32(self.stream[x:y].tobytes(), zlib.crc32(states[b].tobytes())) != self.checks[first_block + b]:
                raise ValueError(f"block {first_block + b} is damaged")
        if not len(begins):
            return np.empty(0, np.uint32)
        part = self.stream[begins[0]:ends[-1]]
        codes = decode_blocks(states, part, begins - begins[0], self.steps, self.freq, self.bits).reshape(-1)
        whole = self.steps * LANES
        return self.symbols[codes[: self.n_tokens - first_block * whole]].astype(np.uint32)


# ---- jobs ----------------------------------------------------------------------------------------------------------

def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write all documents in ascending order and return the stored list of files.

    Ranges of ids go to tasks; ids that are repeated spread by their texts' checksums.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(tokenizer), TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        done, size = [], 0

        def flush() -> None:
            nonlocal held, size
            if not held:
                return
            ids, known, lengths, tokens = (np.concatenate(x) for x in zip(*held, strict=True))
            path = f"{folder}/tokens-{part:06d}-{len(done):06d}.bin"
            data = pack_file(ids, known, lengths, tokens)
            write_whole(path, data)
            done.append((part, len(done), path, len(ids), len(tokens), sum(map(len, data))))
            held, size = [], 0

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for begin, end in text_slices(texts, TEXT_SLICE):
                tokens, lengths = coder.encode(texts[begin:end], end_id)
                some = ids[begin:end]
                held.append((pc.fill_null(some, 0).to_numpy(zero_copy_only=False), pc.is_valid(some).to_numpy(zero_copy_only=False), lengths, tokens))
                size += len(tokens)
                if size >= file_tokens:
                    flush()
        flush()
        columns = list(zip(*done, strict=True)) if done else [[]] * 6
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        names = [f.split()[0] for f in MANIFEST_SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    order = (F.col("doc_id"), F.col("tie"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.crc32(F.col("text").cast("binary")).alias("tie"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    with small_batches(docs.sparkSession):
        return materialize(ranged.mapInArrow(write, MANIFEST_SCHEMA), "token-files")


def with_starts(files: DataFrame) -> DataFrame:
    """Add `start`, the tokens of all files before. One number for each task comes to the driver."""
    spark = files.sparkSession
    before, totals = 0, []
    for part, tokens in files.groupBy("part").agg(F.sum("tokens")).orderBy("part").collect():
        totals.append((part, before))
        before += tokens
    bases = spark.createDataFrame(totals, "part int, base long")
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return files.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).drop("base")


def read_documents(files: DataFrame) -> DataFrame:
    """Place, length and checksum of each document, decoded from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = TokenFile(read_whole(path))
                data = memoryview(file.tokens().astype("<u4").tobytes())
                ends = np.cumsum(file.lengths)
                begins = ends - file.lengths
                crc = [zlib.crc32(data[4 * x:4 * y]) for x, y in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file.doc_ids, pa.int64(), mask=~file.has_id), pa.array(begins + start), pa.array(file.lengths), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    listed = with_starts(files).select("path", "start")
    return listed.repartition(max(1, files.count())).mapInArrow(read, READ_SCHEMA)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write the token files of all documents and read them back."""
    folder = folder or fresh_path(docs.sparkSession, "tokens")
    return read_documents(write_token_files(docs, folder, tokenizer, end_id, file_tokens))
