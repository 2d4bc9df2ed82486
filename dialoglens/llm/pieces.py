"""SentencePiece models run by the tokenizers library.

The model file's protobuf gives the normalizer, the pieces with their scores and the byte pieces. A unigram model keeps
its scores; a BPE model's scores become merge ranks. Texts get the metaspace marker in place of spaces and in front.
Where no piece has the marker behind another character, pieces never cross the place before a run of markers, so a text
is cut there and each different stretch of a batch is encoded once, many at a time on several threads.

Each new stretch can be compared with the sentencepiece library's own result; `parity` says whether all of a text's
stretches agree, and is NULL where some were not compared. Decoding takes each piece's bytes from a table; what doesn't
come out as UTF-8 (ids that no text has) is left to the tokenizers library.

Defined results: a NULL or empty text has no ids and decodes to the empty text; bytes without a piece of their own
become byte pieces, so texts survive whole, but for the marker character itself, which reads back as a space; rows may
repeat and lack a doc_id; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from dialoglens.llm.shingles import text_slices

#: Fixed values of the model file.
MARKER = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2

SLICE_BYTES = 1_000_000
CACHED_STRETCHES = 100_000
THREADS = 2
UNTRIED = 2

ROUND_TRIP_SCHEMA = "doc_id long, ids binary, n_pieces long, ids_crc32 long, parity boolean, round_trip boolean, text string"
ENCODED_SCHEMA = "doc_id long, ids array<int>, parity boolean, text_bytes long, text_crc32 long"


# ---- rebuilding ----------------------------------------------------------------------------------------------------

def read_model(path: str):
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(path, "rb") as file:
        return pb.ModelProto.FromString(file.read())


def merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Every way to join two pieces to a third; joins to a piece with a higher score come first."""
    usable = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
    found = []
    for piece in usable:
        for k in range(1, len(piece)):
            left, right = piece[:k], piece[k:]
            if left in usable and right in usable:
                found.append((-pieces[usable[piece]][1], usable[piece], usable[left], usable[right], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def rebuilt(proto):
    """The model as a tokenizer of the tokenizers library, with normalizer and decoder."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    pieces = [(p.piece, p.score, p.type) for p in proto.pieces]
    byte_fallback = any(kind == BYTE for *_, kind in pieces)
    unknown = next(i for i, (*_, kind) in enumerate(pieces) if kind == UNKNOWN)
    if proto.trainer_spec.model_type == UNIGRAM:
        model = models.Unigram([(p, score) for p, score, _ in pieces], unk_id=unknown, byte_fallback=byte_fallback)
    elif proto.trainer_spec.model_type == BPE:
        if any(kind == USER_DEFINED for *_, kind in pieces):
            raise ValueError("a BPE model with user-defined pieces, which are matched before all others, can't be rebuilt")
        vocabulary = {p: i for i, (p, *_) in enumerate(pieces)}
        model = models.BPE(vocabulary, merges(pieces), unk_token=pieces[unknown][0], fuse_unk=True, byte_fallback=byte_fallback)
    else:
        raise ValueError("only unigram and BPE models can be rebuilt")
    tokenizer = Tokenizer(model)
    spec, steps = proto.normalizer_spec, []
    if spec.precompiled_charsmap:
        steps.append(normalizers.Precompiled(spec.precompiled_charsmap))
    if spec.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARKER))
    steps.append(normalizers.Replace(" ", MARKER))
    tokenizer.normalizer = normalizers.Sequence(steps)
    strip = [decoders.Strip(" ", 1, 0)] if spec.add_dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    return tokenizer


class PieceCoder:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str, verify: bool = True):
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        proto = read_model(path)
        self.tokenizer = rebuilt(proto)
        self.spec = proto.normalizer_spec
        self.bare = type(self.tokenizer)(self.tokenizer.model)
        self.own = sentencepiece.SentencePieceProcessor(model_file=path) if verify else None
        self.joins = self.own.piece_to_id(MARKER) if self.own else None
        self.spelt = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(MARKER, " ").encode() for p in proto.pieces]
        self.table = np.frombuffer(b"".join(self.spelt), np.uint8)
        self.widths = np.array([len(x) for x in self.spelt], np.int64)
        self.starts = np.cumsum(self.widths) - self.widths
        crossing = any(re.search(f"[^{MARKER}]{MARKER}", p.piece) for p in proto.pieces)
        self.by_stretch = not (crossing or self.spec.precompiled_charsmap or self.spec.remove_extra_whitespaces)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.begins, self.lengths, self.ids, self.agree = array("q"), array("q"), array("i"), array("b")

    def learn(self, stretches: list[str]) -> None:
        coded = self.bare.encode_batch_fast(stretches, add_special_tokens=False)
        checks = [None] * len(stretches)
        if self.own and self.spec.add_dummy_prefix:
            # the library puts a marker in front itself
            bare = [s[1:].replace(MARKER, " ") if s.startswith(MARKER) else None for s in stretches]
            checks = self.own.encode([b or "" for b in bare], num_threads=THREADS)
            # a lone marker is what the library makes of no text at all; the empty stretch has no ids
            checks = [c if b else [self.joins] if s == MARKER else None if s else [] for s, b, c in zip(stretches, bare, checks, strict=True)]
        ids = [one.ids for one in coded]
        self.known.update(zip(stretches, count(len(self.known))))
        self.begins.extend(accumulate(map(len, ids[:-1]), initial=len(self.ids)) if ids else ())
        self.lengths.extend(map(len, ids))
        self.agree.extend(UNTRIED if check is None else check == own for own, check in zip(ids, checks, strict=True))
        self.ids.extend(chain.from_iterable(ids))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """All ids one after the other, the number of ids of each text, and whether its stretches agree (NULL: not all tried)."""
        texts = pc.fill_null(texts, "")
        if not self.by_stretch:
            plain = texts.to_pylist()
            coded = [c.ids for c in self.tokenizer.encode_batch_fast(plain, add_special_tokens=False)]
            agree = [None if self.own is None else self.own.encode(t) == c for t, c in zip(plain, coded, strict=True)]
            return np.array([i for c in coded for i in c], np.int32), np.array([len(c) for c in coded], np.int64), pa.array(agree, pa.bool_())
        marked = pc.replace_substring(texts, " ", MARKER)
        if self.spec.add_dummy_prefix:
            marked = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(MARKER, marked, ""))
        parted = pc.split_pattern(pc.replace_substring_regex(marked, f"([^{MARKER}]){MARKER}", rf"\1 {MARKER}"), " ")
        coded = parted.flatten().dictionary_encode()
        stretches = coded.dictionary.to_pylist()
        if len(self.known) > CACHED_STRETCHES:
            self.forget()
        self.learn([s for s in stretches if s not in self.known])
        place = np.fromiter(map(self.known.__getitem__, stretches), np.int64, len(stretches))[coded.indices.to_numpy(zero_copy_only=False)]
        lengths = np.frombuffer(self.lengths, np.int64)[place]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(np.frombuffer(self.begins, np.int64)[place] - ends[:-1], lengths) + np.arange(ends[-1])
        source = np.frombuffer(self.ids, np.int32) if self.ids else np.empty(0, np.int32)
        offsets = parted.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        agree = np.frombuffer(self.agree, np.int8)[place]
        wrong, untried = (np.diff(np.concatenate([[0], np.cumsum(agree == k)])[offsets]) > 0 for k in (0, UNTRIED))
        return source[at], np.diff(ends[offsets]), pa.array(~wrong, mask=untried & ~wrong)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)

    def decode_flat(self, ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
        """Texts of ids that stand one after the other, by the table of pieces."""
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.widths):
            return pa.array(self.decode([x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])]), pa.string())
        widths = self.widths[ids]
        ends = np.concatenate([[0], np.cumsum(widths)])
        body = self.table[np.repeat(self.starts[ids] - ends[:-1], widths) + np.arange(ends[-1])]
        offsets = ends[np.concatenate([[0], np.cumsum(lengths)])]
        if self.spec.add_dummy_prefix:
            # the blank in front of a text is none of its own
            first = offsets[:-1][(np.diff(offsets) > 0)]
            first = first[body[first] == 32]
            body, gone = np.delete(body, first), np.searchsorted(first, offsets, side="left")
            offsets = offsets - gone
        texts = pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(body.tobytes()))
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:
            return pa.array(self.decode([x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])]), pa.string())
        return texts


@functools.lru_cache(maxsize=1)
def coder(path: str, verify: bool = True) -> PieceCoder:
    """One model for each worker process; the stretches that it knows are forgotten at the end of a task."""
    return PieceCoder(path, verify)


# ---- jobs ----------------------------------------------------------------------------------------------------------

def encode_documents(docs: DataFrame, model: str, verify: bool = True) -> DataFrame:
    """doc_id, ids, parity, and length and checksum of the text's UTF-8 bytes."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = coder(model, verify)
        for batch in batches:
            for begin, end in text_slices(batch.column(1), SLICE_BYTES):
                texts = batch.column(1)[begin:end]
                ids, lengths, agree = run.encode(texts)
                offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
                plain = [t.as_py() for t in pc.fill_null(texts, "").cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[begin:end], pa.ListArray.from_arrays(offsets, pa.array(ids)), agree,
                     pa.array([len(p) for p in plain], pa.int64()), pa.array([zlib.crc32(p) for p in plain], pa.int64())],
                    names=["doc_id", "ids", "parity", "text_bytes", "text_crc32"],
                )
        run.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, ENCODED_SCHEMA)


def decode_documents(encoded: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and the text that each row's `ids` stand for."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.select(*keep).schema)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = coder(model, False)
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(lengths)
            ids, begin = batch.column("ids").flatten().to_numpy(zero_copy_only=False), 0
            while begin < batch.num_rows:
                done = ends[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, done + SLICE_BYTES // 4, side="right")))
                part, texts = batch.slice(begin, end - begin), run.decode_flat(ids[done:ends[end - 1]], lengths[begin:end])
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), texts], names=[*keep, "text"])
                begin = end

    return encoded.select(*keep, "ids").mapInArrow(decode, f"{kinds}, text string")


def round_trip(docs: DataFrame, model: str, verify: bool = True) -> DataFrame:
    """What encoding and then decoding all documents gives, both in one pass of a task over its texts.

    `ids` are little-endian 32-bit integers; `text` is decoded from them, and `ids_crc32` is their checksum.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = coder(model, verify)
        for batch in batches:
            for begin, end in text_slices(batch.column(1), SLICE_BYTES):
                texts = batch.column(1)[begin:end]
                ids, lengths, agree = run.encode(texts)
                cuts = np.concatenate([[0], np.cumsum(lengths)]).tolist()
                each = [ids[x:y].astype("<i4").tobytes() for x, y in zip(cuts, cuts[1:], strict=False)]
                back = run.decode_flat(np.frombuffer(b"".join(each), "<i4"), lengths)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[begin:end], pa.array(each, pa.binary()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(one) for one in each], pa.int64()),
                     agree, pc.equal(back, pc.fill_null(texts, "")), back],
                    names=["doc_id", "ids", "n_pieces", "ids_crc32", "parity", "round_trip", "text"],
                )
        run.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(code, ROUND_TRIP_SCHEMA)
