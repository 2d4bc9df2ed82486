"""WARC archives, each record compressed alone with a Zstandard dictionary made from the archive's own records.

The dictionary stands in a leading skippable frame, as readers of .warc.zst files expect, so an archive needs no other
file. Of pages with equal payloads of `least_bytes` and more, the one with the largest id holds the payload and the
others are revisit records that refer to it.

Defined results: NULL html is the empty payload; NULL url is left out; a page without id has the record id of no page,
and never is the one referred to; rows repeated with the largest id of their payload all hold it; an empty table gives
no rows. Records are written whole whatever their length.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from dialoglens.llm.files import read_whole, write_whole
from dialoglens.session import fresh_path, materialize

#: Fixed values of the format.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

LEAST_BYTES = 1000
ARCHIVE_BYTES = 32_000_000
DICTIONARY_BYTES = 65_536
#: Bytes of records, spread evenly over an archive, that its dictionary is made from.
TRAINING_BYTES = 2_000_000
LEVEL = 3
WINDOW = 16_384

MANIFEST_SCHEMA = "path string, records long, bytes long"
READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


# ---- records -------------------------------------------------------------------------------------------------------

def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(urn: str) -> int | None:
    name = urn.strip("<>").removeprefix("urn:page:")
    return None if name == "none" else int(name)


def base32(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, date: str) -> bytes:
    """A response with its payload, or, with `refers_to`, a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += [f"WARC-Payload-Digest: {base32(digest)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(lines: bytes) -> dict[str, str]:
    found = (line.partition(":") for line in lines.decode().split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in found}


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = headers(head)
    block = rest[: int(warc["content-length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError("a record of another length than its header says")
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, headers(http), payload


# ---- archives ------------------------------------------------------------------------------------------------------

def train(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """Dictionary of an archive; None where it has too few records for one."""
    stride = max(1, -(-sum(map(len, records)) // TRAINING_BYTES))
    chosen = [r[: TRAINING_BYTES // 10] for r in records[::stride]]
    if len(chosen) < 16 or sum(map(len, chosen)) < 4 * DICTIONARY_BYTES:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, chosen, k=512, d=8)
    except zstandard.ZstdError:
        return None


def pack_archive(records: list[bytes], level: int = LEVEL) -> list[bytes]:
    dictionary = train(records)
    if dictionary is None:
        coder, lead = zstandard.ZstdCompressor(level=level, write_checksum=True), []
    else:
        data = dictionary.as_bytes()
        dictionary.precompute_compress(level=level)
        coder = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True)
        lead = [struct.pack("<II", DICTIONARY_FRAME, len(data)), data]
    return lead + [coder.compress(r) for r in records]


def read_archive(data: memoryview) -> Iterator[bytes]:
    """Records of an archive, one at a time."""
    at, dictionary = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", data, 4)[0]
        dictionary = zstandard.ZstdCompressionDict(bytes(data[8:8 + size]))
        at = 8 + size
    coder = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        frame, parts = coder.decompressobj(), []
        while not frame.eof:
            chunk = data[at:at + WINDOW]
            if not chunk:
                raise ValueError("the archive ends inside a record")
            parts.append(frame.decompress(chunk))
            at += len(chunk)
        at -= len(frame.unused_data)
        yield b"".join(parts)


# ---- jobs ----------------------------------------------------------------------------------------------------------

def with_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload (NULL in a revisit), payload_bytes, digest and refers_to.

    Only payloads that occur more than once are joined; a payload with very many pages is split by the adaptive join.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"),
        F.length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("digest"),
    )
    again = (
        rows.filter(F.col("payload_bytes") >= least_bytes).groupBy("digest", "payload_bytes")
        .agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies")).filter("copies > 1 AND keeper IS NOT NULL").drop("copies")
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    return rows.join(again, ["digest", "payload_bytes"], "left").select(
        "page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "payload_bytes", "digest", refers.alias("refers_to")
    )


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write the archives and return their stored list. A task holds one archive at a time."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[bytes] = []
        done, size = [], 0

        def flush() -> None:
            nonlocal held, size
            if not held:
                return
            path = f"{folder}/pages-{part:06d}-{len(done):06d}.warc.zst"
            data = pack_archive(held)
            write_whole(path, data)
            done.append((path, len(held), sum(map(len, data))))
            held, size = [], 0

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, n, digest, refers_to = (batch.column(c)[i].as_py() for c in range(6))
                held.append(make_record(page_id, url, payload or b"", digest, n, refers_to, date))
                size += len(held[-1])
                if size >= archive_bytes:
                    flush()
        flush()
        columns = list(zip(*done, strict=True)) if done else [[]] * 3
        kinds = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "records", "bytes"])

    return materialize(records.mapInArrow(write, MANIFEST_SCHEMA), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """What each record of the archives says; a response's digest and length are those of the payload read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for data in read_archive(read_whole(path)):
                    warc, http, payload = parse_record(data)
                    digest = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
                    kind, size, refers = warc["warc-type"], int(http["content-length"]), warc.get("warc-refers-to")
                    if kind == "response" and (hashlib.sha1(payload).hexdigest(), len(payload)) != (digest, size):
                        raise ValueError(f"{path}: the payload of {warc['warc-record-id']} is damaged")
                    rows.append((page_of(warc["warc-record-id"]), size, digest, kind, page_of(refers) if refers else None))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                names = [f.split()[0] for f in READ_SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return archives.select("path").repartition(max(1, archives.count())).mapInArrow(read, READ_SCHEMA)


def archive_pages(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages into archives and read them back."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    return read_archives(write_archives(with_revisits(pages), folder, archive_bytes))
