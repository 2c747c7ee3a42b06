"""WARC archives with a Zstandard dictionary in a leading skippable frame and one compressed frame a record.

Each task writes the rows it has as one archive in a folder all machines share: a skippable frame with a dictionary built
from the archive's own records, then each record as a frame of its own, as it comes. A payload of at least DEDUP bytes is
stored once, as the response of the smallest page_id that has it; the other pages are revisit records that refer to it.
A retried task writes a file of a new name, and only files that a finished task has named are read.

Null payloads count as empty. A null page_id is never referred to; where all pages of a payload have none, all are
responses. Equal rows are records of their own with one record id (the repeats of a response are responses too, as their page_id is the
smallest). An empty table writes no archive.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivano.llm.store import drop, materialise, new_path, small_batches

DEDUP = 100
#: Bytes of the dictionary, and of the records it is built from (evenly taken from the first HELD bytes of an archive).
DICTIONARY, SAMPLES, HELD, LEVEL = 32 << 10, 2 << 20, 16 << 20, 3
SKIPPABLE = 0x184D2A5D
CRLF = b"\r\n"
DATE = "2026-01-01T00:00:00Z"


def _id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"


def _uri(url: str | None) -> str:
    return quote(url or "urn:none", safe=":/?#[]@!$&'()*+,;=%~")


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """A record of WARC 1.1; of a revisit the payload is left out, its size and digest stay."""
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", _id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _uri(url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Identified-Payload-Type", "text/html"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _id(refers_to, digest)), ("WARC-Refers-To-Target-URI", _uri(refers_url)), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-ID", str(refers_to))]
        payload = b""
    head += [("Content-Type", "application/octet-stream"), ("Content-Length", str(len(payload)))]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + CRLF + payload + CRLF + CRLF


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(CRLF + CRLF)
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    size = int(fields["Content-Length"])
    if rest[size:] != CRLF + CRLF:
        raise ValueError("the record's length is wrong")
    return fields, rest[:size]


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """Of records taken evenly; where there are too few to train on, their own bytes."""
    total = sum(map(len, records))
    if not total:
        return None
    step = -(-total // SAMPLES)
    chosen = records[::step]
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(256, total // 16)), [x[: SAMPLES // 8] for x in chosen])
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(chosen)[-DICTIONARY:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Writer:
    """Writes one archive; the first HELD bytes of records wait for the dictionary."""

    def __init__(self, out):
        self.out, self.held, self.size, self.packer = out, [], 0, None

    def add(self, raw: bytes) -> None:
        if self.packer:
            self.out.write(self.packer.compress(raw))
            return
        self.held.append(raw)
        self.size += len(raw)
        if self.size >= HELD:
            self.begin()

    def begin(self) -> None:
        made = build_dictionary(self.held)
        if made:
            raw = made.as_bytes()
            self.out.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=True)
        for x in self.held:
            self.out.write(self.packer.compress(x))
        self.held = []

    def close(self) -> None:
        if not self.packer:
            self.begin()
        self.out.close()


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive, frame by frame; no more than a record and a part of the file is held."""
    start = stream.read(8)
    made = None
    if len(start) == 8 and struct.unpack("<I", start[:4])[0] == SKIPPABLE:
        raw = stream.read(struct.unpack("<I", start[4:])[0])
        kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        made, start = zstandard.ZstdCompressionDict(raw, dict_type=kind), b""
    unpacker = zstandard.ZstdDecompressor(dict_data=made)
    part, rest = unpacker.decompressobj(), start
    pieces: list[bytes] = []
    inside = False
    while True:
        if not rest and not (rest := stream.read(1 << 20)):
            break
        pieces.append(part.decompress(rest))
        rest, inside = b"", True
        if part.eof:
            yield parse(b"".join(pieces))
            rest, pieces, part, inside = part.unused_data, [], unpacker.decompressobj(), False
    if inside:
        raise ValueError("the archive ends inside a record")


def _open(folder: str):
    return pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:", "file://", 1) if folder.startswith("file:") else f"file://{folder}")


def write(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes pages (page_id, url, html); one row for each archive: its path and number of records."""
    small_batches(spark)
    folder = new_path(spark, "warc")
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    # Small payloads have a key of their own, which nothing meets. The responses are written before they are joined, so that
    # a payload that very many pages have is split.
    pages = pages.withColumn("key", F.when(F.octet_length("html") >= DEDUP, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))))
    first = pages.where(F.octet_length("html") >= DEDUP).groupBy("key").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = materialise(first.select("key", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url")), "responses")
    other = ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = pages.join(first, "key", "left").select("page_id", "url", "html", "digest", F.when(other, F.col("first")).alias("refers_to"), F.when(other, F.col("first_url")).alias("refers_url"))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, n, path = None, 0, f"{uuid.uuid4().hex}.warc.zst"
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                system, place = _open(folder)
                system.create_dir(place, recursive=True)
                writer = Writer(system.open_output_stream(f"{place}/{path}"))
            for page_id, url, html, digest, refers_to, refers_url in zip(*(c.to_pylist() for c in batch.columns)):
                writer.add(record("response" if refers_to is None else "revisit", page_id, url, html.encode(), digest, refers_to, refers_url))
                n += 1
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "records": pa.array([n], pa.int64())})

    archives = materialise(rows.mapInArrow(save, "path string, records long"), "archives")
    drop(first)
    return archives


SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(archives: DataFrame) -> DataFrame:
    """One row for each record of the archives; digests and sizes of stored payloads are computed anew."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for b in batches for p in b.column(0).to_pylist()):
            system, place = _open(path)
            rows: list[tuple] = []
            with system.open_input_stream(place) as stream:
                for head, payload in read_records(stream):
                    digest, size = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
                    if head["WARC-Type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                        raise ValueError(f"a payload in {path} isn't what was archived")
                    number = lambda name: int(head[name]) if name in head else None
                    rows.append((number("X-Page-ID"), size, digest, head["WARC-Type"], number("X-Refers-To-Page-ID")))
                    if len(rows) == 10_000:
                        yield _batch(rows)
                        rows = []
            if rows:
                yield _batch(rows)

    # One archive a task: their number is that of the tasks that wrote.
    spread = archives.select("path")
    return spread.repartition(max(1, archives.count()), "path").mapInArrow(load, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])
