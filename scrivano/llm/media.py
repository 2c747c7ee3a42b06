"""Media columns: Netpbm and BMP images to numpy arrays, area resizing by integral images, NPY tiles, difference hashes.

A text is stored as an image: its UTF-8 bytes, filled up with bytes 255 to a positive multiple of TILE * TILE, are the
8-bit samples of a Netpbm grey map TILE samples wide, which is cut into square tiles and written as one NPY array (tiles,
rows, columns) in a binary column. Null counts as empty, and an empty text is one tile of 255. Equal texts give equal
bytes, so repeated rows give equal values. Sizes are bounded by the row alone.

Columns of Netpbm or BMP files become tiles by `image_tiles`: a colour image has a third axis. A null, or bytes that are not
such a file (malformed, cut short, compressed, or without any sample), give a null. `image_hash` gives the difference hash of an image
column after area resizing, with nulls in the same cases.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivano.llm.store import materialise, small_batches

TILE, FILL, TAIL = 24, 255, 32
_TOKEN = re.compile(rb"(?:\s|#[^\r\n]*[\r\n]?)*(\S+)")


def decode_netpbm(raw: bytes) -> np.ndarray:
    """P1 to P6 to an array of rows, columns and, for P3 and P6, three samples; bitmaps have 0 for black and 1 for white."""
    kind, at, numbers = raw[:2], 2, []
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _TOKEN.match(raw, at)
        if not m:
            raise ValueError("the header ends early")
        numbers.append(int(m[1]))
        at = m.end()
    width, height, top = (*numbers, 1)[:3]
    if not 0 < top < 65536:
        raise ValueError("the largest sample is out of range")
    shape = (height, width, 3) if kind in (b"P3", b"P6") else (height, width)
    count = int(np.prod(shape))
    sample = np.dtype(">u2") if top > 255 else np.dtype("u1")
    if kind == b"P1":
        digits = re.sub(rb"#[^\r\n]*|\s", b"", raw[at:])[:count]
        if digits.strip(b"01"):
            raise ValueError("a bitmap's samples are 0 and 1")
        return 1 - (np.frombuffer(digits, "u1") - 48).reshape(shape)
    if kind in (b"P2", b"P3"):
        return np.array(re.sub(rb"#[^\r\n]*", b"", raw[at:]).split()[:count], np.int64).astype(sample.newbyteorder("=")).reshape(shape)
    at += 1
    if kind == b"P4":
        rows = np.frombuffer(raw, "u1", height * ((width + 7) // 8), at).reshape(height, -1)
        return 1 - np.unpackbits(rows, axis=1)[:, :width]
    return np.frombuffer(raw, sample, count, at).reshape(shape).astype(sample.newbyteorder("="))


def encode_pgm(samples: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.astype("u1").tobytes()


def decode_bmp(raw: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits to rows from the top, columns and red, green, blue (alpha is left out)."""
    if raw[:2] != b"BM":
        raise ValueError("not a BMP image")
    start, header = struct.unpack_from("<II", raw, 10)
    if header == 12:
        width, height, _, bits = struct.unpack_from("<HHHH", raw, 18)
        packing, colours, entry = 0, 0, 3
    else:
        width, height, _, bits, packing = struct.unpack_from("<iiHHI", raw, 18)
        colours, entry = struct.unpack_from("<I", raw, 46)[0], 4
    if packing not in (0, 3) or packing == 3 and bits != 32 or bits not in (1, 4, 8, 24, 32):
        raise ValueError("compressed BMP images are not read")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    data = np.frombuffer(raw, "u1", rows * stride, start).reshape(rows, stride)
    data = data[::-1] if height > 0 else data
    if bits >= 24:
        return data[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1]
    palette = np.frombuffer(raw, "u1", (colours or 1 << bits) * entry, 14 + header).reshape(-1, entry)[:, 2::-1]
    if bits == 8:
        return palette[data[:, :width]]
    return palette[(np.unpackbits(data, axis=1)[:, :width] if bits == 1 else np.stack([data >> 4, data & 15], 2).reshape(rows, -1)[:, :width])]


def decode(raw: bytes) -> np.ndarray:
    """The image in the bytes of a Netpbm or BMP file; ValueError where they hold none."""
    try:
        image = decode_bmp(raw) if raw[:2] == b"BM" else decode_netpbm(raw)
    except (struct.error, IndexError, OverflowError, MemoryError) as e:
        raise ValueError(f"not an image: {e}") from e
    if not image.size:
        raise ValueError("the image has no samples")
    return image


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the exact areas that the new samples cover, from the image's integral."""
    image = image.mean(2) if image.ndim == 3 else image
    total = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    total[1:, 1:] = image.astype(np.float64).cumsum(0).cumsum(1)

    def at(table: np.ndarray, size: int, parts: int) -> np.ndarray:
        where = np.arange(parts + 1) * size / parts
        low = np.minimum(where.astype(np.int64), size - 1)
        return table[low] + (table[low + 1] - table[low]) * (where - low).reshape(-1, *[1] * (table.ndim - 1))

    rows = at(total, image.shape[0], height)
    cells = at(rows.T, image.shape[1], width).T
    return np.diff(np.diff(cells, axis=0), axis=1) * height * width / image.size


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hexadecimal: whether each of 8 rows of 9 resized samples rises to the right."""
    small = area_resize(image, 8, 9)
    return np.packbits(np.diff(small, axis=1) > 1e-9).tobytes().hex()


def to_tiles(image: np.ndarray, tile: int = TILE) -> bytes:
    """NPY bytes of the (tiles, tile, tile) array; the image's sides are filled up to multiples of tile with FILL."""
    high, wide, more = -image.shape[0] % tile, -image.shape[1] % tile, image.shape[2:]
    full = np.pad(image, ((0, high), (0, wide), *[(0, 0)] * len(more)), constant_values=FILL) if high or wide else image
    cut = full.reshape(full.shape[0] // tile, tile, full.shape[1] // tile, tile, *more).swapaxes(1, 2).reshape(-1, tile, tile, *more)
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(cut), allow_pickle=False)
    return out.getvalue()


def from_tiles(raw: bytes) -> np.ndarray:
    return np.load(io.BytesIO(raw), allow_pickle=False)


def store_text(text: str | None) -> bytes:
    payload = (text or "").encode()
    payload += bytes([FILL]) * (-len(payload) % (TILE * TILE) or (0 if payload else TILE * TILE))
    return to_tiles(decode(encode_pgm(np.frombuffer(payload, "u1").reshape(-1, TILE))))


def store(spark: SparkSession, text: Column) -> Column:
    """NPY tiles of a text."""
    small_batches(spark)

    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([store_text(x) for x in texts.to_pylist()], pa.binary())

    return run(text)


def _of_image(spark: SparkSession, image: Column, kind: str, made) -> Column:
    small_batches(spark)

    @F.arrow_udf(kind)
    def run(images: pa.Array) -> pa.Array:
        out = []
        for raw in images.to_pylist():
            try:
                out.append(None if raw is None else made(decode(raw)))
            except ValueError:
                out.append(None)
        return pa.array(out, pa.binary() if kind == "binary" else pa.string())

    return run(image)


def image_tiles(spark: SparkSession, image: Column, tile: int = TILE) -> Column:
    """NPY tiles (tiles, tile, tile and, in colour, 3) of a column of Netpbm or BMP files; null for what is no image."""
    return _of_image(spark, image, "binary", lambda x: to_tiles(x, tile))


def image_hash(spark: SparkSession, image: Column) -> Column:
    """The difference hash of a column of Netpbm or BMP files; null for what is no image."""
    return _of_image(spark, image, "string", difference_hash)


FEATURES = "struct<payload_bytes: long, payload_sha256: string, tail_crc32: long, feature: string>"


def features(spark: SparkSession, media: Column) -> Column:
    """Of stored tiles: the payload's size and digests and the image's difference hash."""
    small_batches(spark)

    @F.arrow_udf(FEATURES)
    def run(stored: pa.Array) -> pa.Array:
        found = []
        for raw in stored.to_pylist():
            tiles = from_tiles(raw)
            payload = tiles.tobytes()
            found.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), difference_hash(tiles.reshape(-1, TILE))))
        a, b, c, d = zip(*found) if found else ((), (), (), ())
        return pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.string()), pa.array(c, pa.int64()), pa.array(d, pa.string())], ["payload_bytes", "payload_sha256", "tail_crc32", "feature"])

    return run(media)


def write_texts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media of docs (doc_id, text), written to the shared folder and read from there."""
    return materialise(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), store(spark, F.col("text")).alias("media")), "media")
