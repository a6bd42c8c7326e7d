"""Media columns: payload bytes as greyscale PNG images, read back and hashed.

A payload is stored as an 8-bit greyscale PNG of ``WIDTH`` samples a row: rows
are filtered (None, Sub or Up, by the smallest sum of absolute residuals), the
filtered stream is deflated by zlib and cut into IDAT chunks, each with its CRC.
The reader walks the chunks, tests every checksum, inflates, undoes all five PNG
filters in numpy and compares sizes with the header. From the pixels read back
come digests and a 64-bit hash of the low-frequency cosine transform.

Defined results: null texts are empty, so one row of 255s. Equal payloads give
equal images, digests and hashes. Repeated rows give one result each. A damaged
image raises ``MediaError``; ``read_png`` never returns pixels whose checksum is
wrong. Long texts become tall images and are handled one at a time, in batches
bounded by bytes. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, workers

WIDTH = 576
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHUNK_BYTES = 1 << 16
#: Rows and columns of cosine coefficients that are kept.
LOW = 8


class MediaError(ValueError):
    """The stored bytes aren't the image that was written."""


def png_chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(payload: bytes, width: int = WIDTH, level: int = 6) -> bytes:
    """A greyscale PNG of ``payload``, whose size is a positive multiple of ``width``."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, width)
    left = np.zeros_like(pixels)
    left[:, 1:] = pixels[:, :-1]
    up = np.zeros_like(pixels)
    up[1:] = pixels[:-1]
    choices = np.stack([pixels, pixels - left, pixels - up])
    cost = np.abs(choices.view(np.int8).astype(np.int32)).sum(2)
    best = cost.argmin(0)
    stream = np.empty((len(pixels), width + 1), np.uint8)
    stream[:, 0] = best
    stream[:, 1:] = choices[best, np.arange(len(pixels))]
    packed = zlib.compress(stream.tobytes(), level)
    header = struct.pack(">IIBBBBB", width, len(pixels), 8, 0, 0, 0, 0)
    body = b"".join(png_chunk(b"IDAT", packed[i : i + CHUNK_BYTES]) for i in range(0, len(packed), CHUNK_BYTES))
    return SIGNATURE + png_chunk(b"IHDR", header) + body + png_chunk(b"IEND", b"")


def unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undo PNG filters None, Sub, Up, Average and Paeth for one byte a sample."""
    out = np.empty_like(rows)
    above = np.zeros(rows.shape[1], np.uint8)
    for y, kind in enumerate(kinds):
        if kind == 0:
            out[y] = rows[y]
        elif kind == 1:
            out[y] = np.cumsum(rows[y], dtype=np.uint8)
        elif kind == 2:
            out[y] = rows[y] + above
        elif kind in (3, 4):
            a = c = 0
            for x, (value, b) in enumerate(zip(rows[y].tolist(), above.tolist(), strict=True)):
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                    c = b
                a = out[y, x] = (value + guess) & 255
                a = int(a)
        else:
            raise MediaError(f"row {y} has filter {kind}")
        above = out[y]
    return out


def read_png(blob: bytes) -> np.ndarray:
    """The pixels of an 8-bit greyscale PNG, every checksum tested."""
    if blob[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at, header, packed, ended = 8, b"", [], False
    while at < len(blob) and not ended:
        if at + 12 > len(blob):
            raise MediaError("a chunk is cut off")
        (size,), kind = struct.unpack(">I", blob[at : at + 4]), blob[at + 4 : at + 8]
        data, crc = blob[at + 8 : at + 8 + size], blob[at + 8 + size : at + 12 + size]
        if len(crc) < 4 or struct.unpack(">I", crc)[0] != zlib.crc32(kind + data):
            raise MediaError(f"the checksum of {kind!r} is wrong")
        if kind == b"IHDR":
            header = data
        elif kind == b"IDAT":
            packed.append(data)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise MediaError(f"critical chunk {kind!r} is not known")
        at += 12 + size
    if not ended or len(header) != 13:
        raise MediaError("IHDR or IEND is missing")
    width, height, *form = struct.unpack(">IIBBBBB", header)
    if form != [8, 0, 0, 0, 0]:
        raise MediaError("not 8-bit greyscale without interlace")
    try:
        stream = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error as e:
        raise MediaError(str(e)) from e
    if len(stream) != height * (width + 1):
        raise MediaError("the pixels don't fill the header's size")
    stream = stream.reshape(height, width + 1)
    return unfilter(stream[:, 0], stream[:, 1:])


def cosines(n: int, low: int = LOW) -> np.ndarray:
    return np.cos(np.pi * (np.arange(n) + 0.5)[None, :] * np.arange(low)[:, None] / n)


ACROSS = cosines(WIDTH)


def cosine_hash(pixels: np.ndarray) -> bytes:
    """64 bits: which low-frequency coefficients exceed their median; the first, the mean, is left out of it."""
    across = ACROSS if pixels.shape[1] == WIDTH else cosines(pixels.shape[1])
    coefficients = np.rint((cosines(len(pixels)) @ (pixels @ across.T)) / pixels.size * 1e6).ravel()
    return np.packbits(coefficients > np.median(coefficients[1:])).tobytes()


def media_row(text: str | None) -> tuple:
    raw = (text or "").encode("utf-8", "surrogatepass")
    payload = raw + b"\xff" * ((-len(raw)) % WIDTH or WIDTH * (not raw))
    stored = write_png(payload)
    pixels = read_png(stored)
    back = pixels.tobytes()
    mark = cosine_hash(pixels)
    return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), mark.hex(), mark, stored


FIELDS = [
    ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()),
    ("media_sha256", pa.string()), ("feature", pa.string()), ("cosine_hash", pa.binary()), ("media", pa.binary()),
]


def media_columns(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: sizes, digests and hashes, and on demand the PNG itself."""
    workers.ship(__name__)
    fields = FIELDS if with_media else FIELDS[:-1]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [media_row(t.as_py())[: len(fields)] for t in batch.column("text")]
            columns = list(zip(*rows, strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True))], ["doc_id", *(n for n, _ in fields)])

    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    source = docs.select("doc_id", "text")
    return source.mapInArrow(encode, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} {kinds[t]}" for n, t in fields))
