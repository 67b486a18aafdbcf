"""Media columns: PNG images in binary columns, read back with checksum tests, and hashes of their low frequencies.

The stored form is 8-bit greyscale PNG: an IHDR, one zlib stream in IDAT
chunks and an IEND, each chunk with its CRC-32. Rows of the image are filtered
with None, Sub or Up, whichever leaves the smallest sum of absolute
differences. Reading tests the signature, every chunk's CRC, the zlib
stream's own checksum and the size, and undoes all five filters.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
IDAT_BYTES = 1 << 20
#: Images are made smooth to EDGE x EDGE before the transform; LOW x LOW coefficients make the hash.
EDGE, LOW = 32, 8
#: Rows of one output batch hold at most about this many payload bytes.
BATCH_BYTES = 8 << 20


class BadMedia(ValueError):
    """The stored bytes are no PNG of this kind, or a checksum fails."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """A greyscale PNG whose samples are ``payload``; its length is a positive multiple of ``width``."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    sub, up = rows.copy(), rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    cost = [np.abs(x.view(np.int8).astype(np.int16)).sum(1, dtype=np.int64) for x in (rows, sub, up)]
    kind = np.argmin(cost, 0).astype(np.uint8)
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = np.where((kind == 0)[:, None], rows, np.where((kind == 1)[:, None], sub, up))
    packed = zlib.compress(lines.tobytes(), level)
    parts = [_chunk(b"IDAT", packed[i : i + IDAT_BYTES]) for i in range(0, len(packed), IDAT_BYTES)]
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + b"".join(parts) + _chunk(b"IEND", b"")


def _unfilter(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Undo the row filters. Sub rows and runs of Up rows are sums modulo 256; Average and Paeth go sample by sample."""
    out = lines.copy()
    sub = kinds == 1
    out[sub] = np.cumsum(lines[sub], axis=1, dtype=np.uint8)
    y, n, width = 0, len(lines), lines.shape[1]
    zero = np.zeros(width, np.uint8)
    needs = np.flatnonzero(kinds >= 2)
    while len(needs):
        y = int(needs[0])
        above = out[y - 1] if y else zero
        if kinds[y] == 2:
            stop = y + int(np.argmax(np.append(kinds[y:] != 2, True)))
            out[y:stop] = np.cumsum(np.vstack([above[None], lines[y:stop]]), axis=0, dtype=np.uint8)[1:]
        elif kinds[y] in (3, 4):
            stop, left, corner, row = y + 1, 0, 0, out[y]
            for x in range(width):
                b = int(above[x])
                if kinds[y] == 3:
                    guess = (left + b) // 2
                else:
                    p = left + b - corner
                    pa_, pb, pc = abs(p - left), abs(p - b), abs(p - corner)
                    guess = left if pa_ <= pb and pa_ <= pc else b if pb <= pc else corner
                left = (int(lines[y, x]) + guess) & 255
                row[x] = left
                corner = b
        else:
            raise BadMedia(f"filter {kinds[y]}")
        needs = needs[np.searchsorted(needs, stop) :]
    return out


def decode_png(media: bytes) -> np.ndarray:
    """The samples, height x width; BadMedia if anything is wrong with the bytes."""
    if media[:8] != SIGNATURE:
        raise BadMedia("signature")
    at, size, parts, ended = 8, None, [], False
    while at + 12 <= len(media) and not ended:
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if len(body) != n or media[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + body)):
            raise BadMedia(f"checksum of {kind!r}")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if not ended or size is None or size[2:] != (8, 0, 0, 0, 0):
        raise BadMedia("header or end")
    width, height = size[:2]
    try:
        raw = zlib.decompress(b"".join(parts))
    except zlib.error as e:
        raise BadMedia(str(e)) from e
    if len(raw) != height * (width + 1):
        raise BadMedia("size")
    lines = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    return _unfilter(lines[:, 0], lines[:, 1:])


def _cosines(n: int, k: int) -> np.ndarray:
    c = np.cos(np.pi * (2 * np.arange(n) + 1)[None] * np.arange(k)[:, None] / (2 * n)) * np.sqrt(2 / n)
    c[0] /= np.sqrt(2)
    return c


_LOW = _cosines(EDGE, LOW)


def _shrink(image: np.ndarray, n: int) -> np.ndarray:
    """Means over n bands of rows; an image with fewer rows repeats them."""
    h = len(image)
    if h >= n:
        at = np.arange(n) * h // n
        return np.add.reduceat(image, at, axis=0, dtype=np.float64) / np.diff(np.append(at, h))[:, None]
    return image[np.arange(n) * h // n].astype(np.float64)


def cosine_hash(image: np.ndarray) -> str:
    """16 hex digits: which of the LOW x LOW lowest cosine coefficients lie above their median (the mean is left out of it)."""
    small = _shrink(_shrink(image, EDGE).T, EDGE).T
    low = (_LOW @ small @ _LOW.T).round(6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def _binary(df: DataFrame, fn, fields: list[T.StructField], source: str) -> DataFrame:
    """Adds the columns that ``fn`` makes of each value of ``source``, batch by batch of bounded bytes."""
    added = [f.name for f in fields]
    kinds = [pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.string() for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(source))
            lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
            for a, b in common.chunks(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), BATCH_BYTES):
                rows = [fn(x.as_py()) for x in column.slice(a, b - a)]
                made = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, *added])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def store_as_png(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with binary column ``media``: each text's UTF-8 bytes (null: none), zeros up to a positive multiple of 64, as PNG.

    Equal texts give equal media. Rows are kept as they are; a column named
    media is replaced. A text is one image, held by one task.
    """
    df = common.without(df, "media")

    def store(value) -> tuple:
        raw = (value or "").encode() if not isinstance(value, bytes) else value
        return (encode_png(raw + bytes(-len(raw) % WIDTH if raw else WIDTH)),)

    return _binary(df, store, [T.StructField("media", T.BinaryType())], text)


def read_png(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with ``payload`` (the samples' bytes), ``feature`` (the cosine hash) and ``media_error``.

    Null media or bytes that fail a test give null payload and feature and say
    why in media_error; other rows have none.
    """
    df = common.without(df, "payload", "feature", "media_error")

    def read(value) -> tuple:
        if value is None:
            return None, None, "null"
        try:
            image = decode_png(value)
        except BadMedia as e:
            return None, None, str(e)
        return image.tobytes(), cosine_hash(image), None

    fields = [T.StructField("payload", T.BinaryType()), T.StructField("feature", T.StringType()), T.StructField("media_error", T.StringType())]
    return _binary(df, read, fields, media)


def op10_query(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    stored = store_as_png(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "media")
    return read_png(stored).select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
