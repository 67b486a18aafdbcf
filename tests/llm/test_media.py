import hashlib
import zlib

import numpy as np
import pytest
from evidentia.llm import media


def test_query_round_trip(spark):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in media.op10_query(spark, "/root/testdata/sf0.001").collect():
        raw = docs[r["doc_id"]]
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-64:])


def test_all_filters_are_undone():
    r = np.random.default_rng(1)
    image = r.integers(0, 256, (40, 16), np.uint8)
    kinds, lines = np.arange(40, dtype=np.uint8) % 5, np.empty_like(image)
    for y in range(40):
        for x in range(16):
            a = int(image[y, x - 1]) if x else 0
            b = int(image[y - 1, x]) if y else 0
            c = int(image[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            paeth = min((abs(p - v), i, v) for i, v in enumerate((a, b, c)))[2]
            lines[y, x] = (int(image[y, x]) - [0, a, b, (a + b) // 2, paeth][kinds[y]]) & 255
    assert (media._unfilter(kinds, lines) == image).all()


def test_damage_is_found(spark):
    good = media.encode_png(b"abc" * 64)
    for at in range(0, len(good), 7):
        bad = good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :]
        with pytest.raises(media.BadMedia):
            media.decode_png(bad)
    rows = media.read_png(spark.createDataFrame([(bytearray(good),), (None,), (bytearray(good[:-5]),)], "media binary")).collect()
    assert rows[0]["media_error"] is None and bytes(rows[0]["payload"]) == b"abc" * 64
    assert rows[1]["media_error"] == "null" and rows[2]["payload"] is None


def test_null_empty_and_equal_texts(spark):
    got = media.read_png(media.store_as_png(spark.createDataFrame([(None, 1), ("", 1), ("ü", 1), ("ü", 1)], "text string, media int"))).collect()
    assert bytes(got[0]["payload"]) == bytes(64) == bytes(got[1]["payload"]) and got[2] == got[3]
