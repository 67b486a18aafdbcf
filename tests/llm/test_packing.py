import zlib

import numpy as np
import public_tokenizers
from evidentia.llm import packing
from tokenizers import Tokenizer


def test_every_id_once_and_no_gaps(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows, by_doc, by_sequence = packing.op6_query(spark, "/root/testdata/sf0.001").collect(), {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(docs)
    for i, own in by_doc.items():
        ids, at = [*t.encode(docs[i] or "", add_special_tokens=False).ids, 2], 0
        for k, r in enumerate(sorted(own, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            assert r["length"] == 1024 or k == 0
            at += r["length"]
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by_sequence) <= -(-sum(r["length"] for r in rows) // 1024) * 1.02 + 1


def test_ids_are_those_of_tokenizers():
    t, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder()
    texts = ["", " ", "  \n\n\t x  ", "a<|endoftext|>b", "ñandú ’s it's I'LL 123abc", "\0\x01 \u00a0\u2003x", "日本語 🙂🙂", "x" * 3000, "=-" * 900, "\r\n  \r\n", "e\u0301 \ufeff"]
    for x in texts:
        assert encode(x) == t.encode(x, add_special_tokens=False).ids


def test_plan_is_optimal_on_small_cases():
    def brute(sizes, limit):
        best = len(sizes)

        def go(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(sizes):
                best = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + sizes[i] <= limit:
                    bins[k] += sizes[i]
                    go(i + 1, bins)
                    bins[k] -= sizes[i]
            go(i + 1, [*bins, sizes[i]])

        go(0, [])
        return best

    r = np.random.default_rng(3)
    for _ in range(300):
        sizes = sorted(r.integers(1, 21, 9).tolist(), reverse=True)
        size, first, times, sequence, _ = packing.plan(np.bincount(sizes, minlength=21), 20)
        assert int((sequence + times).max()) == brute(sizes, 20)
        assert times.sum() == 9
    hard = [51, 51, 48, 48, 45, 43, 38, 38, 34, 32, 31, 24]
    assert packing.complete(np.bincount(hard, minlength=101), 100).sequences == 5


def plain_best_fit(sizes, limit):
    left = []
    for size in sorted(sizes, reverse=True):
        at = min((i for i, r in enumerate(left) if r >= size), key=left.__getitem__, default=None)
        if at is None:
            left.append(limit - size)
        else:
            left[at] -= size
    return len(left)


def test_never_worse_than_best_fit_and_the_bound_holds():
    r = np.random.default_rng(5)
    for n, low, high, limit in [(500, 1, 1025, 1024), (500, 200, 700, 1024), (500, 1, 120, 1024), (2000, 1, 60, 64), (30, 1, 21, 20), (1, 5, 6, 20)] * 3:
        sizes = r.integers(low, high, n)
        counts = np.bincount(sizes, minlength=limit + 1)
        got = packing.complete(counts, limit, 20_000)
        used = np.zeros(limit + 1, np.int64)
        for pattern, times in got.patterns:
            assert sum(pattern) <= limit and times > 0
            np.add.at(used, list(pattern), times)
        assert (used == counts).all() and packing.least(counts, limit) <= got.sequences <= plain_best_fit(sizes.tolist(), limit)
        assert sum(n for _, n in packing.best_fit(counts, limit)) == plain_best_fit(sizes.tolist(), limit)


def test_whole_table_is_within_two_of_the_bound(spark):
    rows = packing.op6_query(spark, "/root/testdata/sf0.01").select("length", "sequence_id").collect()
    counts = np.bincount([r["length"] for r in rows], minlength=1025)
    assert packing.least(counts, 1024) <= len({r["sequence_id"] for r in rows}) <= min(964, packing.least(counts, 1024) + 2)


def test_ids_of_random_strings_are_those_of_tokenizers():
    t, encode, r = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder(), np.random.default_rng(8)
    alphabet = [*"abAB01 \n\t'.,-", "'s", "é", "ß", "\u00a0", "\u200b", "\u2028", "\ufeff", "日", "🙂", "\u0301", "١", "Ⅷ", "<|endoftext|>"]
    for _ in range(3000):
        x = "".join(r.choice(alphabet, r.integers(0, 30)))
        assert encode(x) == t.encode(x, add_special_tokens=False).ids


def test_edges(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "", 1), (2, "the " * 5000, 1)], "doc_id long, text string, start int")
    got = packing.pack_documents(df).collect()
    assert sorted(r["length"] for r in got)[:3] == [1, 1, 1] and len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_a_very_long_run_of_white_space_is_encoded_whole(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a" + " " * 1_000_000 + "b", "a" + "\n" * 1_000_000 + "b"]
    rows = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    for i, x in enumerate(texts):
        ids, at = [*t.encode(x, add_special_tokens=False).ids, 2], 0
        for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
