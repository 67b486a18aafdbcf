import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from evidentia.llm import maxent

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def base(train, texts):
    """(tokens, known, base score) of each text, and the tokens in training."""
    c = Counter(w for t in train for w in [*words(t), ""])
    n, v = sum(c.values()), len(c)
    out = []
    for t in texts:
        own = [*words(t), ""]
        out.append((len(own), sum(c[w] > 0 for w in own), sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)))
    return out, c


def test_tokens_of_whole_slices():
    texts = [" A b\tC\n\n", None, "", "ÄÀ É x", "\x0b\x0c\r", "z" * 70_000 + " Z", "a  a"] * 3
    for a, b in ((0, 21), (3, 9), (20, 21), (5, 5)):
        codes, names, offsets = maxent.tokens(pa.array(texts).slice(a, b - a))
        got = [[names[int(c)].as_py() for c in codes[i:j]] for i, j in zip(offsets[:-1], offsets[1:])]
        assert got == [words(t) for t in texts[a:b]]


def by_hand(vocab, model, counts, text):
    """The model's log10 probability of a text, a token at a time, by plain loops over its weights."""
    m64 = (1 << 64) - 1
    mix = [int(x) for x in maxent._MIX]
    place = {w.as_py(): i for i, w in enumerate(vocab.words.slice(0, vocab.model_words))}
    keys, total = [1, 1, 1], 0.0
    for w in [*words(text), ""]:
        a, b, c = keys[-1], keys[-2], keys[-3]
        hashes = [a * mix[0] & m64, (a * mix[1] + b * mix[2]) & m64, b * mix[3] & m64, c * mix[4] & m64]
        hashes = [(h ^ h >> 29) * mix[5] & m64 for h in hashes]

        def chosen(table, rows, bias, y):
            z = [float(bias[j]) + sum(float(model.tables[table][r][j]) for r in rows) for j in range(len(bias))]
            return z[y] - math.log(sum(math.exp(x - max(z)) for x in z)) - max(z)

        i = place.get(w, -1)
        k = i // model.width + 1 if i >= 0 else 0
        total += chosen(0, [h >> 64 - model.bits for h in hashes], model.class_bias, k)
        if i >= 0:
            total += chosen(1, [((h + k * mix[2]) * mix[1] & m64) >> 64 - model.bits for h in hashes], model.word_bias[k], i % model.width)
        else:
            total += math.log((counts[w] + 0.1) / vocab.rest)
        keys.append(zlib.crc32(w.encode()) + 2)
    return total / math.log(10)


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", maxent.held_out().alias("held_out"))
    model = maxent.fit_maxent(docs.where("not held_out"), known=300, classes=6, width=5, bits=10)
    return docs, model


def test_scores_against_plain_loops(spark, trained):
    docs, (counts, vocab, model) = trained
    rows = docs.collect()
    assert {r["doc_id"] for r in rows if r["held_out"]} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0}
    expected, c = base([r["text"] for r in rows if not r["held_out"]], [r["text"] for r in rows])
    got = {r["doc_id"]: r for r in maxent.score(docs, counts, vocab, model).collect()}
    assert vocab.total == sum(c.values()) and len(got) == len(rows) and any(t.any() for t in model.tables)
    for r, (n, known, score) in zip(rows, expected):
        out = got[r["doc_id"]]
        assert (out["n_tokens"], out["n_known"]) == (n, known) and out["base_score"] == pytest.approx(score, rel=1e-9)
    for r in rows[:25]:
        assert got[r["doc_id"]]["score"] == pytest.approx(by_hand(vocab, model, c, r["text"]), rel=1e-4)


def test_probabilities_add_up_to_one(trained):
    _, (counts, vocab, model) = trained
    keys = np.array([1, 1, 1, 7, 9, 11, 0], np.uint64)
    for at in (3, 4, 6):
        ids = np.arange(-1, vocab.model_words)
        p = 10 ** model.log10(keys, np.full(len(ids), at), ids)
        assert p.sum() == pytest.approx(1, abs=1e-5)
    listed = {r["word"]: r["n"] for r in counts.collect()}
    named = {w.as_py() for w in vocab.words.slice(0, vocab.model_words)}
    assert sum(n + 0.1 for w, n in listed.items() if w not in named) + 0.1 == pytest.approx(vocab.rest)


def test_without_training_it_is_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    counts, vocab, model = maxent.fit_maxent(docs, rounds=0)
    for r in maxent.score(docs, counts, vocab, model).collect():
        assert r["score"] == pytest.approx(r["base_score"], rel=1e-5)


def test_learns_order_and_gains_on_held_out_texts(spark):
    rows = [(i, " ".join("one two three four five".split()[(i + j) % 5] for j in range(40))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = maxent.fit_maxent(df.where("doc_id < 500"))
    got = maxent.score(df.where("doc_id >= 500"), *model).collect()
    assert all(r["score"] > 0.5 * r["base_score"] for r in got)
    held = maxent.op13_query(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r["score"] for r in held) > 0.97 * sum(r["base_score"] for r in held) and all(r["score"] <= 0 for r in held)


def test_edges(spark):
    schema = "doc_id long, text string, score string, n int, word string"
    rows = [(None, None, "s", 1, "u"), (None, "", None, None, None), (1, "a b", "s", 2, "v"), (1, "a b", "s", 2, "v"), (2, "q " * 200_000, "t", 3, "w"), (3, "never " * 3, None, None, "x")]
    df = spark.createDataFrame(rows, schema)
    fitted = maxent.fit_maxent(df.where("doc_id < 3"), known=2)
    got = maxent.score(df, *fitted)
    assert got.columns == ["doc_id", "n", "word", "n_tokens", "n_known", "base_score", "score"]
    out = sorted(got.collect(), key=lambda r: (r["n_tokens"], str(r["word"]), r["base_score"]))
    expected, _ = base(["a b", "a b", "q " * 200_000], [r[1] for r in rows])
    assert sorted((r["n_tokens"], r["n_known"]) for r in out) == sorted(e[:2] for e in expected)
    assert sorted(r["base_score"] for r in out) == pytest.approx(sorted(e[2] for e in expected))
    empty = spark.createDataFrame([], schema)
    assert maxent.score(empty, *fitted).count() == 0
    nothing = maxent.fit_maxent(empty)
    for r in maxent.score(df, *nothing).collect():  # no training: every token is unseen
        assert r["n_known"] == 0 and r["base_score"] == pytest.approx(0, abs=1e-3) and math.isfinite(r["score"])
