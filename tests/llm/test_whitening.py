import math
import random
from fractions import Fraction

import numpy as np
import pytest

from evidentia.llm import whitening

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, components=4, scale=256):
    kept = [(i, [math.floor(scale * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(v) for _, v in kept})
    n, d = len(fit), len(fit[0])
    s = [sum(c) for c in zip(*fit)]
    centred = [[Fraction(n * x - t, n) for x, t in zip(v, s)] for v in fit]
    cov = np.array([[float(sum(v[i] * v[j] for v in centred) / n) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = {}
    for i, v in kept:
        y = np.array([float(Fraction(n * x - t, n)) for x, t in zip(v, s)])
        out[i] = (sum((n * x - t) ** 2 for x, t in zip(v, s)), y @ vectors / np.sqrt(values))
    return n, out, values / np.trace(cov)


def same(got, expected, explained):
    for k in range(len(explained)):
        a = np.array([r["whitened"][k] for r in got])
        b = np.array([expected[r["id"]][1][k] for r in got])
        assert np.allclose(a, b, rtol=1e-8, atol=1e-8) or np.allclose(a, -b, rtol=1e-8, atol=1e-8)
    assert all(int(r["deviation"]) == expected[r["id"]][0] for r in got)


@pytest.mark.parametrize("n,d,tile,offset", [(200, 5, 2, 0.0), (300, 7, 3, 1e6), (90, 4, 16, 1e11), (9, 3, 1, -2.0)])
def test_against_exact_fractions(spark, n, d, tile, offset):
    """With a mean far from zero too, where centring after multiplying would lose all digits."""
    rng = random.Random(n)
    scale = [3.0 * (k + 1) for k in range(d)]
    rows = [(i, [offset + rng.gauss(0, s) for s in scale]) for i in range(n)]
    rows += [(n + i, rows[i % 3][1]) for i in range(n // 2)]
    odd = [(-1, None), (-2, [math.nan] * d), (-3, [math.inf] * d), (-4, [None] * d), (-5, [1.0] * (d + 1)), (-6, [])]
    df = spark.createDataFrame(rows + odd, SCHEMA).repartition(3)
    out, model, error = whitening.whiten(df, tile=tile, components=3)
    count, expected, explained = brute(rows, 3)
    got = out.collect()
    assert model.n == count == n and sorted(r["id"] for r in got) == list(range(len(rows)))
    same(got, expected, explained)
    assert np.allclose(model.explained(), explained, rtol=1e-9) and error < 1e-6


def test_products_are_exact():
    rng = np.random.default_rng(2)
    for most in (10, 1 << 24, 1 << 29, 1 << 47):
        a, b = rng.integers(-most, most, (50, 3)), rng.integers(-most, most, (50, 2))
        assert (whitening.product(a, b) == a.astype(object).T @ b.astype(object)).all()


def test_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    n, expected, explained = brute(rows)
    got = whitening.op12_query(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 4 * len(rows) and {r["component"] for r in got} == {1, 2, 3, 4} and {r["n"] for r in got} == {n}
    assert all(r["deviation"] == expected[r["vec_id"]][0] and r["identity_error"] < 1e-9 for r in got)
    for k in range(1, 5):
        own = [r for r in got if r["component"] == k]
        a, b = np.array([r["whitened"] for r in own]), np.array([expected[r["vec_id"]][1][k - 1] for r in own])
        assert np.allclose(a, b, atol=1e-8) or np.allclose(a, -b, atol=1e-8)
        assert all(abs(r["explained"] - explained[k - 1]) < 1e-9 for r in own)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(empty)[0].count() == 0
    alike = spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0]), (None, [0.5, 1.0])], SCHEMA)
    assert whitening.whiten(alike)[0].count() == 0  # no variance, no component
    line = spark.createDataFrame([(None, [0.0, 0.0], "u", "v"), (1, [1.0, 1.0], None, None), (1, [1.0, 1.0], "x", "y")], SCHEMA + ", x string, whitened string")
    out, model, error = whitening.whiten(line)
    got = out.collect()
    assert len(model.values) == 1 and error < 1e-9 and sorted(abs(r["whitened"][0]) for r in got) == pytest.approx([1, 1, 1]) and len(got) == 3
    with pytest.raises(Exception, match="after scaling"):
        whitening.whiten(spark.createDataFrame([(1, [1e30])], SCHEMA))
