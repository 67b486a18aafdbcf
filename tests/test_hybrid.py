"""The stored hybrid index: fusion by hand, one filter on both arms, and what it refuses."""

import math

import pytest

from evidentia.operators import hybrid, index

ROWS = [
    (1, "a", "линия печати и линии", [1.0, 0.0]), (2, "a", "калибр кольца", [0.9, 0.1]), (3, "b", "печать линиями", [0.0, 1.0]),
    (4, "b", None, [0.7, 0.7]), (5, "a", "", [0.0, 0.0]), (6, "b", "линия", None), (7, None, "линия " * 3000, [-1.0, 0.0]),
]


@pytest.fixture(scope="module")
def stored(spark):
    path = index.folder(spark, "hybrid")
    hybrid.build(spark.createDataFrame(ROWS, "id int, kind string, body string, v array<double>"), "id", "body", "v", path, "model-2", ("kind",))
    return path


def by_hand(rows, query_stems, stems_of, vector, k, keep):
    """Ranks of both arms and their fusion, by plain loops."""
    docs = {i: stems_of(t) for i, _, t, _ in rows}
    avg = sum(map(len, docs.values())) / len(docs)
    df = {s: sum(s in d for d in docs.values()) for s in query_stems}
    told = {}
    for i, d in docs.items():
        hits = [s for s in query_stems if s in d]
        if hits and keep(i):
            told[i] = sum(math.log(1 + (len(docs) - df[s] + 0.5) / (df[s] + 0.5)) * d.count(s) * 2.5 / (d.count(s) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for s in hits)
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    cosine = {i: sum(a * b for a, b in zip(v, vector)) / (norm(v) * norm(vector)) if norm(v) else 0.0 for i, _, _, v in rows if v}
    out = {}
    for arm in ({i: c for i, c in cosine.items() if keep(i)}, told):
        for r, i in enumerate(sorted(arm, key=lambda i: (-round(arm[i], 12), i))[: max(4 * k, 20)], 1):
            out[i] = out.get(i, 0) + 1 / (60 + r)
    best = sorted(out, key=lambda i: (-out[i], i))[:k]
    return {i: (pytest.approx(out[i]), pytest.approx(cosine[i]) if i in cosine else None) for i in best}


@pytest.mark.parametrize("where,keep", [({}, lambda i: True), ({"kind": "a"}, lambda i: i in (1, 2, 5)), ({"kind": ["a", "b"]}, lambda i: i < 7), ({"kind": "x"}, lambda i: False)])
def test_fusion_and_filter_by_hand(spark, stored, where, keep):
    stems = {"линия": "лин", "линии": "лин", "линиями": "лин", "печати": "печ", "печать": "печ", "калибр": "калибр", "кольца": "кольц", "и": "и"}
    got = hybrid.search(spark, stored, "линию печати", [1.0, 0.2], "model-2", 4, where)
    assert got.columns == ["key", "score", "dense", "kind", "text"]
    asked = {"лин", "печ"}
    seen = {r["term"] for r in spark.read.parquet(f"{stored}/terms").collect()}
    assert asked <= seen
    expected = by_hand(ROWS, asked, lambda t: [stems[w] for w in (t or "").split()], [1.0, 0.2], 4, keep)
    assert {r["key"]: (r["score"], r["dense"]) for r in got.collect()} == expected


def test_another_embedder_or_dimension_is_refused(spark, stored):
    with pytest.raises(hybrid.Mismatch, match="build the index anew"):
        hybrid.search(spark, stored, "линия", [1.0, 0.0], "model-3", 2)
    with pytest.raises(hybrid.Mismatch, match="need not be built anew"):
        hybrid.search(spark, stored, "линия", [1.0, 0.0], "hashing-2", 2)
    with pytest.raises(hybrid.Mismatch, match="2 components, and the search one of 3"):
        hybrid.search(spark, stored, "линия", [1.0, 0.0, 0.0], "model-2", 2)


@pytest.mark.parametrize("odd,told", [([1.0], "between 1 and 2"), ([1.0, float("nan")], "no number")])
def test_unequal_vectors_are_refused(spark, odd, told):
    df = spark.createDataFrame([(1, "x", [1.0, 2.0]), (2, "y", odd)], "id int, body string, v array<double>")
    with pytest.raises(hybrid.Mismatch, match=told):
        hybrid.build(df, "id", "body", "v", index.folder(spark, "hybrid"), "m")


def test_empty_table(spark):
    path = index.folder(spark, "hybrid")
    hybrid.build(spark.createDataFrame([], "id int, body string, v array<float>"), "id", "body", "v", path, "m")
    assert hybrid.search(spark, path, "линия", [1.0], "m", 3).count() == 0
