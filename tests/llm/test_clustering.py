import hashlib
import math
import random

import numpy as np
import pytest

from evidentia.llm import clustering


def brute(rows, k, rounds, scale, dims, seed=3):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "~", r[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        at = [j for _, j in assign()]
        centroids = [[sum(c) // len(own) for c in zip(*own)] if (own := [v for (_, v), a in zip(kept, at) if a == j]) else old for j, old in enumerate(centroids)]
    return sorted((str(i), j, d) for (i, _), (d, j) in zip(kept, assign())), centroids


def random_rows(n, dims, seed, spread=1.0):
    rng = random.Random(seed)
    some = [[rng.uniform(-spread, spread) for _ in range(dims)] for _ in range(max(1, n // 3))]
    return [(i, rng.choice(some) if i % 2 else [rng.uniform(-spread, spread) for _ in range(dims)]) for i in range(n)]


@pytest.mark.parametrize("n,dims,k,spread", [(60, 2, 8, 0.004), (90, 3, 5, 1.0), (40, 64, 8, 0.3), (3, 2, 8, 1.0), (12, 1, 4, 0.003)])
def test_same_as_lloyd_by_brute_force(spark, n, dims, k, spread):
    """Small spreads give many ties, equal centroids and empty clusters."""
    rows = random_rows(n, dims, n, spread) + [(1, None), (2, []), (3, [float("nan")] * dims), (4, [math.inf] * dims), (5, [None] * dims), (6, [0.1] * (dims + 1)), (None, [0.0] * dims), (7, [0.25] * dims), (7, [0.25] * dims)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    state, centroids = clustering.sort_means(df, k=k, rounds=4, dimensions=dims)
    expected, want = brute(rows, k, 4, 1024, dims)
    assert centroids == want
    assert sorted((str(r["id"]), r["cluster"], r["distance"]) for r in state.collect()) == expected


def test_a_scan_skips_most_centroids_and_finds_the_same():
    rng = np.random.default_rng(1)
    centres = rng.integers(-5000, 5000, (40, 16))
    x = (centres[rng.integers(0, 40, 5000)] + rng.integers(-40, 40, (5000, 16))).astype(np.int64)
    order = clustering.Order(centres.tolist())
    near = ((x[:, None, :] - centres[None]) ** 2).sum(2)
    for start in (np.zeros(5000, np.int64), near.argmin(1)):
        best, distance, computed = order.assign(x, start)
        assert (best == near.argmin(1)).all() and (distance == near.min(1)).all()
    assert computed < 2 * len(x)  # from the right start, hardly any other centroid is looked at


def test_whole_table_against_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    expected, centroids = brute(rows, 8, 10, 1024, 64)
    got = clustering.op11_query(spark, "/root/testdata/sf0.01").collect()
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in got) == expected
    total = sum(d for _, _, d in expected)
    for r in got:
        assert r["inertia"] == total and r["cluster_inertia"] == sum(d for _, j, d in expected if j == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()


def test_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    state, centroids = clustering.sort_means(empty)
    assert state.count() == 0 and centroids == []
    df = spark.createDataFrame([(1, [0.5, 0.5], "a", 7, 8), (1, [0.5, 0.5], None, None, None), (2, [0.5], "b", 1, 2)], "vec_id long, embedding array<float>, x string, cluster int, id int")
    state, centroids = clustering.sort_means(df, dimensions=2)
    assert centroids == [[512, 512]] * 2 and {r["cluster"] for r in state.collect()} == {0}
    rows = clustering.cluster_table(df, centroids, dimensions=2).collect()
    assert sorted((r["vec_id"], str(r["x"]), str(r["id"]), str(r["cluster"]), str(r["distance"])) for r in rows) == [(1, "None", "None", "0", "0"), (1, "a", "8", "0", "0"), (2, "b", "2", "None", "None")]
    assert clustering.cluster_table(df, [], dimensions=2).where("cluster is null").count() == 3
    with pytest.raises(Exception, match="after scaling"):
        clustering.sort_means(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<float>"), dimensions=1)
