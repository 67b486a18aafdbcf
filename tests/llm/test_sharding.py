import numpy as np
from evidentia.llm import sharding


def test_every_row_once_and_exact_sizes(spark):
    df = spark.range(1003).selectExpr("id % 50 as doc_id", "cast(null as string) as slot", "id").repartition(7)
    got = sharding.hypergeometric_shards(df, 16, cell_rows=20).collect()
    assert sorted(r["id"] for r in got) == list(range(1003))
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sharding.hypergeometric_shards(df.limit(0)).count() == 0


def test_matrix_margins():
    sizes, cells = np.array([10, 0, 25, 7]), np.array([20, 22])
    m = np.array([sharding.matrix_row(sizes, cells, p, 3) for p in range(4)])
    assert (m.sum(1) == sizes).all() and (m.sum(0) == cells).all()


def test_uniform():
    n, hits = 400, np.zeros(2)
    for seed in range(n):
        hits += sharding.matrix_row(np.array([4, 12]), np.array([8, 8]), 0, seed)
    assert abs(hits[0] / n - 2) < 0.2


def test_ids_beside_nulls_stay_exact(spark):
    ids = [None, 2**53 + 1, 2**60 + 7, -5]
    df = spark.createDataFrame([(i, "u", 4, b"x") for i in ids], "doc_id long, _p string, _cell int, __part binary")
    got = sharding.hypergeometric_shards(df, 2)
    assert got.columns == [*df.columns, "shard", "slot"]
    rows = got.collect()
    assert sorted((r["doc_id"] for r in rows), key=repr) == sorted(ids, key=repr)
    assert all((r["_p"], r["_cell"], bytes(r["__part"])) == ("u", 4, b"x") for r in rows)


def test_large_populations_follow_the_law(monkeypatch):
    for good, bad, sample, most in ((10**12, 3 * 10**12, 10**11, None), (700, 300, 90, 10)):
        if most:
            monkeypatch.setattr(sharding, "NUMPY_MOST", most)
        draws = np.array([sharding._hypergeometric(np.random.default_rng(s), good, bad, sample) for s in range(60 if not most else 3000)], float)
        n = good + bad
        mean, sd = sample * good / n, (sample * good / n * bad / n * (n - sample) / (n - 1)) ** 0.5
        assert abs(draws.mean() - mean) < 5 * sd / len(draws) ** 0.5 and 0.6 < draws.std() / sd < 1.4


def test_query_meets_its_contract(spark):
    import zlib

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = sharding.op7_query(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in rows} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode()), "rows", None) for i, t in docs.items()}
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(by) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
