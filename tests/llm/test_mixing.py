import numpy as np
from evidentia.llm import langid, mixing
from pyspark.sql import functions as F


def test_rates_are_the_nearest_to_one_that_meet_the_targets(spark):
    r = np.random.default_rng(4)
    p, t = r.dirichlet([0.4, 0.4, 0.4], 300), r.integers(1, 50, 300)
    target = np.array([0.1, 0.2, 0.7]) * t.sum()
    df = spark.createDataFrame([(x, n) for x, n in zip(p.tolist(), t.tolist(), strict=True)], "posteriors array<double>, tokens long")
    pushed, got = mixing.fit_rates(df, target, 1e-9)
    rate = mixing.rates(p, pushed)
    assert np.allclose(got, target) and np.allclose(p.T @ (rate * t), target)
    # Projections onto the targets and onto rates of zero or more, in turn (Dykstra), in the norm weighted by tokens.
    a, x, carried = p * np.sqrt(t)[:, None], np.sqrt(t).astype(float), np.zeros(300)
    for _ in range(20_000):
        x = x + a @ np.linalg.solve(a.T @ a, target - a.T @ x)
        y = np.maximum(0, x + carried)
        carried, x = x + carried - y, y
    assert np.allclose(x / np.sqrt(t), rate, atol=1e-3) and (rate == 0).any()


def test_query_meets_its_targets(spark):
    df = mixing.op4_query(spark, "/root/testdata/sf0.01").cache()
    names = [c[2:] for c in df.columns if c.startswith("p_")]
    got = df.agg(F.sum("tokens").alias("n"), *[F.sum(F.col("tokens") * F.col("rate") * F.col(f"p_{d}")).alias(d) for d in names], F.min("rate").alias("least"), F.count("*").alias("rows")).first()
    assert got["rows"] == 1000 and got["least"] >= 0
    for d in names:
        assert abs(got[d] - mixing.TARGETS[d] * got["n"]) <= 0.002 * mixing.TARGETS[d] * got["n"]


def test_edges(spark):
    df = spark.createDataFrame([(None, None, 7), (1, "", 7), (2, "good words here", 7), (2, "good words here", 7)], "doc_id long, text string, rate int")
    rows = mixing.mix(df, None).collect()
    assert [r["rate"] for r in rows] == [1.0] * 4 and [r["copies"] for r in rows] == [1] * 4
    model = langid.fit(["good words here now"] * 30 + ["bad things there"] * 30, ["good"] * 30 + ["poor"] * 30)
    assert mixing.mix(df, model).count() == 4 and mixing.mix(df.limit(0), model).count() == 0
    assert mixing.repeated(mixing.mix(df, None)).columns == ["doc_id", "text"]


def test_rare_domains_meet_their_targets(spark):
    r = np.random.default_rng(8)
    p, t = r.dirichlet([5, 5, 0.05], 5000), r.integers(1, 3001, 5000)
    df = spark.createDataFrame([(x, n) for x, n in zip(p.tolist(), t.tolist(), strict=True)], "posteriors array<double>, tokens long").coalesce(2).cache()
    target = np.array([0.75, 0.2, 0.05]) * t.sum()
    pushed, got = mixing.fit_rates(df, target)
    assert np.allclose((p * (mixing.rates(p, pushed) * t)[:, None]).sum(0), got) and (np.abs(got - target) <= 1.001e-3 * target).all()


def test_infeasible_targets_end_and_tell_the_miss(spark):
    df = spark.createDataFrame([([0.6, 0.4], 10), ([0.5, 0.5], 20)] * 20, "posteriors array<double>, tokens long").coalesce(1).cache()
    _, got = mixing.fit_rates(df, np.array([60.0, 540.0]))
    # Best with the second kind alone, where the squares, each in shares of its target, are least: s / 2 of both domains.
    s = 1 / (0.25 / 60 + 0.25 / 540)
    assert np.allclose(got, s / 2, rtol=0.1)


def test_query_meets_each_target_and_tells_the_miss(spark):
    df = mixing.op4_query(spark, "/root/testdata/sf0.01").cache()
    got = df.agg(F.sum("tokens").alias("n"), *[F.sum(F.col("tokens") * F.col("rate") * F.col(f"p_{d}")).alias(d) for d in mixing.TARGETS], *[F.max(f"miss_{d}").alias(f"miss_{d}") for d in mixing.TARGETS]).first()
    for d, share in mixing.TARGETS.items():
        assert abs(got[d] - share * got["n"]) <= 2e-3 * share * got["n"] and abs(got[d] / got["n"] - share - got[f"miss_{d}"]) < 1e-5
