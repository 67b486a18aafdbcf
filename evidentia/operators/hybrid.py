"""A stored index of texts and vectors that is searched by both, under one filter.

It is a folder of Parquet tables: ``records`` (key, the filter columns, text,
vector), the tables of ``index`` for the terms of the whole texts, and ``info``,
one row of properties that every search checks: whose vectors these are, and of
which dimension. Vectors of different embedders mean different things, so a
search by another one is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import index, lookup, retrieval

#: How the names of embedders that stand in for others begin.
FALLBACK = "hashing"


class Mismatch(ValueError):
    """The index can't be searched so."""


def build(df: DataFrame, key: str, column: str, vector: str, path: str, embedder: str, filters: tuple[str, ...] = (), buckets: int = 64) -> None:
    """Write the index of ``df`` to ``path``. All vectors must have one dimension; rows with a null vector are found by their text alone."""
    spark, v = df.sparkSession, F.col(f"`{vector}`")
    size = df.where(v.isNotNull()).agg(F.min(F.size(v)).alias("low"), F.max(F.size(v)).alias("high"), F.count_if(F.exists(v, lambda x: x.isNull() | F.isnan(x))).alias("odd")).first()
    if size["low"] != size["high"]:
        raise Mismatch(f"vectors have between {size['low']} and {size['high']} components")
    if size["odd"]:
        raise Mismatch(f"{size['odd']} vectors have a component that is no number")
    records = df.select(F.col(f"`{key}`").alias("key"), *[F.col(f"`{c}`") for c in filters], F.col(f"`{column}`").alias("text"), v.cast("array<double>").alias("vector"))
    records.write.parquet(f"{path}/records")
    stored = spark.read.parquet(f"{path}/records")
    index.build(stored, "key", "text", path, buckets)
    found = stored.agg(F.lit(embedder).alias("embedder"), F.lit(size["low"] or 0).alias("dimension"), F.lit(buckets).alias("buckets"), F.count("*").alias("documents"))
    found.coalesce(1).write.parquet(f"{path}/info")


def checked(spark: SparkSession, path: str, embedder: str, dimension: int) -> dict:
    """The index's properties, or an error that says what to do."""
    info = spark.read.parquet(f"{path}/info").first().asDict()
    built = info["embedder"]
    if built != embedder and embedder.startswith(FALLBACK) and not built.startswith(FALLBACK):
        raise Mismatch(f"the index is of {built}, and {embedder} stands in for it: make {built} available again; the index need not be built anew")
    if built != embedder:
        raise Mismatch(f"the index is of {built}, and the search of {embedder}: build the index anew")
    if info["dimension"] != dimension and info["documents"]:
        raise Mismatch(f"the index has vectors of {info['dimension']} components, and the search one of {dimension}")
    return info


def cosine(v: Column, query: list[float]) -> Column:
    """Cosine with ``query``; 0 where one of both has no length."""
    q = F.lit([float(x) for x in query])
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    lengths = F.sqrt(total(F.transform(v, lambda x: x * x))) * F.sqrt(total(F.transform(q, lambda x: x * x)))
    return F.when(v.isNotNull(), F.coalesce(total(F.zip_with(v, q, lambda a, b: a * b)) / F.nullif(lengths, F.lit(0.0)), F.lit(0.0)))


def search(spark: SparkSession, path: str, query: str, vector: list[float], embedder: str, k: int, where: dict | None = None, constant: int = 60, digits: int = 12) -> DataFrame:
    """(key, score, dense, and the other columns of records but the vector) of the k best by fused ranks of both arms.

    Each arm gives max(4k, 20) rows that pass the filter ``where``; a row's score is the sum of 1 / (constant + rank) over the arms
    that have it. Ranks' scale says nothing of nearness, so ``dense`` is the row's cosine, also where only its text was found. Ties go
    by key; scores of an arm tie when they are equal to ``digits``.
    """
    info = checked(spark, path, embedder, len(vector))
    records = spark.read.parquet(f"{path}/records")
    records = records.where(lookup.matches(records, where or {}))
    prefetch = max(4 * k, 20)
    near = records.select("key", F.round(cosine(F.col("vector"), vector), digits).alias("score")).where("score is not null").orderBy(F.desc("score"), "key").limit(prefetch)
    told = index.scores(spark, path, query, buckets=info["buckets"]).withColumn("score", F.round("score", digits))
    if where:
        told = told.join(records.select("key"), "key", "left_semi")
    told = told.orderBy(F.desc("score"), "key").limit(prefetch)
    best = retrieval.fuse([near, told], "key", k, constant)
    # k rows meet the table; it is scanned for them, not shuffled.
    found = records.join(F.broadcast(best), "key").withColumn("dense", cosine(F.col("vector"), vector))
    return found.select("key", "score", "dense", *[c for c in records.columns if c not in ("key", "vector")])
