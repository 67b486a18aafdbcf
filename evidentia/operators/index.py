"""A stored index of terms: written once as Parquet, searched without reading the texts again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import text

from .shared import dealt, folder, remove

__all__ = ["build", "folder", "postings", "remove", "scores", "search", "stats"]


def postings(spark: SparkSession, path: str) -> DataFrame:
    """The postings; their schema is stated, as a table without a term has no file to read it from."""
    key = spark.read.parquet(f"{path}/sizes").schema["key"].dataType.simpleString()
    return spark.read.schema(f"key {key}, term string, tf long, bucket int").parquet(f"{path}/postings")


def build(df: DataFrame, key: str, column: str, path: str, buckets: int = 64) -> None:
    """Write sizes (key, dl), postings (bucket, term, key, tf), sorted by term in their bucket's files, and terms (term, df).

    Terms are stems. A null or empty text has a size of 0 and no postings. A search reads the buckets of its terms only.
    ``df`` should be dealt out (``shared.dealt``) where its file has few row groups. A text's words are counted where its row is, and stemmed once each.
    """
    spark = df.sparkSession
    df.select(F.col(key).alias("key"), text.tokenize(F.col(column)).alias("words")).write.parquet(f"{path}/tokens")
    own = spark.read.parquet(f"{path}/tokens")
    own.select("key", F.size("words").alias("dl")).write.parquet(f"{path}/sizes")
    words = dealt(own, "key").select("key", F.explode("words").alias("word")).groupBy("key", "word").agg(F.count("*").alias("n"))
    counts = words.select("key", text.stem(F.col("word")).alias("term"), "n").groupBy("key", "term").agg(F.sum("n").alias("tf"))
    placed = counts.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    # A bucket's postings are dealt over several tasks by key, so no task holds those of a frequent term alone.
    placed.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(8))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
    postings(spark, path).groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{path}/terms")
    remove(spark, f"{path}/tokens")


def stats(spark: SparkSession, path: str) -> DataFrame:
    """One row: documents, avgdl, terms, postings."""
    size = spark.read.parquet(f"{path}/sizes").agg(F.count("*").alias("documents"), F.avg("dl").alias("avgdl"))
    terms = spark.read.parquet(f"{path}/terms").agg(F.count("*").alias("terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings"))
    return size.join(terms, F.lit(True))


def scores(spark: SparkSession, path: str, query: str, k1: float = 1.5, b: float = 0.75, buckets: int = 64) -> DataFrame:
    """(key, score) by BM25 of all documents that have one of the distinct terms of ``query``. ``buckets`` as the index was built."""
    one = spark.range(1).select(F.explode(F.array_distinct(text.terms(F.lit(query)))).alias("term"))
    asked = one.select("term", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")).collect()
    size = spark.read.parquet(f"{path}/sizes")
    all_ = size.agg(F.count("*").alias("n"), F.avg("dl").alias("a")).first()
    terms = [r["term"] for r in asked]
    hits = postings(spark, path).where(F.col("bucket").isin([r["bucket"] for r in asked]) & F.col("term").isin(terms))
    weight = spark.read.parquet(f"{path}/terms").where(F.col("term").isin(terms)).select("term", F.log1p((F.lit(all_["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / (all_["a"] or 1.0)))
    return hits.join(weight, "term").join(size, "key").groupBy("key").agg(F.sum(part).alias("score"))


def search(spark: SparkSession, path: str, query: str, k: int, k1: float = 1.5, b: float = 0.75, buckets: int = 64) -> DataFrame:
    """(key, score) of the k best documents by BM25 for the distinct terms of ``query``; ties by key."""
    return scores(spark, path, query, k1, b, buckets).orderBy(F.desc("score"), "key").limit(k)
