"""A corpus pipeline of five stages over ``documents``; each stage reads what its predecessor kept.

Every stage but the last returns the columns of documents. n_chars follows
the text where a stage changes it. SQL can't express the classifiers and the
packing; tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import common, jaccard, langid, mixing, packing, substring

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those that the classifier rejects go."""
    return langid.identify(docs, langid.fit_languages(docs)).where("not rejected").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five words, Jaccard 0.8), one row: that with the smallest id, then the least text hash.

    Rows are linked by numbers of their own, so repeated ids and null ids (which come last) are rows like others. Texts
    without words link with nothing; of those with equal id and text one row stays.
    """
    rows = common.written(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    linked = jaccard.near_duplicates(rows.select("_row", "doc_id", "text"), doc_id="_row")
    worded = F.col("n_shingles") > 0
    group = [F.when(worded, F.col("component_id")).alias("_a"), F.when(~worded, F.struct("doc_id", F.sha2(F.coalesce("text", F.lit("-")), 256).alias("t"))).alias("_b")]
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", F.xxhash64("text").alias("h"), "_row")
    first = linked.groupBy(*group).agg(F.min(order).alias("_first")).select(F.col("_first._row").alias("_row"))
    return rows.join(first, "_row", "left_semi").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller id has too; those left without a word go."""
    cut = substring.remove_repeated(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    kept = cut.where("n_removed = 0 or n_removed < n_words").withColumn("text", text)
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of domains asks; the classifier learns from those labelled documents that are left."""
    model = mixing.fit_domains(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.repeated(mixing.mix(docs, model)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", target_weights),
    ("best-fit packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
