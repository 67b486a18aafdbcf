"""Runs in order: a gap that is named a third time ends one, and failures in a row close a provider for a while."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gap_key(c):
    return F.substring(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), 1, 80)


def gap_stops(rounds: DataFrame, earlier: int = 2) -> DataFrame:
    """(run, round, gap) where a run of ``rounds`` (run, round, enough, gaps) ends: its first round that isn't enough and names a gap that was named ``earlier`` times before.

    Gaps are compared by their first 80 characters in lower case with single spaces; the gap told is the round's first such. A gap
    named twice in one round counts twice for the rounds that follow. Counts are kept by run and gap, so a run's gaps may be anywhere.
    """
    named = rounds.select("run", "round", "enough", F.posexplode("gaps").alias("i", "gap")).where("gap is not null").withColumn("key", gap_key(F.col("gap")))
    counted = named.groupBy("run", "key", "round").agg(F.count("*").alias("n"), F.bool_and(F.coalesce("enough", F.lit(False))).alias("enough"), F.min(F.struct("i", "gap")).alias("first"))
    before = Window.partitionBy("run", "key").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    stuck = counted.withColumn("seen", F.coalesce(F.sum("n").over(before), F.lit(0))).where((F.col("seen") >= earlier) & ~F.col("enough"))
    return stuck.groupBy("run").agg(F.min(F.struct("round", "first")).alias("s")).select("run", "s.round", "s.first.gap")


def until_stop(rounds: DataFrame, stops: DataFrame) -> DataFrame:
    """The rounds up to the one that ends their run, with limited_by in that one."""
    stop = stops.select("run", F.col("round").alias("_stop"))
    kept = rounds.join(stop, "run", "left").where("_stop is null or round <= _stop")
    return kept.withColumn("limited_by", F.when(F.col("round") == F.col("_stop"), "gap_repeated")).drop("_stop")


def failure_islands(calls: DataFrame, most: int = 3, cooldown_s: int = 60, bucket: str = "hour") -> DataFrame:
    """(provider, started, ended, failures, closed_until): failures in a row, ``most`` at least, of ``calls`` (provider, ts, call, failed), and until when they close it.

    Every failure from the ``most``-th on closes the provider anew for ``cooldown_s``. Calls with a null time take no part; equal times go by
    call. Islands are found within buckets of time, and only those at a bucket's edges are joined over buckets, where each has one row;
    so a provider with most of all calls is dealt over its buckets.
    """
    rows = calls.where("ts is not null").withColumn("bucket", F.date_trunc(bucket, "ts"))
    own, order = Window.partitionBy("provider", "bucket"), ["ts", "call"]
    failed = F.coalesce("failed", F.lit(False))
    marked = rows.select("provider", "bucket", "ts", failed.alias("failed"), F.sum((~failed).cast("long")).over(own.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)).alias("good"), F.sum((~failed).cast("long")).over(own).alias("all_good"))
    parts = marked.where("failed").groupBy("provider", "bucket", "good", "all_good").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("failures"))
    head, tail = F.col("good") == 0, F.col("good") == F.col("all_good")
    middle = parts.where(~head & ~tail).select("provider", "started", "ended", "failures")
    # A bucket in a row: the failures that it begins with and ends with, and whether it has nothing else.
    edge = lambda at: F.max(F.when(at, F.struct("started", "ended", "failures")))
    sides = parts.groupBy("provider", "bucket").agg(edge(head).alias("head"), edge(tail).alias("tail"))
    buckets = rows.select("provider", "bucket").distinct().join(marked.groupBy("provider", "bucket").agg(F.max("all_good").alias("all_good")), ["provider", "bucket"]).join(sides, ["provider", "bucket"], "left")
    line = Window.partitionBy("provider").orderBy("bucket")
    whole = F.col("all_good") == 0
    # A chain begins in a bucket that isn't failures alone; it takes that one's tail, whole buckets after it, and the next one's head.
    chained = buckets.withColumn("chain", F.sum((~whole).cast("long")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = chained.select("provider", "chain", F.col("tail").alias("p")).unionByName(chained.where(~whole).select("provider", (F.col("chain") - 1).alias("chain"), F.col("head").alias("p")))
    joined = pieces.where("p is not null").groupBy("provider", "chain").agg(F.min("p.started").alias("started"), F.max("p.ended").alias("ended"), F.sum("p.failures").alias("failures"))
    found = middle.unionByName(joined.select("provider", "started", "ended", "failures")).where(F.col("failures") >= most)
    return found.withColumn("closed_until", F.col("ended") + F.make_dt_interval(secs=F.lit(float(cooldown_s))))
