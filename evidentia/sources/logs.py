"""Lines of text files with their numbers, searched by what they hold.

Spark reads a large file in several splits at once, so a line doesn't know its
number. A split's lines are in order, though: one job counts the lines of every
split, a window over the splits of a file adds up those before, and a line's
number is that sum and its place in its split. Searching comes first, so only
the lines that are found meet the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions import text

#: An event: capital Cyrillic words after INFO (fixed value).
EVENT = r"INFO\s+([А-ЯЁ]+(?:\s+[А-ЯЁ]+)*)"


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, split, place, line): every line of text files; split is where its part of the file starts, place grows along it.

    Lines end with a line feed, a carriage return or both. Bytes that aren't UTF-8 become replacement characters.
    """
    raw = spark.read.text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"), F.make_valid_utf8("value").alias("line"))


def starts(every: DataFrame) -> DataFrame:
    """(file, split, first, before): the place of a split's first line, and the lines of its file before it."""
    counted = every.groupBy("file", "split").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")


def numbered(every: DataFrame, some: DataFrame | None = None) -> DataFrame:
    """The lines ``some`` of ``every`` (all, if not given) with line_no, from 1 in each file, in place of split and place."""
    found = (every if some is None else some).join(starts(every), ["file", "split"])
    return found.withColumn("line_no", F.col("before") + F.col("place") - F.col("first") + 1).drop("split", "place", "first", "before")


def event(line: Column) -> Column:
    """The event that a line tells, null if none."""
    found = F.regexp_extract(line, EVENT, 1)
    return F.when(found != "", found)


def search(spark: SparkSession, path: str | list[str], needles: list[str], limit: int = 40) -> DataFrame:
    """(file, line_no, event, line, locator) of the first ``limit`` lines of each file that hold all ``needles``, by normalized keys."""
    wanted = [n for n in needles if n]
    if not wanted:
        raise ValueError("give a number or a pattern to look for")
    every = lines(spark, path)
    key, hit = text.normalize_key(F.col("line")), F.lit(True)
    for n in wanted:
        hit = hit & F.contains(key, text.normalize_key(F.lit(n)))
    # The first lines of a split are enough of it, whatever stands before.
    first = every.where(hit).withColumn("_r", F.row_number().over(Window.partitionBy("file", "split").orderBy("place"))).where(F.col("_r") <= limit).drop("_r")
    found = numbered(every, first).withColumn("_r", F.row_number().over(Window.partitionBy("file").orderBy("line_no"))).where(F.col("_r") <= limit).drop("_r")
    name = F.element_at(F.split("file", "/"), -1)
    return found.select("file", "line_no", event(F.col("line")).alias("event"), F.trim("line").alias("line"), F.concat(name, F.lit(", line "), F.col("line_no").cast("string")).alias("locator"))


def events(found: DataFrame) -> DataFrame:
    """(file, found, events): how many lines were found, and their distinct events in order."""
    return found.groupBy("file").agg(F.count("*").alias("found"), F.array_sort(F.collect_set("event")).alias("events"))
