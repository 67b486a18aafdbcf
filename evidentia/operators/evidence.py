"""Evidence: facts with locators, membership of citations, coverage, and metrics of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text

from . import containment, shared


def facts(df: DataFrame, claim: Column, value: Column, source: str, row: Column, call: str, order: str, most: int = 8) -> DataFrame:
    """(claim, value, source, locator): at most ``most`` facts of each call, in order."""
    rows = df.withColumns({"claim": claim, "value": value.cast("string"), "source": F.lit(source), "locator": text.locator(source, row), "_r": F.row_number().over(Window.partitionBy(call).orderBy(order))})
    return rows.where(F.col("_r") <= most).select("claim", "value", "source", "locator")


def known_citations(answers: DataFrame, key: str, column: str, known: DataFrame) -> DataFrame:
    """(key, citation, is_known): a citation is known if its head is, and all its rows, none or more, are among that head's.

    Where the head isn't known, the first known head in order that holds it or is held by it stands for it. ``known``
    has head and row; only distinct unknown heads meet the distinct known ones.
    """
    cited = answers.select(key, F.explode(text.citations(F.col(column))).alias("citation"))
    split = cited.select(key, "citation", text.locator_head(F.col("citation")).alias("head"), text.locator_rows(F.col("citation")).alias("rows"))
    heads = known.select(F.col("head").alias("known_head")).distinct()
    own = split.select("head").distinct()
    like = alike(own.join(heads, F.col("head") == F.col("known_head"), "left_anti"), heads)
    # The heads that stand for others are stored, so that Spark knows how few they are and answers stay where they are read.
    stands = shared.stored(own.join(heads, F.col("head") == F.col("known_head")).unionByName(like.groupBy("head").agg(F.min("known_head").alias("known_head"))), "heads")
    placed = split.join(stands, "head", "left").select(key, "citation", "known_head", F.explode_outer("rows").alias("row"))
    hit = known.select(F.col("head").alias("known_head"), "row").distinct().withColumn("hit", F.lit(True))
    # What has no row or no known head needs no look-up: as nulls, all of it would meet in one task.
    asked = F.col("known_head").isNotNull() & F.col("row").isNotNull()
    found = placed.where(asked).join(shared.growing(hit), ["known_head", "row"], "left").select(key, "citation", F.coalesce("hit", F.lit(False)).alias("fits"))
    told = found.unionByName(placed.where(~asked).select(key, "citation", F.col("known_head").isNotNull().alias("fits")))
    return told.groupBy(key, "citation").agg(F.bool_and("fits").alias("is_known"))


def alike(heads: DataFrame, known: DataFrame) -> DataFrame:
    """(head, known_head): heads and the known ones that hold them or are held by them."""
    return containment.inside(known, "known_head", heads, "head").unionByName(containment.inside(heads, "head", known, "known_head")).distinct()


def known_locators(cited: DataFrame, known: DataFrame) -> DataFrame:
    """(run, locator, is_known) of the distinct locators that a run cites, by the (run, head, row) of what the same run has read; as ``known_citations``.

    A locator is parsed once. One of one row that its run has read by its own head is told by the first join; heads are looked up for the
    others only, and only those whose head isn't known meet other heads.
    """
    grow, row = shared.growing, F.when(F.size("rows") == 1, F.col("rows")[0])
    split = cited.select("run", "locator").distinct().withColumns({"head": text.locator_head(F.col("locator")), "rows": text.locator_rows(F.col("locator"))})
    own = known.select("run", "head", "row").distinct()
    # What hasn't one row asks for none, under its own hash, so that these don't meet in one task.
    asked = split.withColumns({"row": F.coalesce(row, F.lit(-1) - F.pmod(F.xxhash64("locator"), F.lit(1 << 62))), "one": F.coalesce(row.isNotNull(), F.lit(False))})
    first = shared.stored(asked.join(grow(own.where("row is not null").withColumn("hit", F.lit(True))), ["run", "head", "row"], "left").select("run", "locator", "head", "rows", "one", (F.col("one") & F.coalesce("hit", F.lit(False))).alias("told")), "told")
    heads = known.select("run", "head").distinct()
    rest = shared.stored(first.where("not told").join(grow(heads.withColumn("same", F.lit(True))), ["run", "head"], "left"), "untold")
    # A known head without the one row that is asked for.
    missed = rest.where("same and one").select("run", "locator", F.lit(False).alias("is_known"))
    unlike = rest.where("same is null").select("run", "head").distinct()
    like = unlike.join(alike(unlike.select("head").distinct(), heads.select(F.col("head").alias("known_head")).distinct()), "head").join(grow(heads.withColumnRenamed("head", "known_head")), ["run", "known_head"], "left_semi")
    stands = like.groupBy("run", "head").agg(F.min("known_head").alias("known_head"))
    other = rest.where("same is null").join(grow(stands), ["run", "head"], "left").select("run", "locator", "known_head", "rows")
    other = other.unionByName(rest.where("same and not one").select("run", "locator", F.col("head").alias("known_head"), "rows"))
    placed = other.select("run", "locator", "known_head", F.explode_outer("rows").alias("row"))
    fits = F.col("known_head").isNotNull() & (F.col("row").isNull() | F.coalesce("hit", F.lit(False)))
    slow = placed.join(grow(own.withColumnRenamed("head", "known_head").withColumn("hit", F.lit(True))), ["run", "known_head", "row"], "left").groupBy("run", "locator").agg(F.bool_and(fits).alias("is_known"))
    return first.where("told").select("run", "locator", F.lit(True).alias("is_known")).unionByName(missed).unionByName(slow)


def coverage(seen: DataFrame, key: str, source: str, required: list[str], runs: DataFrame | None = None) -> DataFrame:
    """(key, missing): required sources that a run hasn't seen, in order; all of them for those of ``runs`` that have seen none."""
    own = seen.groupBy(key).agg(F.collect_set(source).alias("own"))
    if runs is not None:
        own = runs.select(key).distinct().join(own, key, "left")
    return own.select(key, F.array_join(F.array_sort(F.array_except(F.lit(required), F.coalesce("own", F.array().cast("array<string>")))), ",").alias("missing"))


def p95(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, median, p95): p95 is the value at place int(n * 0.95) in order, from 1; null under two rows.

    Values are counted first, so a group's equal rows meet in one, and places are sums of counts over its values.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(group)
    placed = counted.withColumns({"up": F.sum("c").over(w.orderBy("v")), "n": F.sum("c").over(w)})
    at = lambda place: F.min(F.when(F.col("up") >= place, F.col("v")))
    middle = (at(F.floor((F.col("n") + 1) / 2)) + at(F.floor(F.col("n") / 2) + 1)) / 2
    return placed.groupBy(group).agg(F.max("n").alias("n"), middle.alias("median"), F.when(F.max("n") > 1, at(F.floor(F.col("n") * 0.95))).alias("p95"))


def repeated_gaps(df: DataFrame, column: str, prefix: int = 80) -> DataFrame:
    """(gap, n): texts by lower-case prefix with single spaces, where it occurs twice or more."""
    gap = F.substring(F.trim(F.regexp_replace(F.lower(column), r"[ \t\n\r\f]+", " ")), 1, prefix)
    return df.groupBy(gap.alias("gap")).agg(F.count("*").alias("n")).where("n > 1")


def digest(df: DataFrame, source: str, locator: str, most: int = 4) -> DataFrame:
    """(source, locators, more): the first ``most`` distinct locators of each source in order, and how many follow."""
    first = df.select(source, locator).distinct().withColumns({"_r": F.row_number().over(Window.partitionBy(source).orderBy(locator))})
    own = first.where(F.col("_r") <= most).groupBy(source).agg(F.array_join(F.array_sort(F.collect_list(locator)), "; ").alias("locators"))
    total = df.groupBy(source).agg(F.count_distinct(locator).alias("n"))
    return own.join(total, source).select(source, "locators", F.greatest(F.col("n") - most, F.lit(0)).alias("more"))
