"""Grounding of conflicts: both sides of one must be among what its run has read.

A conflict whose sides aren't both known may be an omission: a parameter that a
clause asks for and the stage's code doesn't read. Nothing positive can be
shown for what isn't there, but two places that were read can: the clause, and
the code that should have followed it. Omissions that nobody named are found
the same way. All joins are on runs' keys; an omission's stems are reduced to
the first omission of each before conflicts meet them, so a run's conflicts and
omissions are never paired.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text

from . import containment, evidence, shared


def grounded_omissions(omissions: DataFrame, places: DataFrame, links: DataFrame, read: DataFrame) -> DataFrame:
    """The ``omissions`` (run, place, param, clause) whose clause and one of whose run's code places (run, code_order, code) are ``read`` (run, locator), with code.

    The code is, of those read, the first that ``links`` (clause, link_order, code) leads to from the clause through a table, else the run's first.
    """
    grow = shared.growing
    clauses = shared.stored(omissions.join(grow(read.withColumnRenamed("locator", "clause")), ["run", "clause"], "left_semi"), "clauses")
    code = shared.stored(places.join(grow(read.withColumnRenamed("locator", "code")), ["run", "code"], "left_semi"), "code")
    first = code.groupBy("run").agg(F.min(F.struct("code_order", "code")).alias("any"))
    # A clause's links or its run's code, whichever are fewer, are gone through, so a clause of many runs with many links isn't multiplied by both.
    codes = code.select("run", "code").distinct()
    links = shared.stored(links.groupBy("clause", "code").agg(F.min("link_order").alias("link_order")), "links")
    one = clauses.select("run", "clause").distinct().join(grow(codes.groupBy("run").agg(F.count("*").alias("n_codes"))), "run")
    one = shared.stored(one.join(grow(links.groupBy("clause").agg(F.count("*").alias("n_links"))), "clause"), "linked")
    by_link, by_code = F.col("n_links") <= F.col("n_codes"), F.col("n_links") > F.col("n_codes")
    linked = one.where(by_link).select("run", "clause").join(grow(links), "clause").join(grow(codes), ["run", "code"])
    linked = linked.unionByName(one.where(by_code).select("run", "clause").join(grow(codes), "run").join(grow(links), ["clause", "code"]))
    best = linked.groupBy("run", "clause").agg(F.min(F.struct("link_order", "code")).alias("near"))
    return clauses.join(grow(first), "run").join(grow(best), ["run", "clause"], "left").select("run", "place", "param", "clause", F.coalesce("near.code", "any.code").alias("code"))


def worded(*columns: tuple[DataFrame, str]) -> DataFrame:
    """(name, stems) of the distinct texts of some columns, (table, name) each: a text that stands in many runs is stemmed once."""
    names = reduce(DataFrame.unionByName, [df.select(F.col(c).alias("name")).distinct() for df, c in columns]).distinct().where("name is not null")
    return shared.stored(shared.dealt(names, "name").select("name", F.array_distinct(text.terms(F.col("name"))).alias("stems")), "stems")


def stems(df: DataFrame, column: str, words: DataFrame, *keys: str) -> DataFrame:
    """(keys, stem) of a column whose texts are among ``words``. Few of these are sent to where the rows are."""
    own = words if words.count() > containment.MOST else F.broadcast(words)
    return df.select(*keys, F.col(column).alias("name")).join(own, "name").select(*keys, F.explode("stems").alias("stem"))


def ground(conflicts: DataFrame, omissions: DataFrame, places: DataFrame, links: DataFrame, known: DataFrame, questions: DataFrame) -> DataFrame:
    """(run, origin, n, subject, expected_source, actual_source) of every conflict, and of the omissions that are found besides.

    ``conflicts``: (run, n, subject, expected_source, actual_source). Origins: ``grounded``, both sides are known; ``rescued``, the first
    omission that shares a stem with the subject is grounded and stands in its place; ``dropped``, neither; ``found``, a grounded omission
    that shares no stem with a conflict that stays, where the run checks consistency or its question has all stems of the parameter
    (``questions``: run, question, checking); n is the omission's place. A null source is not known.
    """
    grow = shared.growing
    conflicts, omissions, places = (shared.stored(df, name) for df, name in ((conflicts, "conflicts"), (omissions, "omissions"), (places, "places")))
    cited = conflicts.select("run", F.explode(F.array("expected_source", "actual_source")).alias("locator"))
    cited = cited.unionByName(omissions.select("run", F.col("clause").alias("locator"))).unionByName(places.select("run", F.col("code").alias("locator")))
    # One look-up for all that is cited anywhere.
    read = shared.stored(evidence.known_locators(cited.where("locator is not null"), known).where("is_known").select("run", "locator"), "read")
    words = worded((conflicts, "subject"), (omissions, "param"))
    side = lambda c: read.select("run", F.col("locator").alias(c), F.lit(True).alias(f"{c}_known"))
    both = conflicts.join(grow(side("expected_source")), ["run", "expected_source"], "left").join(grow(side("actual_source")), ["run", "actual_source"], "left")
    stays = F.coalesce(F.col("expected_source_known") & F.col("actual_source_known"), F.lit(False))
    judged = shared.stored(both.withColumn("stays", stays).select("run", "n", "subject", "expected_source", "actual_source", "stays"), "both")

    shown = shared.stored(grounded_omissions(omissions, places, links, read), "shown")
    by_stem = stems(omissions, "param", words, "run", "place").groupBy("run", "stem").agg(F.min("place").alias("place"))
    match = stems(judged.where("not stays"), "subject", words, "run", "n").join(grow(by_stem), ["run", "stem"]).groupBy("run", "n").agg(F.min("place").alias("place"))
    stand = match.join(grow(shown), ["run", "place"]).select("run", "n", F.struct("param", "clause", "code").alias("o"))
    named = judged.where("not stays").join(grow(stand), ["run", "n"], "left")
    pick = lambda a, b: F.when(F.col("o").isNotNull(), F.col(f"o.{a}")).otherwise(F.col(b)).alias(b)
    stood = named.select("run", F.when(F.col("o").isNotNull(), "rescued").otherwise("dropped").alias("origin"), "n", pick("param", "subject"), pick("clause", "expected_source"), pick("code", "actual_source"))
    out = shared.stored(judged.where("stays").select("run", F.lit("grounded").alias("origin"), "n", "subject", "expected_source", "actual_source").unionByName(stood), "judged")

    # Omissions that aren't asked for by their run go first: those that are meet what is taken.
    own = shown.join(words if words.count() > containment.MOST else F.broadcast(words), F.col("param") == F.col("name"), "left").drop("name").withColumn("stems", F.coalesce("stems", F.array().cast("array<string>")))
    asking = questions.where("coalesce(checking, false) or question is not null").select("run", F.coalesce("checking", F.lit(False)).alias("checking"), F.when(~F.coalesce("checking", F.lit(False)), F.array_distinct(text.terms(F.col("question")))).alias("asked"))
    relevant = F.col("checking") | ((F.size("stems") > 0) & (F.size(F.array_except("stems", "asked")) == 0))
    asked = shared.stored(own.join(grow(asking), "run").where(relevant).select(*shown.columns, "stems"), "asked")
    taken = stems(out.where("origin <> 'dropped'"), "subject", words, "run").distinct()
    named_by = asked.select("run", "place", F.explode("stems").alias("stem")).join(grow(taken), ["run", "stem"], "left_semi").select("run", "place").distinct()
    found = asked.join(grow(named_by), ["run", "place"], "left_anti")
    return out.unionByName(found.select("run", F.lit("found").alias("origin"), F.col("place").alias("n"), F.col("param").alias("subject"), F.col("clause").alias("expected_source"), F.col("code").alias("actual_source")))
