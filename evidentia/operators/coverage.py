"""Coverage of conditions: parameters that a stage's clauses name and its code doesn't read.

A parameter is a row of a dictionary: a human name, by whose stems clauses are
recognized, and an identifier, by which code is. Both searches are containment
joins: of all stems in a clause's stems, and of a name in a fragment's text, by
way of its grams.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text

from . import shared
from .containment import containing, within

#: So many parameters of a dictionary are looked for first.
FIRST = 256


def parameters(df: DataFrame, name: str, ident: str, order: str) -> DataFrame:
    """(param, place, stems, sense_terms, aliases): each name once, in lower case, by its first row in ``order``. Names without a stem of three letters and null identifiers are left out.

    Aliases are the identifier and the name without spaces. Equal places are told apart by the identifier.
    """
    low = F.lower(F.trim(F.col(name)))
    rows = df.where(F.col(name).isNotNull() & F.col(ident).isNotNull()).select(low.alias("param"), F.col(order).alias("place"), F.col(ident).alias("ident"))
    first = rows.groupBy("param").agg(F.min(F.struct("place", "ident")).alias("f")).select("param", "f.*")
    named = first.withColumn("sense_terms", F.array_distinct(text.terms(F.col("param")))).withColumn("stems", F.filter("sense_terms", lambda t: F.length(t) >= 3))
    return named.where(F.size("stems") > 0).select("param", "place", "stems", "sense_terms", F.array("ident", F.replace("param", F.lit(" "), F.lit(""))).alias("aliases"))


def parts(params: DataFrame) -> DataFrame:
    """(param, part): the parts of three letters or more of a parameter's aliases, each once."""
    pieces = F.flatten(F.transform("aliases", lambda a: F.split(F.lower(a), r"[_\s]+")))
    return params.select("param", F.explode(F.array_distinct(F.filter(pieces, lambda p: F.length(p) >= 3))).alias("part"))


def reverse_names(params: DataFrame) -> DataFrame:
    """(part, stem, n): what an identifier's part is called by people: the terms of all names that have it, with the number of names."""
    stems = params.select("param", F.explode("sense_terms").alias("stem"))
    return parts(params).join(stems, "param").groupBy("part", "stem").agg(F.count("*").alias("n"))


def sense(params: DataFrame) -> DataFrame:
    """``params`` with sense: its stems and the terms of every name that shares a part with its aliases.

    The dictionary has a row for each column of a schema, so a part's terms make a small array.
    """
    told = reverse_names(params).groupBy("part").agg(F.collect_set("stem").alias("told"))
    own = parts(params).join(told, "part").groupBy("param").agg(F.array_distinct(F.flatten(F.collect_list("told"))).alias("told"))
    return params.join(own, "param", "left").withColumn("sense", F.array_union("stems", F.coalesce("told", F.array().cast("array<string>")))).drop("told")


def read_by(params: DataFrame, code: DataFrame) -> DataFrame:
    """(stage, param): parameters one of whose aliases is in a fragment's text (stage, place, text), both without case, underscores and spaces."""
    fragments = shared.stored(shared.dealt(code.where("text is not null")).select("stage", text.code_key(F.col("text")).alias("body")), "bodies")
    names = params.select("param", F.explode(F.array_distinct(F.transform("aliases", text.code_key))).alias("a")).where("a <> ''")
    verified = within(fragments, "body", names, "a").select("stage", "a").distinct()
    return verified.join(names, "a").select("stage", "param").distinct()


def uncovered(params: DataFrame, clauses: DataFrame, code: DataFrame, columns: DataFrame | None = None, most: int = 6) -> DataFrame:
    """(stage, rank, param, clause): the first ``most`` parameters of each stage, in the dictionary's order, that a clause has all stems of and no fragment reads.

    The clause is, of those, one that refers to a table of the parameter, then the one that has most of its sense, then the first by
    place and name. ``clauses``: (stage, clause, place, text, tables); ``code``: (stage, place, text); ``columns``: (param, table_name,
    is_number) of the tables: where any is a number, only parameters that name one are asked for, as others are labels.
    """
    asked = sense(params)
    if columns is None:
        asked = asked.withColumn("own_tables", F.array().cast("array<string>"))
    else:
        facts = columns.groupBy(F.lower(F.trim("param")).alias("param")).agg(F.collect_set(F.col("table_name").cast("string")).alias("own_tables"), F.bool_or("is_number").alias("is_number"))
        asked = asked.join(facts, "param", "left").withColumn("own_tables", F.coalesce("own_tables", F.array().cast("array<string>")))
        if columns.where("is_number").limit(1).count():
            asked = asked.where("is_number")
    # Texts are dealt out and their words stemmed once; every step below reads the terms.
    named = shared.dealt(clauses).select("stage", "clause", "place", text.distinct_terms(F.col("text")).alias("terms"), F.col("tables").cast("array<string>").alias("tables"))
    named = shared.stored(named.withColumn("s", F.monotonically_increasing_id()), "clauses")
    # The dictionary's place stays apart from the clause's.
    asked = shared.stored(asked.select(F.col("param").alias("a"), F.col("place").alias("own_place"), "stems", "sense", "own_tables", "aliases", F.row_number().over(Window.orderBy("place", "param")).alias("o")), "asked")
    first = shared.stored(_first(asked, named, code, most), "first")
    chosen = asked.drop("aliases").join(F.broadcast(first.select("a").distinct()), "a", "left_semi")
    pairs = containing(named.select("stage", "s", "terms", "tables"), "terms", chosen, "stems")
    own = F.broadcast(first.withColumnsRenamed({"stage": "of", "a": "param"}))
    pairs = pairs.join(own, pairs["stage"].eqNullSafe(own["of"]) & (pairs["a"] == own["param"]))
    # A clause's number is its rank by place and name; ranks, unlike names, are reduced in hash maps, so pairs are neither sorted nor spilled.
    ranks = shared.stored(named.select("s", "place", "clause").orderBy("place", "clause").withColumn("r", F.monotonically_increasing_id()), "ranks")
    refers = F.coalesce(F.arrays_overlap("tables", "own_tables"), F.lit(False))
    number = lambda c, digits: c.cast("decimal(38,0)") * F.lit(Decimal(10**digits)).cast("decimal(38,0)")
    best = (number(F.when(refers, 0).otherwise(1), 30) + number(F.lit(1 << 31) - F.size(F.array_intersect("sense", "terms")), 19) + F.col("r")).cast("decimal(38,0)")
    scored = pairs.join(shared.growing(ranks.select("s", "r")), "s")
    least = scored.groupBy("stage", "param", "own_place", "rank").agg(F.min(best).alias("best")).withColumn("r", (F.col("best") % F.lit(Decimal(10**19)).cast("decimal(38,0)")).cast("long"))
    return least.join(ranks.select("r", "clause"), "r").select("stage", "rank", "param", "clause")


def _first(asked: DataFrame, named: DataFrame, code: DataFrame, most: int, step: int = FIRST) -> DataFrame:
    """(stage, a, rank): of each stage, the first ``most`` of ``asked`` (a, o, own_place, stems, aliases) that one of the ``named`` clauses has all stems of and no code reads.

    The dictionary is gone through in its order, ``step`` parameters and then four times as many each time; a stage that has its ``most``
    leaves, as later ones can't be among its first. Where none has, all pairs are looked at.
    """
    total = asked.agg(F.max("o")).first()[0] or 0
    missed, at, left = [], 0, named.select("stage", "s", "terms")
    while True:
        some = asked.where((F.col("o") > at) & (F.col("o") <= at + step))
        there = shared.stored(containing(left, "terms", some.select("a", "o", "stems"), "stems").select("stage", "a", "o").distinct(), "there")
        read = read_by(some.join(F.broadcast(there.select("a").distinct()), "a", "left_semi").select(F.col("a").alias("param"), "aliases"), code)
        missed.append(shared.stored(there.join(read.withColumnRenamed("param", "a"), ["stage", "a"], "left_anti"), "missed"))
        found, at, step = reduce(DataFrame.unionByName, missed), at + step, 4 * step
        if at >= total:
            break
        full = shared.stored(found.groupBy("stage").agg(F.count("*").alias("n")).where(F.col("n") >= most).select("stage"), "full")
        left, code = (df.join(F.broadcast(full), "stage", "left_anti") for df in (named.select("stage", "s", "terms"), code))
        if left.limit(1).count() == 0:
            break
    rank = F.row_number().over(Window.partitionBy("stage").orderBy("o"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most).select("stage", "a", "rank")


def with_places(missed: DataFrame, code: DataFrame) -> DataFrame:
    """A row for each place of the stage's code where a missed parameter should have been read: both sides of the finding can be looked up."""
    return missed.join(code.select("stage", F.col("place").alias("code_place")).distinct(), "stage", "left")
