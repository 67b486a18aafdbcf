"""Lookups by the name of a table, for many calls at once: ordered fallbacks, and a miss that says why.

Tables are rows (table_no, row, cells), where cells maps column names to
strings, so tables of any schema are one. A call names a table in words or by
number and has filters; what it asks for is resolved by equal keys first and
by containment after that, in one aggregate by priority. Rows are found by a
containment join of a call's filters in the rows' cells, by way of its rarest
filter. A call that finds nothing is told apart: its key may be written with
letters that only look alike, or be in other tables, or be nowhere. Only the
last, and a look-alike, are evidence; a miss in the wrong table proves nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text

from . import containment, shared


def as_rows(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(table_no, row, cells) of tables by number, each with the column that numbers its rows; null cells are left out."""
    out = []
    for number, (df, row) in tables.items():
        cells = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, df.columns)), F.array(*[F.col(f"`{c}`").cast("string") for c in df.columns])), lambda _, v: v.isNotNull())
        out.append(df.select(F.lit(number).alias("table_no"), F.col(f"`{row}`").cast("long").alias("row"), cells.alias("cells")))
    return reduce(DataFrame.unionByName, out)


def resolve(calls: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(call, how, table_no, hint): ``calls`` (call, ref) by ``catalogue`` (place, table_no, slug, title, document, appendix).

    The first number in a reference is a table's (``number``); else its key is that of a name or title (``title``), or within a title
    (``part``), of the first table in place. Else it may be the number of an appendix: then the hint names the documents that have it,
    and their tables (``appendix``). Nothing of it: ``unknown``.
    """
    asked = calls.select("call", F.regexp_extract(F.coalesce("ref", F.lit("")), r"(\d+)", 1).alias("number"), text.normalize_key(F.coalesce("ref", F.lit(""))).alias("key"))
    known = catalogue.select("place", "table_no", text.normalize_key(F.col("slug")).alias("slug"), text.normalize_key(F.col("title")).alias("title"))
    named = known.select("place", "table_no", F.explode(F.array_distinct(F.array("slug", "title"))).alias("key")).where("key <> ''")
    # The catalogue's side is stored or named as small: of two sides that both look small in their files, calls would be broadcast.
    held = shared.stored(containment.inside(known, "title", asked, "key").join(known.select("place", "table_no", "title"), "title").select("place", "table_no", "key"), "held")
    arms = [(1, "number", asked.join(F.broadcast(known.select("place", "table_no", F.col("table_no").alias("number"))), "number")), (2, "title", asked.join(F.broadcast(named), "key")), (3, "part", asked.join(held, "key"))]
    found = reduce(DataFrame.unionByName, [df.select("call", F.lit(i).alias("i"), "place", "table_no", F.lit(how).alias("how")) for i, how, df in arms])
    best = found.groupBy("call").agg(F.min(F.struct("i", "place", "table_no", "how")).alias("b"))
    hints = catalogue.select(F.trim("appendix").alias("number"), F.concat_ws(" ", "document", "table_no").alias("h")).where("number <> ''").groupBy("number").agg(F.array_join(F.array_sort(F.collect_set("h")), "; ").alias("hint"))
    told = asked.join(shared.growing(best), "call", "left").join(hints, "number", "left")
    how = F.coalesce("b.how", F.when(F.col("hint").isNotNull(), "appendix"), F.lit("unknown"))
    return told.select("call", how.alias("how"), F.col("b.table_no").alias("table_no"), F.when(F.col("b").isNull(), F.col("hint")).alias("hint"))


def columns_of(filters: DataFrame, headers: DataFrame) -> DataFrame:
    """(table_no, name, column): the header (table_no, position, column) with the name's key, else the first whose key holds it; null if none does."""
    asked = filters.select("table_no", "name", text.normalize_key(F.col("name")).alias("key")).distinct()
    known = headers.select("table_no", "position", "column", text.normalize_key(F.col("column")).alias("header"))
    within = containment.inside(known, "header", asked, "key")
    fits = asked.join(within, "key").join(known, ["table_no", "header"])
    best = fits.groupBy("table_no", "name").agg(F.min(F.struct((F.col("key") != F.col("header")).alias("other"), "position", "column")).alias("b"))
    return asked.join(best, ["table_no", "name"], "left").select("table_no", "name", F.col("b.column").alias("column"))


def cell(table: Column | str, column: Column | str, value: Column | str) -> Column:
    """One cell of a table as an element of its row."""
    return F.to_json(F.struct(F.coalesce(table, F.lit("")).alias("t"), F.coalesce(column, F.lit("")).alias("c"), F.coalesce(value, F.lit("")).alias("v")))


def lookups(calls: DataFrame, catalogue: DataFrame, headers: DataFrame, rows: DataFrame, most: int = 4) -> DataFrame:
    """(call, route, outcome, table_no, total, first_row, detail): one row for each of ``calls`` (call, ref, filters), filters being an array of (name, value).

    Outcomes ``found``, ``look-alike`` and ``missing`` are evidence; ``elsewhere`` (at most ``most`` tables, in their order, with the first
    column that has one of the absent values by its key), ``appendix``, ``unknown table`` and ``unknown column`` are failed calls, which prove
    nothing. A call without filters finds all rows of its table. Values are compared as strings; null never matches.
    """
    resolved = shared.stored(resolve(calls, catalogue), "resolved")
    wanted = calls.select("call", F.posexplode(F.coalesce("filters", F.array().cast("array<struct<name:string,value:string>>"))).alias("i", "f"))
    wanted = wanted.select("call", "i", F.col("f.name").alias("name"), F.col("f.value").alias("value")).join(shared.growing(resolved.where("table_no is not null").select("call", "table_no")), "call")
    filters = shared.stored(wanted.join(columns_of(wanted, headers), ["table_no", "name"], "left"), "filters")
    bad = filters.groupBy("call").agg(F.count_if(F.col("column").isNull()).alias("bad"), F.min(F.when(F.col("column").isNull(), F.col("name"))).alias("bad_name"))

    elements = F.transform(F.map_entries("cells"), lambda e: cell(F.col("table_no"), e["key"], e["value"]))
    sets = rows.select(F.struct("table_no", "row").alias("s"), elements.alias("e"))
    every = F.collect_set(F.when(F.col("value").isNotNull(), cell("table_no", "column", "value")).otherwise(F.lit("-")))  # no cell is a dash
    asked = filters.where("column is not null").groupBy("call").agg(every.alias("w")).join(shared.growing(bad.where("bad = 0").select("call")), "call").select(F.col("call").alias("a"), "w")
    # Equal questions are asked once.
    questions = asked.groupBy("w").agg(F.min("a").alias("a"))
    hits = containment.containing(sets, "e", questions, "w").groupBy("w").agg(F.count("*").alias("total"), F.min("s.row").alias("first_row"))
    hits = shared.stored(hits, "hits")
    whole = rows.groupBy("table_no").agg(F.count("*").alias("total"), F.min("row").alias("first_row"))
    free = resolved.where("table_no is not null").join(shared.growing(filters.select("call").distinct()), "call", "left_anti").join(whole, "table_no").select("call", "total", "first_row")
    found = asked.join(hits, "w").select(F.col("a").alias("call"), "total", "first_row").unionByName(free)

    # What the columns of missed calls hold: equal cells are looked for once, so calls meet what was found of them only.
    values = rows.select("table_no", F.explode("cells").alias("column", "value"))
    missed = filters.join(shared.growing(bad.where("bad = 0").select("call")), "call").join(shared.growing(found.select("call")), "call", "left_anti")
    wanted_cells = missed.where("value is not null").select("table_no", "column", "value").distinct()
    asked_cells = shared.stored(wanted_cells.withColumn("key", text.normalize_key(F.col("value"))), "cells")
    keyed = values.withColumn("key", text.normalize_key(F.col("value"))).join(asked_cells.select("key").distinct(), "key", "left_semi").groupBy("table_no", "column", "value", "key").agg(F.lit(True).alias("there"))
    known = shared.stored(keyed, "known")
    twins = known.groupBy("table_no", "column", "key").agg(F.min("value").alias("twin"))
    told_cells = asked_cells.join(known.drop("key"), ["table_no", "column", "value"], "left").join(twins, ["table_no", "column", "key"], "left")
    judged = shared.stored(told_cells, "judged")
    absent = shared.stored(missed.join(judged, ["table_no", "column", "value"], "left").where("there is null").drop("there"), "absent")
    alike = absent.where("twin is not null").groupBy("call").agg(F.min(F.struct("i", F.concat_ws(" ~ ", "value", "twin").alias("d"))).alias("x")).select("call", F.col("x.d").alias("look_alike"))
    others = known.where(F.length("key") >= 2).join(headers.select("table_no", "column", "position"), ["table_no", "column"]).groupBy("key", "table_no").agg(F.min(F.struct("position", "column")).alias("p"))
    others = shared.stored(others, "others")
    places = absent.where("twin is null").join(shared.growing(alike), "call", "left_anti").select("call", "key", F.col("table_no").alias("own")).join(others, "key").where("table_no <> own")
    ordered = places.join(catalogue.select("table_no", "place"), "table_no").groupBy("call", "table_no", "place").agg(F.min("p").alias("p"))
    near = ordered.withColumn("r", F.row_number().over(Window.partitionBy("call").orderBy("place"))).where(F.col("r") <= most)
    listed = near.groupBy("call").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat_ws(", ", F.concat(F.lit("table "), "table_no"), "p.column").alias("t")))), lambda x: x["t"]), "; ").alias("elsewhere"))

    out = reduce(lambda a, b: a.join(shared.growing(b), "call", "left"), (bad, found, alike, listed), resolved)
    outcome = (
        F.when(F.col("how") == "appendix", "appendix").when(F.col("how") == "unknown", "unknown table").when(F.col("bad") > 0, "unknown column").when(F.col("total") > 0, "found")
        .when(F.col("look_alike").isNotNull(), "look-alike").when(F.col("elsewhere").isNotNull(), "elsewhere").otherwise("missing")
    )
    told = out.withColumn("outcome", outcome)
    nothing = F.concat(F.lit("table "), "table_no", F.lit(" (no matches)"))
    detail = (
        F.when(F.col("outcome") == "appendix", F.col("hint")).when(F.col("outcome") == "unknown column", F.col("bad_name")).when(F.col("outcome") == "found", F.concat(F.lit("table "), "table_no", F.lit(", row "), F.col("first_row").cast("string")))
        .when(F.col("outcome") == "look-alike", F.col("look_alike")).when(F.col("outcome") == "elsewhere", F.col("elsewhere")).when(F.col("outcome") == "missing", nothing)
    )
    route = F.when(F.col("outcome").isin("found", "look-alike", "missing"), "evidence").otherwise("failed")
    hit = F.col("outcome") == "found"
    return told.select("call", route.alias("route"), "outcome", "table_no", F.when(hit, F.col("total")).otherwise(0).cast("long").alias("total"), F.when(hit, F.col("first_row")).alias("first_row"), detail.alias("detail"))


def rows_of(calls: DataFrame, answers: DataFrame, headers: DataFrame, rows: DataFrame, limit: int = 20) -> DataFrame:
    """(call, row, cells, locator): the first ``limit`` rows of each call that found some, in order."""
    hit = answers.where("outcome = 'found'").select("call", "table_no")
    wanted = calls.select("call", F.explode_outer("filters").alias("f")).join(hit, "call").select("call", "table_no", F.col("f.name").alias("name"), F.col("f.value").alias("value"))
    named = wanted.where("name is not null").join(columns_of(wanted.where("name is not null"), headers), ["table_no", "name"])
    asked = named.groupBy("call").agg(F.collect_set(cell("table_no", "column", "value")).alias("w")).select(F.col("call").alias("a"), "w")
    sets = rows.select(F.struct("table_no", "row").alias("s"), F.transform(F.map_entries("cells"), lambda e: cell(F.col("table_no"), e["key"], e["value"])).alias("e"), "cells")
    some = containment.containing(sets, "e", asked, "w").select(F.col("a").alias("call"), "s.table_no", "s.row", "cells")
    free = hit.join(asked.select(F.col("a").alias("call")), "call", "left_anti").join(rows, "table_no").select("call", "table_no", "row", "cells")
    ranked = some.unionByName(free).withColumn("r", F.row_number().over(Window.partitionBy("call").orderBy("row"))).where(F.col("r") <= limit)
    return ranked.select("call", "row", "cells", F.concat(F.lit("table "), "table_no", F.lit(", row "), F.col("row").cast("string")).alias("locator"))
