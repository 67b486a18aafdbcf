"""What the columns of tables hold: one aggregate for each table, whatever its schema, and an index of their headers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.functions import text


def _state(field: T.StructField) -> Column:
    """What is known of a column after any number of its rows; partial states add up."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.NumericType):
        number = c.cast("double")
    elif isinstance(field.dataType, T.StringType):
        number = F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")
    else:
        number = F.lit(None).cast("double")
    return F.struct(F.lit(field.name).alias("column"), F.count(c).alias("n"), F.count(number).alias("numbers"), F.min(number).alias("low"), F.max(number).alias("high"))


def columns(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_no, position, column, kind, n, low, high): each column of each table, in one pass over a table.

    A column is of ``number`` if all its values, one at least, are numbers or text that reads as one, with a decimal comma or
    point; of ``text`` otherwise, and ``empty`` without a value. low and high are bounds of a number's.
    """
    out = []
    for name, df in tables.items():
        states = df.agg(F.array(*map(_state, df.schema.fields)).alias("s")).select(F.posexplode("s").alias("position", "s"))
        out.append(states.select(F.lit(name).alias("table_no"), "position", "s.*"))
    every = reduce(DataFrame.unionByName, out)
    kind = F.when(F.col("n") == 0, "empty").when(F.col("n") == F.col("numbers"), "number").otherwise("text")
    bound = lambda c: F.when(kind == "number", F.col(c)).alias(c)
    return every.select("table_no", "position", "column", kind.alias("kind"), "n", bound("low"), bound("high"))


def header_terms(profile: DataFrame) -> DataFrame:
    """(term, tables, columns): in how many tables and columns each term of a header is; underscores part terms too."""
    words = text.terms(F.translate("column", "_", " "))
    return profile.select("table_no", "column", F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.count_distinct("table_no").alias("tables"), F.count("*").alias("columns"))


def tables_with(profile: DataFrame, name: str) -> DataFrame:
    """(table_no, column): the first column of each table whose key is that of ``name`` or holds it."""
    key, want = text.normalize_key(F.col("column")), text.normalize_key(F.lit(name))
    found = profile.where((key == want) | ((want != "") & F.contains(key, want)))
    return found.groupBy("table_no").agg(F.min(F.struct("position", "column")).alias("f")).select("table_no", "f.column")


def named_columns(profile: DataFrame) -> DataFrame:
    """(param, table_name, is_number), as coverage takes it: a name is of numbers in a table if a column of that name is."""
    return profile.groupBy(F.lower(F.trim("column")).alias("param"), F.col("table_no").alias("table_name")).agg(F.bool_or(F.col("kind") == "number").alias("is_number"))
