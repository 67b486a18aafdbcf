"""Point lookups over tables: strict filters, a lenient projection, counted before the limit, with diagnosis of misses."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text


def matches(df: DataFrame, filters: dict) -> Column:
    """AND over columns: a list is IN over strings, a string is equality of strings, else equality. Null never matches."""

    def one(name: str, value) -> Column:
        c = F.col(f"`{name}`")
        if isinstance(value, (list, tuple, set)):
            return c.cast("string").isin([str(v) for v in value])
        return c.cast("string") == value if isinstance(value, str) else c == F.lit(value)

    return reduce(lambda a, b: a & b, [one(n, v) for n, v in filters.items()], F.lit(True))


def resolve_column(df: DataFrame, name: str) -> str:
    """The column of that name, else the only one that holds it; else an error that lists the columns."""
    want = " ".join(name.lower().split())
    equal = [c for c in df.columns if c.lower() == want]
    holds = [c for c in df.columns if want in c.lower()]
    if found := equal or (holds if len(holds) == 1 else []):
        return found[0]
    raise ValueError(f"no column {name!r} among {', '.join(df.columns)}")


def lookup(df: DataFrame, filters: dict, columns: Sequence[str] | None = None, order: Sequence[str] = (), limit: int = 20) -> DataFrame:
    """The first ``limit`` matching rows in ``order`` with ``total``, the count of all. One unknown column and all columns are returned."""
    if not order:
        raise ValueError("the first rows of a lookup need an order")
    found = df.where(matches(df, filters))
    total = found.agg(F.count("*").alias("total"))
    rows = found.orderBy(*order).limit(limit).crossJoin(F.broadcast(total))
    known = columns and all(c in df.columns for c in columns)
    return rows.select(*(columns if known else df.columns), "total")


def in_range(value: Column, low: Column, high: Column) -> Column:
    return value.between(low, high)


def near_misses(df: DataFrame, column: str, value: str, order: str, limit: int = 5) -> DataFrame:
    """Rows whose key holds the upper-cased value, the first ones in order."""
    return df.where(F.upper(F.col(column)).contains(value.upper())).orderBy(order).limit(limit)


def nearest(df: DataFrame, column: str, allowed: DataFrame, name: str) -> DataFrame:
    """(value, repaired) of each distinct value: null for an allowed one, else the first allowed one that is equal without
    case and spaces, else the only one within 1 (up to six letters) or 2 edits; null if none or several are.

    ``allowed`` is a closed list, such as a schema's.
    """
    norm = lambda c: F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("ё"), F.lit("е")), r"\s+", " "))
    values = df.select(F.col(column).alias("value")).distinct()
    near = text.edit_distance(norm("value"), norm(name)) <= F.when(F.length(norm("value")) <= 6, 1).otherwise(2)
    exact = F.min(F.when(norm("value") == norm(name), F.col(name)))
    hits = values.join(allowed.select(name), near).groupBy("value").agg(F.when(F.bool_or(F.col("value") == F.col(name)), None).otherwise(F.coalesce(exact, F.when(F.count("*") == 1, F.min(name)))).alias("repaired"))
    return values.join(hits, "value", "left")


def diagnose(df: DataFrame, filters: dict, most: int = 15) -> DataFrame:
    """(column_name, verdict, sample, more) of each filter alone: present, a look-alike of a present value, or absent with the first values."""
    out = []
    for name, value in filters.items():
        c = F.col(f"`{name}`").cast("string")
        own = df.where(c.isNotNull()).groupBy(c.alias("v")).agg(F.count("*").alias("n"))
        twin = text.normalize_key(F.col("v")) == text.normalize_key(F.lit(str(value)))
        ranked = own.orderBy("v").limit(most).agg(F.array_join(F.array_sort(F.collect_list("v")), ", ").alias("sample"))
        told = own.agg(F.count("*").alias("values"), F.bool_or(F.col("v") == str(value)).alias("same"), F.bool_or(twin).alias("twin"))
        verdict = F.when(F.col("same"), "present").when(F.col("twin"), "look-alike").otherwise("absent")
        out.append(told.crossJoin(ranked).select(F.lit(name).alias("column_name"), verdict.alias("verdict"), "sample", F.greatest(F.col("values") - most, F.lit(0)).alias("more")))
    return reduce(DataFrame.unionByName, out)


def value_locations(tables: dict[str, DataFrame], value: str, limit: int = 4) -> DataFrame:
    """In which tables a value occurs, by its normalized key: the first column of each, and rows; at most ``limit`` tables by name. One scan a table."""
    parts, want = [], text.normalize_key(F.lit(value))
    for name, df in tables.items():
        own = [c for c, kind in df.dtypes if kind == "string"]
        if own:
            counts = [F.struct(F.lit(c).alias("column_name"), F.count_if(text.normalize_key(F.col(f"`{c}`")) == want).alias("n_rows")) for c in own]
            found = F.get(F.filter("_found", lambda x: x["n_rows"] > 0), F.lit(0))
            parts.append(df.agg(F.array(*counts).alias("_found")).select(F.lit(name).alias("table_name"), found.alias("_first")))
    return reduce(DataFrame.unionByName, parts).where("_first is not null").orderBy("table_name").limit(limit).select("table_name", "_first.column_name", "_first.n_rows")


def homoglyph_twins(df: DataFrame, column: str) -> DataFrame:
    """Different strings with one normalized key."""
    keyed = df.select(F.col(column).alias("raw"), text.normalize_key(F.col(column)).alias("norm")).distinct()
    return keyed.groupBy("norm").agg(F.array_sort(F.collect_set("raw")).alias("twins")).where(F.size("twins") > 1)


def key_difference(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, position, left_char, right_char) where two strings differ, from 1; a missing side is a dash."""
    n = F.greatest(F.length(a), F.length(b))
    at = df.select(a, b, F.explode(F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).alias("position"))
    side = lambda c: F.when(F.length(c) >= F.col("position"), F.substring(F.col(c), F.col("position"), F.lit(1))).otherwise("—")
    return at.withColumns({"left_char": side(a), "right_char": side(b)}).where("left_char <> right_char")
