"""Secrets out of nested records, and long values cut, by a walk over the schema."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys of secrets, keys that only look like such, secrets within values, and limits (fixed values).
SECRET_KEY = r"(?i)(api[_-]?key|authorization|token|secret|password|bearer)"
SAFE_KEY = r"(?i)^(tokens?_(in|out|total)|token_count|max_tokens)$"
SECRET_VALUE = r"\b(sk-[A-Za-z0-9\-_]{8,}|Bearer\s+\S+)"
MOST_CHARACTERS, MOST_ITEMS = 800, 50
MASK = "***"


def is_secret(name: str) -> bool:
    return bool(re.search(SECRET_KEY, name)) and not re.match(SAFE_KEY, name)


def _secret(c: Column) -> Column:
    return c.rlike(SECRET_KEY) & ~c.rlike(SAFE_KEY)


def _once(c: Column, f) -> Column:
    """``f`` of ``c``, for an ``f`` that names it several times: as a variable, so that it is computed once."""
    return F.transform(F.array(c), f)[0]


def clean(c: Column, kind: T.DataType) -> Column:
    """``c`` of type ``kind`` without secrets.

    Text: secrets within it are masked, and what is over 800 characters is cut and counted. A field of a record whose name is a
    secret's becomes the mask, whatever its type was. A map's value under such a key becomes the mask if it is text, else null.
    Of an array 50 items stay; one of text ends with a count of the others. Null stays null, other types as they are.
    """
    if isinstance(kind, T.StringType):
        more = lambda x: F.concat(F.substring(x, 1, MOST_CHARACTERS), F.lit("… (+"), (F.length(x) - MOST_CHARACTERS).cast("string"), F.lit(" симв.)"))
        return _once(F.regexp_replace(c, SECRET_VALUE, MASK), lambda x: F.when(F.length(x) > MOST_CHARACTERS, more(x)).otherwise(x))
    if isinstance(kind, T.StructType):
        fields = [(F.lit(MASK) if is_secret(f.name) else clean(c.getField(f.name), f.dataType)).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        first = lambda a: F.transform(F.slice(a, 1, MOST_ITEMS), lambda x: clean(x, kind.elementType))
        if not isinstance(kind.elementType, T.StringType):
            return first(c)
        more = lambda a: F.array(F.concat(F.lit("… ещё "), (F.size(a) - MOST_ITEMS).cast("string")))
        return _once(c, lambda a: F.concat(first(a), F.when(F.size(a) > MOST_ITEMS, more(a)).otherwise(F.array().cast("array<string>"))))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        mask = F.lit(MASK) if isinstance(kind.valueType, T.StringType) else F.lit(None)
        return F.transform_values(c, lambda k, v: F.when(_secret(k), mask).otherwise(clean(v, kind.valueType)))
    return c
