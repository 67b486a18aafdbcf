"""Sentences of answers, and those struck out for a locator that no source has."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A bracket, or an end of a sentence with the spaces and the character that follow.
MARK = re.compile(r"[\[\]]|[.!?](?=(\s+)(\S?))")


def parts(answer: str | None) -> list[str]:
    """Ends count outside of brackets only, before space and a capital letter or nothing more; an open bracket reaches to the end."""
    out, begin, depth = [], 0, 0
    for m in MARK.finditer(answer or ""):
        if m[0] in "[]":
            depth = max(0, depth + (1 if m[0] == "[" else -1))
        elif not depth and (not m[2] or m[2].isupper()):
            out.append(answer[begin : m.end(1)].strip())
            begin = m.end(1)
    rest = (answer or "")[begin:].strip()
    return [*out, rest] if rest else out


def sentences(c: Column) -> Column:
    """The sentences of a text in order; none of null. Brackets nest, which no pattern tells, so Python splits, in Arrow batches."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(parts)

    return split(c)


def strike(answers: DataFrame, key: str, column: str, bad: DataFrame, locator: str) -> DataFrame:
    """(key, kept, dropped): an answer without the sentences that hold one of its locators in ``bad`` (key, locator), and these."""
    own = bad.groupBy(key).agg(F.collect_set(locator).alias("_bad"))
    rows = answers.select(key, sentences(F.col(column)).alias("_s")).join(own, key, "left").withColumn("_bad", F.coalesce("_bad", F.array().cast("array<string>")))
    holds = lambda s: F.exists("_bad", lambda b: s.contains(b))
    return rows.select(key, F.array_join(F.filter("_s", lambda s: ~holds(s)), " ").alias("kept"), F.filter("_s", holds).alias("dropped"))
