"""Ordered queues: neighbours, positions and first rows of each line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def neighbors(df: DataFrame, keys: Sequence[str], order: Sequence[str], item: str) -> DataFrame:
    """previous, next, position (from 1) and queue_length among rows of the same keys; rows with a null key or start have none."""
    w = Window.partitionBy(*keys).orderBy(*order)
    placed = df.dropna(subset=[*keys, order[0]])
    return placed.withColumns({
        "previous": F.lag(item).over(w), "next": F.lead(item).over(w), "position": F.row_number().over(w).cast("long"), "queue_length": F.count("*").over(Window.partitionBy(*keys)),
    })


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """The first n rows of each key with total, the number of its rows."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    totals = df.groupBy(*keys).agg(F.count("*").alias("total"))
    return ranked.where(F.col("rank") <= n).join(totals, list(keys))


def placed_orders(batches: DataFrame, order: str, line: str, pseudo: Sequence[str]) -> DataFrame:
    """Whether any batch of an order is on a real line, its lines in order, and its batches."""
    return batches.groupBy(order).agg(F.bool_or(~F.col(line).isin(*pseudo)).alias("placed"), F.array_join(F.array_sort(F.collect_set(line)), ",").alias("lines"), F.count("*").alias("n_batches"))
