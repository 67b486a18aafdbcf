"""Reading a plan for many requests at once: the batches of an order with their neighbours, or the queue of a line."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text

from . import queue, shared
from .dispatch import given


def read_plan(requests: DataFrame, batches: DataFrame, pseudo: Sequence[str] = (), limit: int = 20) -> DataFrame:
    """(req, way, rank, batch, asked_stage, previous, next, position, queue_length, placed, total) for ``requests`` (req, order_no, line, stage).

    ``batches``: (batch, order_no, line, stage, seq, started). An order goes before a line. ``order``: all its batches by seq, also where
    a stage is asked for, as what decides is often in another one; asked_stage marks those of it, and an order without any is told as
    ``order: no such stage``. Neighbours are the batches before and after in time on the same line and stage; one that hasn't started has
    none. placed: whether any batch is on a line that isn't of ``pseudo``. ``line``: the first ``limit`` batches of the line, of the
    stage if one is given, by start, those without last. Keys are compared normalized; ties go by batch. Other ways: ``order: nothing``,
    ``line: nothing``, ``input error``.
    """
    key = lambda c: text.normalize_key(F.col(c))
    asked = requests.select("req", F.when(given("order_no"), key("order_no")).alias("o"), F.when(given("line"), key("line")).alias("l"), F.when(given("stage"), key("stage")).alias("s"))
    asked = asked.withColumn("way", F.when(F.col("o").isNotNull(), "order").when(F.col("l").isNotNull(), "line").otherwise("input error"))
    rows = batches.select("batch", "order_no", "line", "stage", "seq", "started")
    # Neighbours are found on whole rows, which are stored: none is joined to its batch again, and both ways read the same rows. Keys are made
    # after them, and take the places of the texts, so no text is moved or stored twice.
    near = queue.neighbors(rows, ["stage", "line"], ["started", "batch"], "batch")
    odd = {"float", "double"}
    unplaced = reduce(or_, [F.col(c).isNull() | F.isnan(c) if t in odd else F.col(c).isNull() for c, t in rows.dtypes if c in ("stage", "line", "started")])
    real = (~F.coalesce(F.col("line").isin(*pseudo), F.lit(True))).alias("real")
    keyed = near.unionByName(rows.where(unplaced), allowMissingColumns=True)
    rows = shared.stored(keyed.select("batch", key("order_no").alias("_o"), key("line").alias("_l"), key("stage").alias("_s"), "seq", "started", real, "previous", "next", "position", "queue_length"), "batches")

    # Equal questions are answered once.
    own = asked.where("way = 'order'").select("o", "s").distinct().join(rows.withColumnRenamed("_o", "o"), "o")
    every = Window.partitionBy("o", "s")
    ordered = own.withColumns({
        "asked_stage": F.when(F.col("s").isNotNull(), F.coalesce(F.col("s") == F.col("_s"), F.lit(False))), "rank": F.row_number().over(every.orderBy("seq", "batch")), "total": F.count("*").over(every),
        "placed": F.bool_or("real").over(every),
    }).withColumn("fits", F.coalesce(F.bool_or("asked_stage").over(every), F.lit(True)))
    there = ["rank", "batch", "asked_stage", "previous", "next", "position", "queue_length", "placed", "total"]
    first = asked.where("way = 'order'").join(ordered.select("o", "s", "fits", *there), (asked["o"] == ordered["o"]) & asked["s"].eqNullSafe(ordered["s"]), "left").select("req", "way", "fits", *there)
    told = first.where("fits").select("req", "way", *there)
    none = first.where("not coalesce(fits, false)").select("req", F.when(F.col("fits").isNull(), "order: nothing").otherwise("order: no such stage").alias("way")).distinct()

    lines = asked.where("way = 'line'").select("l", "s").distinct().join(rows.withColumnRenamed("_l", "l"), "l").where("s is null or s = _s")
    whole = Window.partitionBy("l", "s")
    queued = lines.withColumns({"rank": F.row_number().over(whole.orderBy(F.asc_nulls_last("started"), "batch")), "total": F.count("*").over(whole)}).where(F.col("rank") <= limit)
    second = asked.where("way = 'line'").join(queued.select("l", "s", "rank", "batch", "total"), (asked["l"] == queued["l"]) & asked["s"].eqNullSafe(queued["s"]), "left")
    second = second.select("req", F.when(F.col("batch").isNull() & F.col("rank").isNull(), "line: nothing").otherwise("line").alias("way"), "rank", "batch", "total")
    rest = asked.where("way = 'input error'").select("req", "way")
    return told.unionByName(second, allowMissingColumns=True).unionByName(none.unionByName(rest), allowMissingColumns=True)
