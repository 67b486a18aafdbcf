"""Values in ranges of a table, by an equi-join.

A range of width w belongs to the level l with 2^(l-1) < w <= 2^l and is in two
bins of that level at most; a value is in one bin of every level that occurs.
Levels are few, as they are exponents; so neither side is multiplied by more,
and nothing is compared but what shares a bin.

Where only a number and a least value are asked for each range, pairs aren't
made: distinct values have ranks, a range is a run of ranks, its number is a
difference of running sums, and its least one is that of a few aligned blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared


def bounds(df: DataFrame, low: str | None = None, high: str | None = None, exact: str | None = None) -> DataFrame:
    """``df`` with _low and _high: its range columns where a row has both, else its exact value; an error if it has neither kind of column."""
    names = {c.lower(): c for c in df.columns}
    pick = lambda c: F.col(f"`{names[c.lower()]}`").cast("double") if c and c.lower() in names else None
    a, b, e = pick(low), pick(high), pick(exact)
    if a is None or b is None:
        a = b = None
    if a is None and e is None:
        raise ValueError(f"no range and no exact column among {', '.join(df.columns)}")
    if a is None:
        return df.withColumns({"_low": e, "_high": e})
    both = a.isNotNull() & b.isNotNull()
    other = e if e is not None else F.lit(None).cast("double")
    return df.withColumns({"_low": F.when(both, a).otherwise(other), "_high": F.when(both, b).otherwise(other)})


def in_ranges(values: DataFrame, value: str, table: DataFrame, low: str | None = None, high: str | None = None, exact: str | None = None) -> DataFrame:
    """Each row of ``values`` with each row of ``table`` in whose range, ends included, or at whose exact value it is.

    Null and NaN values, and ranges with a null end or that end before they begin, meet nothing. Columns of one name are told apart
    as in any join. The rows of many equal ranges or values all come out, as they would of a nested loop.
    """
    ranged = bounds(table, low, high, exact).where("_low <= _high and not isnan(_low) and not isnan(_high)")
    width = F.col("_high") - F.col("_low")
    # A point has a level of its own, where the bin is the value.
    levelled = ranged.withColumn("_level", F.when(width > 0, F.ceil(F.log2(width)).cast("int")))
    levels = [r["_level"] for r in levelled.select("_level").distinct().collect()]  # exponents: some two thousand at most
    size = F.pow(F.lit(2.0), F.col("_level"))
    first, last = F.floor(F.col("_low") / size).cast("double"), F.floor(F.col("_high") / size).cast("double")
    spread = F.array_distinct(F.array(first, first + 1, last))  # first + 1 may be beyond it, where nothing is in the range
    placed = levelled.withColumn("_bin", F.explode(F.when(F.col("_level").isNull(), F.array(F.col("_low") + 0.0)).otherwise(spread))).withColumn("_level", F.coalesce("_level", F.lit(1 << 20)))
    own = values.withColumn("_value", F.col(f"`{value}`").cast("double")).where("_value is not null and not isnan(_value)")
    bins = [F.struct(F.lit(1 << 20).alias("l"), (F.col("_value") + 0.0).alias("b")) if n is None else F.struct(F.lit(n).alias("l"), F.floor(F.col("_value") / F.lit(2.0**n)).cast("double").alias("b")) for n in levels]
    if not bins:
        bins = [F.struct(F.lit(1 << 20).alias("l"), F.col("_value").alias("b"))]
    probes = own.withColumn("_p", F.explode(F.array(*bins))).withColumns({"_level": F.col("_p.l"), "_bin": F.col("_p.b")}).drop("_p")
    return probes.join(placed, ["_level", "_bin"]).where("_value between _low and _high").drop("_level", "_bin", "_value", "_low", "_high")


def _ranked(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(x, side, rank, upto, m): ``points`` (x, n, m), side 1, and the ends of ``spans``, sides 0 and 2, with the numbers of points and of rows up to them.

    All are sorted by ranges, so no task sorts them alone; only the tasks' sums meet.
    """
    end = lambda c, side: spans.select(F.col(c).alias("x")).distinct().select("x", F.lit(side).alias("side"))
    every = points.withColumn("side", F.lit(1)).unionByName(end("_low", 0), allowMissingColumns=True).unionByName(end("_high", 2), allowMissingColumns=True)
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = shared.stored(every.repartitionByRange(parts, "x").withColumn("part", F.spark_partition_id()), "ranks")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    sums = placed.groupBy("part").agg(F.count("n").alias("p"), F.sum("n").alias("q")).select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in "pq"])
    upto = Window.partitionBy("part").orderBy("x", "side").rowsBetween(Window.unboundedPreceding, 0)
    counted = placed.withColumns({"p": F.count("n").over(upto), "q": F.coalesce(F.sum("n").over(upto), F.lit(0))})
    return counted.join(F.broadcast(sums), "part").select("x", "side", (F.col("p0") + F.col("p")).alias("rank"), (F.col("q0") + F.col("q")).alias("upto"), "m")


def summary(values: DataFrame, value: str, least: str, table: DataFrame, low: str | None = None, high: str | None = None, exact: str | None = None) -> DataFrame:
    """``table`` with n and first, the number and the smallest ``least`` of the rows of ``in_ranges`` that each of its rows has there; rows without any are left out.

    Work grows with both tables, not with their pairs.
    """
    ranged = bounds(table, low, high, exact).where("_low <= _high and not isnan(_low) and not isnan(_high)").withColumns({"_low": F.col("_low") + 0.0, "_high": F.col("_high") + 0.0})
    own = values.select((F.col(f"`{value}`").cast("double") + 0.0).alias("x"), F.col(f"`{least}`").alias("m")).where("x is not null and not isnan(x)")
    points = own.groupBy("x").agg(F.count("*").alias("n"), F.min("m").alias("m"))
    ranked = shared.stored(_ranked(points, ranged.select("_low", "_high")), "ranked")
    end = lambda side, c, x: ranked.where(F.col("side") == side).select(F.col("x").alias(c), F.col("rank").alias(x), F.col("upto").alias(f"n{x}"))
    runs = ranged.select("_low", "_high").distinct().join(end(0, "_low", "a"), "_low").join(end(2, "_high", "b"), "_high").where("a < b")
    levels = f"sequence(0, {max(1, ranked.where('side = 1').count()).bit_length()})"
    # The points a to b - 1 are aligned blocks of 2^k, of each size one on either side at most.
    first, last = "shiftright(a + shiftleft(1L, k) - 1, k)", "shiftright(b, k)"
    left = f"if({first} < {last} and {first} % 2 = 1, struct(k as k, {first} as i), null)"
    right = f"if({first} < {last} and {last} % 2 = 1, struct(k as k, {last} - 1 as i), null)"
    asked = runs.withColumn("block", F.expr(f"explode(filter(flatten(transform({levels}, k -> array({left}, {right}))), x -> x is not null))")).select("_low", "_high", (F.col("nb") - F.col("na")).alias("n"), "block.k", "block.i")
    blocks = ranked.where("side = 1").select(F.expr(f"explode(transform({levels}, k -> struct(k as k, shiftright(rank - 1, k) as i)))").alias("block"), "m").groupBy("block.k", "block.i").agg(F.min("m").alias("m"))
    found = asked.join(blocks, ["k", "i"]).groupBy("_low", "_high").agg(F.first("n").alias("n"), F.min("m").alias("first"))
    return ranged.join(found, ["_low", "_high"]).drop("_low", "_high")
