"""Embedding whitening by a tiled covariance.

The distinct vectors are cut into row-blocks, and each row-block into column
blocks of TILE dimensions. Column blocks are shuffled by row-block; a task
multiplies, for each row-block that it gets, the pairs of column blocks of
every tile key and sums each tile's products over its row-blocks, so it sends
one partial tile for each key, however many rows it saw. Partial tiles are
summed by key, and the driver assembles the matrix and takes its eigenvectors:
what it holds is the square of the dimension, whatever the number of rows.

Vectors are whole numbers. They are centred on the whole number nearest each
dimension's mean before they are multiplied, and all sums are of whole numbers,
so the covariance is the exact one, rounded once, for any dealing of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SCALE, COMPONENTS = 256, 4
#: Dimensions of a tile's side, and rows of a row-block.
TILE, ROWS = 16, 1 << 11
#: Scaled components are below this, so that they are exact as doubles and as longs.
BOUND = 1 << 48


def whole_vectors(df: DataFrame, vector: str, scale: int) -> F.Column:
    """floor(scale * c) of each entry as long; null for a null vector, or one with null or non-finite entries. Beyond BOUND: an error."""
    v = F.col(f"`{vector}`")
    scaled = lambda c: c.cast("double") * F.lit(float(scale))
    finite = lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != F.lit(float("inf"))), F.lit(False))
    one = lambda c: F.when(F.abs(scaled(c)) < float(BOUND), F.floor(scaled(c))).otherwise(F.raise_error(F.lit(f"an entry is not below {BOUND} after scaling"))).cast("long")
    return F.when(F.forall(v, finite), F.transform(v, one))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(n, -1)


def column_blocks(fit: DataFrame, centre: list[int], tile: int, rows: int) -> DataFrame:
    """(row_block, column_block, n, values) of the vectors less ``centre``; values are little-endian 64-bit, row by row.

    A row-block is named by the partition and its number in it; ``fit`` is a written table, so a task that runs again names it alike.
    """
    held = fit.sparkSession.sparkContext.broadcast(np.array(centre, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = TaskContext.get().partitionId() << 40
        for whole in batches:
            for a in range(0, whole.num_rows, rows):
                batch = whole.slice(a, rows)
                x = _matrix(batch.column("x"), batch.num_rows) - held.value
                blocks = [np.ascontiguousarray(x[:, b : b + tile]).astype("<i8").tobytes() for b in range(0, x.shape[1], tile)]
                n = len(blocks)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([len(x)] * n, pa.int32()), pa.array(blocks, pa.binary())], ["row_block", "column_block", "n", "values"])
                name += 1

    return fit.mapInArrow(run, "row_block long, column_block int, n int, values binary")


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b of whole numbers, exactly, as Python integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * len(a)
    if most < 1 << 53:
        return (a.astype(np.float64).T @ b.astype(np.float64)).astype(np.int64).astype(object)
    return (a.T @ b).astype(object) if most < 1 << 62 else a.astype(object).T @ b.astype(object)


def dimension_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension; every task sends one partial sum a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, 0
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                sums = sums + _matrix(batch.column("x"), batch.num_rows).sum(0).astype(object)
                n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array([n] * len(sums), pa.int64()), decimals(sums)], ["place", "n", "value"])

    got = fit.mapInArrow(run, "place int, n long, value decimal(38,0)").groupBy("place").agg(F.sum("n").alias("n"), F.sum("value").alias("value")).orderBy("place").collect()
    return (got[0]["n"], [int(r["value"]) for r in got]) if got else (0, [])


def tile_sums(blocks: DataFrame) -> DataFrame:
    """(a, b, place, value): each entry of the tile of column blocks a <= b, summed over all row-blocks."""
    schema = "a int, b int, place int, value decimal(38,0)"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        at, held = None, []

        def multiply() -> None:
            for i, a in enumerate(held):
                for j in range(i, len(held)):
                    tile = product(a, held[j])
                    sums[i, j] = sums[i, j] + tile if (i, j) in sums else tile

        for batch in batches:
            for name, n, values in zip(*(batch.column(c).to_pylist() for c in ("row_block", "n", "values")), strict=True):
                if name != at:
                    multiply()
                    at, held = name, []
                held.append(np.frombuffer(values, "<i8").reshape(n, -1))
        multiply()
        for (i, j), tile in sums.items():
            n = tile.size
            yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int32()), pa.array([j] * n, pa.int32()), pa.array(range(n), pa.int32()), decimals(tile.ravel())], ["a", "b", "place", "value"])

    shuffled = blocks.repartition("row_block").sortWithinPartitions("row_block", "column_block")
    return shuffled.mapInArrow(run, schema).groupBy("a", "b", "place").agg(F.sum("value").alias("value"))


def decimals(values) -> pa.Array:
    """Whole numbers as decimal(38,0)."""
    import decimal

    return pa.array([decimal.Decimal(int(v)) for v in values], pa.decimal128(38, 0))


@dataclass
class Whitening:
    n: int
    sums: list[int]
    centre: list[int]  # the whole number nearest each mean
    values: np.ndarray  # falling eigenvalues of the components kept
    vectors: np.ndarray  # their unit eigenvectors, a column each
    trace: float

    def explained(self) -> list[float]:
        return (self.values / self.trace).tolist()

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Whitened components of whole-number vectors, and their deviations, exactly."""
        # Both differences are small, so nothing cancels however far the mean is from zero.
        rest = np.array([float(Fraction(s, self.n) - c) for s, c in zip(self.sums, self.centre, strict=True)])
        near = x - np.array(self.centre, np.int64)
        own = np.array([s - self.n * c for s, c in zip(self.sums, self.centre, strict=True)], object)
        w = ((near - rest) @ self.vectors) / np.sqrt(self.values)
        most = (float(self.n) * float(np.abs(near).max(initial=0)) + float(max(map(abs, own), default=0))) ** 2 * max(1, x.shape[1])
        gap = self.n * near - own.astype(np.int64) if most < 1 << 62 else self.n * near.astype(object) - own
        return w, (gap * gap).sum(1).tolist()


def fit_whitening(fit: DataFrame, components: int = COMPONENTS, tile: int = TILE, rows: int = ROWS) -> Whitening | None:
    """The whitening of the vectors x of ``fit``, a written table of one row each, all of one dimension; None without rows.

    Components whose eigenvalue is zero but for rounding can't be scaled to one and are left out.
    """
    n, sums = dimension_sums(fit)
    d = len(sums)
    if not d:
        return None
    centre = [round(Fraction(s, n)) for s in sums]
    moments = [[0] * d for _ in range(d)]
    for r in tile_sums(column_blocks(fit, centre, tile, rows)).toLocalIterator():  # d * (d + tile) / 2 entries
        width = min(tile, d - r["b"] * tile)
        i, j = r["a"] * tile + r["place"] // width, r["b"] * tile + r["place"] % width
        moments[i][j] = moments[j][i] = int(r["value"])
    own = [s - n * c for s, c in zip(sums, centre, strict=True)]
    covariance = np.array([[float(Fraction(n * moments[i][j] - own[i] * own[j], n * n)) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(covariance)
    keep = [i for i in range(d - 1, max(-1, d - 1 - components), -1) if values[i] > d * np.finfo(float).eps * values[-1] and values[i] > 0]
    return Whitening(n, sums, centre, values[keep], vectors[:, keep], float(np.trace(covariance)))


def whitened(df: DataFrame, model: Whitening) -> DataFrame:
    """``df`` (with x) with deviation and whitened, an array with a value for each component; one narrow pass."""
    schema = T.StructType([*df.schema.fields, T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    held, k = df.sparkSession.sparkContext.broadcast(model), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                w, deviation = held.value(_matrix(batch.column("x"), batch.num_rows))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * k, pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, decimals(deviation), lists], schema.names)

    return df.mapInArrow(run, schema)


def whiten(df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", components: int = COMPONENTS, scale: int = SCALE, tile: int = TILE) -> tuple[DataFrame, Whitening | None, float]:
    """(id, x, deviation, whitened) of the remaining rows of ``df``, the whitening, and the largest error of the fit list's whitened covariance.

    Rows whose vector is null or has null or non-finite entries are left out,
    and so are those of another dimension than most rows have (of equally many:
    the larger dimension), as no covariance has them both. Equal vectors count once
    in the fit, but all rows are whitened; null and repeated ids stay. Without a
    component (an empty table, or all vectors equal) there are no rows. Other columns
    take no part, whatever they are called.
    """
    x = whole_vectors(df, vector, scale)
    rows = df.select(F.col(f"`{vec_id}`").alias("id"), x.alias("x")).where("x is not null")
    # Sizes are of the vectors themselves, so this scan computes nothing of the kind.
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = sizes[0]["d"] if sizes else 0
    rows = rows.where(F.size("x") == d)
    fit = common.written(rows.select("x").distinct(), "distinct")
    model = fit_whitening(fit, components, tile) if d else None
    if model is None or not len(model.values):
        return rows.where("false").selectExpr("*", "cast(null as decimal(38,0)) as deviation", "cast(null as array<double>) as whitened"), model, 0.0
    k = len(model.values)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    w = whitened(fit, model)
    got = w.agg(*[F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]).alias(f"c{i}_{j}") for i, j in pairs]).collect()[0]
    error = max(abs((got[f"c{i}_{j}"] or 0.0) - (i == j)) for i, j in pairs)
    common.discard(fit)
    return whitened(rows, model), model, error


def op12_query(spark, sf_dir: str) -> DataFrame:
    rows, model, error = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    n, explained = (model.n, model.explained()) if model else (0, [])
    shares = F.array(*map(F.lit, explained)) if explained else F.array(F.lit(0.0))
    return rows.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        F.col("id").alias("vec_id"), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"),
        "whitened", shares[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"),
    )
