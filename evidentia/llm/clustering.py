"""Centroid clustering by sort-means.

Each round orders, for every centroid, the others by their distance from it. A
vector's scan begins at the centroid it had in the round before and goes along
that order; it stops strictly beyond twice the vector's distance from where it
began, since by the triangle inequality nothing that far can be nearer, or as
near with a smaller number. All of it is whole-number arithmetic on squared
distances, so results don't depend on how rows are dealt.

The vectors are written once a round with their clusters, as whole numbers
that dictionary encoding makes small, and the round before is deleted: a round
is one narrow pass and one partial aggregation of a row for each centroid, and
an executor that is lost costs no more than its tasks of one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

DIMENSIONS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Components are below this, so that squared distances fit into 64 bits.
BOUND = 1 << 27
#: Rows of one numpy batch.
ROWS = 1 << 13


def whole_vectors(df: DataFrame, vector: str, scale: int, dimensions: int) -> F.Column:
    """floor(scale * x) of each component as int; null unless there are ``dimensions`` components, all finite. Beyond BOUND: an error."""
    v, x = F.col(f"`{vector}`"), lambda x: F.floor(x.cast("double") * F.lit(float(scale)))
    finite = lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != F.lit(float("inf"))), F.lit(False))
    small = lambda c: F.abs(c.cast("double") * F.lit(float(scale))) < BOUND
    one = lambda c: F.when(small(c), x(c)).otherwise(F.raise_error(F.lit(f"a component is not below {BOUND} after scaling"))).cast("int")
    return F.when((F.size(v) == dimensions) & F.forall(v, finite), F.transform(v, one))


class Order:
    """Centroids and, for each, the others by distance from it."""

    def __init__(self, centroids: list[list[int]]):
        self.c = np.array(centroids, np.int64)
        self.gap = ((self.c[:, None, :] - self.c[None, :, :]) ** 2).sum(2)
        np.fill_diagonal(self.gap, -1)  # itself first
        self.by = np.argsort(self.gap, axis=1, kind="stable")[:, 1:]

    def assign(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid (ties: the smaller number), squared distance, and how many distances were computed."""
        best, distance, computed = start.copy(), np.empty(len(x), np.int64), len(x)
        for i in np.unique(start):
            rows = np.flatnonzero(start == i)
            from_start = self._squared(x[rows], i)
            near, at = from_start.copy(), np.full(len(rows), i)
            live = np.arange(len(rows))
            for j in self.by[i]:
                live = live[self.gap[i, j] <= 4 * from_start[live]]
                if not len(live):
                    break
                computed += len(live)
                d = self._squared(x[rows[live]], j)
                better = (d < near[live]) | ((d == near[live]) & (j < at[live]))
                near[live[better]], at[live[better]] = d[better], j
            best[rows], distance[rows] = at, near
        return best, distance, computed

    def _squared(self, x: np.ndarray, j: int) -> np.ndarray:
        gap = x - self.c[j]
        return np.einsum("ij,ij->i", gap, gap)


def assigned(df: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``df`` (with x, whole numbers) with cluster and distance; the scan begins at the cluster it has, or at 0."""
    kept = [f for f in df.schema.fields if f.name not in ("cluster", "distance")]
    schema = T.StructType([*kept, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    held = df.sparkSession.sparkContext.broadcast(Order(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = held.value
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.int64)
                start = batch.column("cluster").to_numpy().astype(np.int64) if "cluster" in batch.schema.names else np.zeros(len(x), np.int64)
                best, distance, _ = order.assign(x, start)
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(best, pa.int32()), pa.array(distance, pa.int64())], schema.names)

    return df.mapInArrow(run, schema)


def first_centroids(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The vectors with the k smallest sha256 of ``seed:id``; equal ids by their components, null ids last."""
    hashed = F.coalesce(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), F.lit("~"))
    return [list(r["x"]) for r in rows.select(hashed.alias("h"), "x").orderBy("h", "x").limit(k).collect()]


def moved(state: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid's new place: the floor of its vectors' exact mean; an empty one stays."""
    sums = [F.sum(F.col("x")[i].cast("long")).alias(f"s{i}") for i in range(len(centroids[0]))]
    out = list(centroids)
    for r in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():  # a row for each centroid
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(len(centroids[0]))]
    return out


def sort_means(
    df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, dimensions: int = DIMENSIONS, seed: int = SEED
) -> tuple[DataFrame, list[list[int]]]:
    """(id, x, cluster, distance) of each kept row of ``df``, and the final centroids.

    Kept are vectors of ``dimensions`` components of which none is null or
    non-finite. Null ids are ids like others, but come last when first
    centroids are chosen; repeated rows count each. With fewer vectors than
    ``k`` there are so many centroids; an empty table gives no rows. Other
    columns take no part, whatever they are called; ``cluster_table`` keeps them.
    """
    rows = df.select(F.col(f"`{vec_id}`").alias("id"), whole_vectors(df, vector, scale, dimensions).alias("x")).where("x is not null")
    state = common.written(rows, "vectors")
    centroids = first_centroids(state, k, seed)
    for _ in range(rounds if centroids else 0):
        after = common.written(assigned(state, centroids), "clusters")
        common.discard(state)
        state, centroids = after, moved(after, centroids)
    if not centroids:
        return state.withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long")}), centroids
    out = common.written(assigned(state, centroids), "clusters")
    common.discard(state)
    return out, centroids


def cluster_table(df: DataFrame, centroids: list[list[int]], vector: str = "embedding", scale: int = SCALE, dimensions: int = DIMENSIONS) -> DataFrame:
    """All rows and columns of ``df`` with cluster and distance by given centroids, in one narrow pass; both are null for vectors that are not kept, or without centroids.

    Columns of ``df`` with these two names are replaced; with x, they stay.
    """
    df = common.without(df, "cluster", "distance")
    (own,) = common.fresh(df, "x")
    back, names = {f"c{i}": c for i, c in enumerate(df.columns)}, [f"c{i}" for i in range(len(df.columns))]
    rows = df.select(whole_vectors(df, vector, scale, dimensions).alias(own), *[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names, strict=True)])
    none = rows.where(F.col(own).isNull() if centroids else F.lit(True)).select(*names, F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))
    if not centroids:
        return none.withColumnsRenamed(back)
    some = assigned(rows.where(F.col(own).isNotNull()).withColumnRenamed(own, "x"), centroids).select(*none.columns)
    return some.unionAll(none).withColumnsRenamed(back)


def op11_query(spark, sf_dir: str) -> DataFrame:
    import hashlib

    state, centroids = sort_means(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    by_cluster = {r["cluster"]: int(r["s"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    named = [Row(cluster=i, cluster_inertia=by_cluster.get(i, 0), inertia=sum(by_cluster.values()), centroid_sha256=hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    facts = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row for each of the few centroids
    return state.join(F.broadcast(facts), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
