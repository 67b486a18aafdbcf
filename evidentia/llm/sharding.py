"""Uniform sharding with exact sizes, by a hypergeometric communication matrix.

The rows of a uniform random permutation that go from input partition p to
output cell c number M[p, c]; the matrix M follows the multivariate
hypergeometric law with the partitions' and the cells' sizes as margins. So M
is drawn first, each partition permutes its rows and deals out exactly M[p, c]
of them to cell c, and each cell permutes what it got. A cell is a block of
consecutive slots of one shard, so that no task holds a whole shard.

M has as many rows as there are partitions and is never built as a whole: the
partitions are halved again and again, each halving draws the left half's row
from a generator seeded by the halving itself, and a task walks only the
log2(P) halvings above its own partition. All tasks agree, a repeated task
draws the same, and the driver holds one number a partition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Above this, numpy's own draws are refused and ``_hypergeometric`` draws.
NUMPY_MOST = 1_000_000_000


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """One draw: by numpy, or for larger populations by inversion of the distribution's terms within 12 standard deviations of its mode.

    A term follows from the one before by (good - k)(sample - k) / ((k + 1)(bad - sample + k + 1)).
    """
    total, low, high = good + bad, max(0, sample - bad), min(good, sample)
    if low == high:
        return low
    if total < NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, sample))
    mode = (sample + 1) * (good + 1) // (total + 2)
    reach = 20 + int(12 * math.sqrt(sample * (good / total) * (bad / total) * ((total - sample) / (total - 1))))
    first, last = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(first, last, dtype=float)
    steps = np.log(good - k) + np.log(sample - k) - np.log(k + 1) - np.log(bad - sample + k + 1)
    terms = np.concatenate([[0.0], np.cumsum(steps)])
    up = np.cumsum(np.exp(terms - terms.max()))
    return first + int(np.searchsorted(up, rng.random() * up[-1], "right"))


def _split(rng: np.random.Generator, cells: np.ndarray, sample: int) -> np.ndarray:
    """How many of ``sample`` rows, drawn from ``cells`` without replacement, are of each cell."""
    left = int(cells.sum())
    if left < NUMPY_MOST:
        return rng.multivariate_hypergeometric(cells, sample, method="marginals")
    out = np.zeros_like(cells)
    for i, c in enumerate(cells.tolist()):
        out[i] = _hypergeometric(rng, c, left - c, sample)
        sample -= int(out[i])
        left -= c
    return out


def matrix_row(sizes: np.ndarray, cells: np.ndarray, p: int, seed: int) -> np.ndarray:
    """Row p of the communication matrix: the rows that partition p gives to each cell."""
    lo, hi, before = 0, len(sizes), np.concatenate([[0], np.cumsum(sizes)])
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = _split(np.random.default_rng([seed, lo, hi]), cells, int(before[mid] - before[lo]))
        cells, lo, hi = (left, lo, mid) if p < mid else (cells - left, mid, hi)
    return cells


def cell_sizes(n: int, shards: int, cell_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard, first slot and size of each cell: shards differ by one row at most, and so do a shard's cells."""
    blocks = max(1, -(-n // (shards * cell_rows)))
    of_shard = np.full(shards, n // shards, np.int64) + (np.arange(shards) < n % shards)
    size = np.concatenate([np.full(blocks, s // blocks, np.int64) + (np.arange(blocks) < s % blocks) for s in of_shard.tolist()])
    start = np.concatenate([[0], np.cumsum(size)[:-1]]) - np.repeat(np.concatenate([[0], np.cumsum(of_shard)[:-1]]), blocks)
    return np.repeat(np.arange(shards), blocks), start, size


def hypergeometric_shards(df: DataFrame, shards: int = 16, seed: int = 17, cell_rows: int = 20_000) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in its shard): a uniform shuffle.

    Shard sizes differ by one row at most. Nulls, equal rows and rows of any
    length are rows like others. An empty input gives an empty result. Columns
    of ``df`` named shard or slot are replaced. A task holds one cell, of
    ``cell_rows`` rows at most.
    """
    df = common.without(df, "shard", "slot")
    part, place, cell_name = common.fresh(df, "part", "place", "cell")
    common.shared_dir(df.sparkSession)
    # The same rows must lie in the same partitions, in the same order, when they are counted and when they are dealt.
    held = df.withColumn(part, F.spark_partition_id()).checkpoint()
    counts = dict(held.groupBy(part).count().collect())
    n = sum(counts.values())
    sizes = np.zeros(max(counts, default=-1) + 1, np.int64)
    for p, c in counts.items():
        sizes[p] = c
    shard, start, size = cell_sizes(n, shards, cell_rows)
    schema = T.StructType([*held.schema.fields, T.StructField(place, T.LongType()), T.StructField(cell_name, T.IntegerType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cells = 0, None
        for batch in batches:
            if batch.num_rows and cells is None:
                p = batch.column(batch.schema.get_field_index(part))[0].as_py()
                cells = np.repeat(np.arange(len(size), dtype=np.int32), matrix_row(sizes, size, p, seed))
                np.random.default_rng([seed, p, 1]).shuffle(cells)
            if batch.num_rows:
                own = [pa.array(np.arange(at, at + batch.num_rows)), pa.array(cells[at : at + batch.num_rows])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *own], [*batch.schema.names, place, cell_name])
                at += batch.num_rows

    names = df.columns

    def permute(cell: pa.Table) -> pa.Table:
        c = cell[cell_name][0].as_py()
        cell = cell.sort_by([(part, "ascending"), (place, "ascending")])
        slots = start[c] + np.random.default_rng([seed, c, 2]).permutation(cell.num_rows)
        own = [pa.array(np.full(cell.num_rows, shard[c], np.int32)), pa.array(slots)]
        return pa.Table.from_arrays([*(cell[x] for x in names), *own], [*names, "shard", "slot"])

    out = T.StructType([*df.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return held.mapInArrow(deal, schema).groupBy(cell_name).applyInArrow(permute, out)


def op7_query(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = common.documents(spark, sf_dir).select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    return hypergeometric_shards(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
