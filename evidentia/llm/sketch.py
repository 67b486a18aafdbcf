"""Count-min sketches of 64-bit fingerprints: one for each partition, merged, kept as the cells counted twice or more.

A partition's sketch is sparse: for each row and segment of cells, the cells
counted once and those counted more often, sorted, as compressed differences.
Merging adds counts that stop at two, in rounds of at most FAN sketches, so no
task gathers more than FAN of them. What is left is a bit a cell, whose size
is bounded by MOST_BITS whatever the input is; on a larger input it lets more
fingerprints through, but it never loses a repeated one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS, SEGMENT_BITS, LEAST_BITS, MOST_BITS, FAN, FLUSH = 2, 20, 20, 29, 256, 1 << 21
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    x = h ^ (h >> np.uint64(31))
    x *= _SEEDS[row]
    return (x >> np.uint64(64 - bits)).astype(np.uint32)


def _pack(cells: np.ndarray) -> bytes:
    return zstandard.compress(np.diff(cells, prepend=np.uint32(0)).astype("<u4").tobytes(), 1)


def _unpack(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(blob), "<u4"), dtype=np.uint32)


def bits_for(items: int) -> int:
    """The cells of a row, as a power of two: four times the expected items, within the bounds."""
    return int(min(MOST_BITS, max(LEAST_BITS, np.ceil(np.log2(max(1, 4 * items))))))


def partition_sketches(df: DataFrame, fingerprints: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, rows=range(ROWS), passed=None) -> DataFrame:
    """Rows (part, row, segment, once, more) of each partition's sketch; ``fingerprints`` gives uint64 arrays of a batch.

    ``passed``: a broadcast ``Repeated``; what it rules out isn't counted.
    """

    def flush(part: int, held: list[np.ndarray]) -> pa.RecordBatch:
        h, out = np.concatenate(held), []
        for row in rows:
            cells = np.sort(_cells(h, row, bits))
            new = np.append(True, cells[1:] != cells[:-1])
            at = np.flatnonzero(new)
            cells, more = cells[at], np.diff(np.append(at, len(new))) > 1
            cuts = np.searchsorted(cells, np.arange(0, (1 << bits) + 1, 1 << SEGMENT_BITS, dtype=np.int64))
            for s in np.flatnonzero(np.diff(cuts)):
                own, twice = cells[cuts[s] : cuts[s + 1]] & np.uint32((1 << SEGMENT_BITS) - 1), more[cuts[s] : cuts[s + 1]]
                out.append((part, row, int(s), _pack(own[~twice]), _pack(own[twice])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "row", "segment", "once", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, n = TaskContext.get().partitionId(), [], 0
        for batch in batches:
            for h in fingerprints(batch):
                if passed is not None:
                    h = h[passed.value(h)]
                held.append(h)
                n += len(h)
                if n >= FLUSH:
                    yield flush(part, held)
                    held, n = [], 0
        if n:
            yield flush(part, held)

    return df.mapInArrow(run, "part int, row int, segment int, once binary, more binary")


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    count = np.zeros(1 << SEGMENT_BITS, np.uint8)
    for once, more in zip(group["once"], group["more"], strict=True):
        at = _unpack(once)
        count[at] = np.minimum(count[at] + 1, 2)
        count[_unpack(more)] = 2
    first = group.iloc[0]
    return pd.DataFrame({"part": [int(first["part"])], "row": [int(first["row"])], "segment": [int(first["segment"])], "once": [_pack(np.flatnonzero(count == 1).astype(np.uint32))], "more": [_pack(np.flatnonzero(count == 2).astype(np.uint32))]})


def _bits(cells: np.ndarray) -> np.ndarray:
    """A segment's cells, a bit each."""
    bitmap = np.zeros(1 << SEGMENT_BITS, bool)
    bitmap[cells] = True
    return np.packbits(bitmap, bitorder="little")


class Repeated:
    """Which fingerprints were counted twice or more, by estimate: all that were, and some others.

    The driver gathers segments of cells as they come, compressed, and sends them so; a task has them as a bit a cell.
    """

    def __init__(self, bits: int):
        self.bits, self.segments, self.maps = bits, {}, None

    def __getstate__(self):
        return self.bits, self.segments

    def __setstate__(self, state):
        self.bits, segments = state
        self.segments, self.maps = None, self._unpacked(segments)

    def add(self, row: int, segment: int, more: bytes) -> None:
        """``more``: a segment's cells, packed. Where bits are smaller, they are kept, so a row has a bound."""
        dense = len(more) > 1 << (SEGMENT_BITS - 3)
        self.segments[row].append((segment, dense, zstandard.compress(_bits(_unpack(more)).tobytes(), 1) if dense else more))

    def count(self, row: int) -> None:
        """From now on ``row`` is asked, also where no cell of it was counted twice."""
        self.segments[row] = []

    def _unpacked(self, segments: dict) -> dict[int, np.ndarray]:
        maps, size = {}, 1 << (SEGMENT_BITS - 3)
        for row, own in segments.items():
            maps[row] = np.zeros(1 << (self.bits - 3), np.uint8)
            for segment, dense, blob in own:
                maps[row][segment * size : (segment + 1) * size] = np.frombuffer(zstandard.decompress(blob), np.uint8) if dense else _bits(_unpack(blob))
        return maps

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for row, bits in (self.maps if self.maps is not None else self._unpacked(self.segments)).items():
            c = _cells(h, row, self.bits)
            out &= (bits[c >> np.uint32(3)] >> (c & np.uint32(7)).astype(np.uint8)) & 1 == 1
        return out


def repeated(df: DataFrame, fingerprints, items: int, cascade: bool = False):
    """A broadcast ``Repeated`` of all fingerprints of ``df``, of which there are about ``items``.

    With ``cascade`` the second row counts only what the first row estimates
    as repeated, in a scan of its own: fewer cells are moved, and fewer
    fingerprints that occur once are let through.
    """
    spark, held = df.sparkSession, None
    bits = bits_for(items)
    out = Repeated(bits)
    for counted in ([0], [1]) if cascade else (range(ROWS),):
        rows, parts = partition_sketches(df, fingerprints, bits, counted, held), df.rdd.getNumPartitions()
        while True:
            rows = rows.withColumn("part", F.expr(f"cast(part div {FAN} as int)")).groupBy("part", "row", "segment").applyInPandas(_merge, rows.schema)
            parts = -(-parts // FAN)
            if parts <= 1:
                break
        for row in counted:
            out.count(row)
        for r in rows.select("row", "segment", "more").toLocalIterator(prefetchPartitions=True):
            out.add(r["row"], r["segment"], bytes(r["more"]))
        if held is not None:
            held.unpersist()
        held = spark.sparkContext.broadcast(out)
    return held
