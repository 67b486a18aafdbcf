"""Best-fit packing of token sequences by bin completion.

What can be packed depends on lengths only, so the search works on a histogram
with one count for each length up to the limit, whose size doesn't grow with
the input. It is a branch and bound over patterns: sets of lengths that fill
one sequence, each with the number of sequences that are filled so. A sequence
is completed around the largest length that is left: its fillings are
enumerated without those that another one dominates (a length in it could be
replaced by a larger one that is left), least waste first, and taken as often
as the counts allow or, as another branch, once. The best-fit solution of the
whole histogram is the first incumbent; at every node best fit completes what
has been chosen, and the better solution becomes the incumbent, so the result
is never worse than best fit. A branch ends when its waste is more than a
better solution could have. The search ends with a proof, when no bound allows
less, or after BUDGET; then the incumbent stands, and ``Packing.least`` tells
how few there could be. Each piece then finds its place from its rank among
the pieces of its length, which is counted in salted groups.
"""

from __future__ import annotations

import bisect
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

LIMIT, END = 1024, 2
#: Nodes of the search for the fillings of one sequence; work of the whole search, where a node costs one and the different lengths that are left.
NODES, BUDGET = 400, 150_000


def fillings(counts: np.ndarray, room: int, nodes: int) -> list[tuple[int, ...]]:
    """Undominated sets of lengths from ``counts`` that fit into ``room``, largest first, least waste first; after ``nodes`` nodes or a full one no more are looked for."""
    present = np.flatnonzero(counts[: room + 1])[::-1].tolist()
    out: list[tuple[int, tuple[int, ...]]] = []
    spent = 0

    def dominated(chosen: list[int], left: int) -> bool:
        own = dict(zip(*np.unique(chosen, return_counts=True), strict=True)) if chosen else {}
        # A length that is left takes the place of nothing, of one length or of two, with no more than the waste.
        sums = {0, *chosen, *(x + y for i, x in enumerate(chosen) for y in chosen[i + 1 :])}
        return any(x < y <= x + left and own.get(y, 0) < counts[y] for x in sums for y in range(x + 1, min(x + left, len(counts) - 1) + 1) if counts[y])

    def search(at: int, left: int, chosen: list[int]) -> bool:
        nonlocal spent
        spent += 1
        fits = False
        for i in range(at, len(present)):
            size = present[i]
            if size > left or (i == at and chosen and chosen[-1] == size and chosen.count(size) >= counts[size]):
                continue
            fits = True
            if search(i, left - size, [*chosen, size]) or spent > nodes:
                return True
        if not fits and not dominated(chosen, left):
            out.append((left, tuple(chosen)))
        return left == 0

    search(0, room, [])
    if not out:
        chosen, left = [], room
        for size in present:
            take = min(int(counts[size]), left // size)
            chosen += [size] * take
            left -= size * take
        out.append((left, tuple(chosen)))
    return [f for _, f in sorted(out, key=lambda x: (x[0], len(x[1])))]


def best_fit(counts: np.ndarray, limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used, by best fit: every length, largest first, goes where it leaves least room.

    Sequences of equal room are alike, so a length is placed in all of them at once.
    """
    rooms: list[int] = []
    by_room: dict[int, list[list]] = {}
    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        while left:
            at = bisect.bisect_left(rooms, size)
            old = by_room[rooms[at]][-1] if at < len(rooms) else None
            room, (pattern, there) = (rooms[at], old) if old else (limit, ((), left))
            # A sequence with least room keeps it until the length no longer fits.
            whole = min(there, left // (room // size))
            n, each = (whole, room // size) if whole else (1, left)
            if old:
                old[1] -= n
                if not old[1]:
                    by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[at]
            rest = room - each * size
            if rest not in by_room:
                bisect.insort(rooms, rest)
            by_room.setdefault(rest, []).append([(*pattern, *[size] * each), n])
            left -= n * each
    return [(pattern, n) for group in by_room.values() for pattern, n in group]


def least(counts: np.ndarray, limit: int) -> int:
    """A number of sequences that no solution is below: pieces of over half a sequence share none, and what doesn't fit beside them needs others."""
    size = np.arange(len(counts))
    n, tokens = np.append(0, np.cumsum(counts)), np.append(0, np.cumsum(counts * size))
    low = np.arange(limit // 2 + 1)
    half, high = limit // 2 + 1, limit - low + 1
    beside = (n[high] - n[half]) * limit - (tokens[high] - tokens[half])
    small = tokens[half] - tokens[np.minimum(low, half)]
    return int((n[-1] - n[half] + np.maximum(0, -(-(small - beside) // limit))).max())


@dataclass
class Packing:
    patterns: list[tuple[tuple[int, ...], int]]
    least: int  # no solution has fewer sequences

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.patterns)


def complete(counts: np.ndarray, limit: int, budget: int = 0) -> Packing:
    """As few sequences as the search finds within ``budget`` (BUDGET if not given), and the bound."""
    counts, budget = counts.copy(), budget or BUDGET
    total = int((counts * np.arange(len(counts))).sum())
    best = Packing(best_fit(counts, limit), least(counts, limit))
    fewest, chosen, waste, used, spent = best.sequences, [], 0, 0, 0

    def choices() -> Iterator[tuple[tuple[int, ...], int]]:
        largest = int(np.flatnonzero(counts)[-1])
        counts[largest] -= 1
        found = fillings(counts, limit - largest, NODES)
        counts[largest] += 1
        for filling in found:
            pattern = (largest, *filling)
            sizes, need = np.unique(pattern, return_counts=True)
            often = int((counts[sizes] // need).min())
            yield from {(pattern, often): 0, (pattern, 1): 0}

    def take(pattern: tuple[int, ...], times: int) -> None:
        for size in pattern:
            counts[size] -= times

    open_ = [choices()] if total else []
    while open_ and fewest > best.least and spent < budget:
        step = next(open_[-1], None)
        if step is None:
            open_.pop()
            if chosen:
                pattern, times = chosen.pop()
                take(pattern, -times)
                waste -= times * (limit - sum(pattern))
                used -= times
            continue
        pattern, times = step
        own = waste + times * (limit - sum(pattern))
        spent += 1
        # One sequence less than the incumbent has room for so much waste.
        if own > (fewest - 1) * limit - total:
            continue
        take(pattern, times)
        chosen.append(step)
        waste, used = own, used + times
        spent += int(np.count_nonzero(counts))
        rest = best_fit(counts, limit)
        found = used + sum(n for _, n in rest)
        if found < fewest:
            best, fewest = Packing([*chosen, *rest], best.least), found
        open_.append(choices() if rest and used + least(counts, limit) < fewest else iter(()))
    return best


def plan(counts: np.ndarray, limit: int) -> tuple[np.ndarray, ...]:
    """Places for all pieces of each length: (length, first rank, ranks, first sequence, offset); a rank is one sequence further."""
    out, sequence, given = [], 0, np.zeros(limit + 1, np.int64)
    for pattern, times in complete(counts, limit).patterns:
        offset = 0
        for size in pattern:
            out.append((size, int(given[size]), times, sequence, offset))
            given[size] += times
            offset += size
        sequence += times
    out.sort()
    return tuple(np.array(c, np.int64) for c in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(5))


def cut(length: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: of ``limit`` each, the first one may be shorter."""
    first = length % limit or min(length, limit)
    return [(0, first), *((s, limit) for s in range(first, length, limit))] if length else []


def encoder(ranks: str | None = None):
    """A function from text to ids, by the byte-level BPE whose ranks are in the file ``ranks``.

    The ids are those of the library tokenizers with the same vocabulary and without added special tokens; that
    library takes several times as long, so tests hold the two against each other and this one does the work. Its
    regex gives up on very long runs of white space; such a text goes to the library tokenizers whole.
    """
    import base64

    import public_tokenizers
    import tiktoken

    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={"<|endoftext|>": len(merges)})
    named = []

    def encode(text: str) -> list[int]:
        try:
            return bpe.encode(text, allowed_special="all")
        except ValueError as e:
            if "Regex error" not in str(e):
                raise
        if not named:
            from tokenizers import Tokenizer

            named.append(Tokenizer.from_file(f"{os.path.splitext(ranks)[0]}.json"))
        return named[0].encode(text, add_special_tokens=False).ids

    return encode


def tokenized(df: DataFrame, vocabulary: str | None = None, limit: int = LIMIT, end: int = END, text: str = "text") -> DataFrame:
    """Rows of ``df`` without the text, for each piece: piece, start, length, ids (binary, little-endian unsigned 32-bit)."""
    kept = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType([*kept, T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for whole in batches:
            lengths = whole.column(whole.schema.get_field_index(text))
            _, offsets = common.text_buffer(lengths)
            for a, b in common.chunks(offsets, 1 << 20):
                batch = whole.slice(a, b - a)
                texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
                row, rows = [], []
                for i, t in enumerate(texts):
                    ids = np.array([*encode(t), end], "<u4")
                    for k, (start, n) in enumerate(cut(len(ids), limit)):
                        row.append(i)
                        rows.append((k, start, n, ids[start : start + n].tobytes()))
                part = batch.select([f.name for f in kept]).take(pa.array(row, pa.int64()))
                made = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], schema.names)

    return df.mapInArrow(run, schema)


def packed(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``pieces`` (with length, from 1 to ``limit``) with sequence_id and offset: as few sequences of at most ``limit`` as the search finds.

    Sequences are numbered from 0 and offsets have no gaps. Rows of one length
    are alike, so equal rows and nulls in other columns don't matter; an empty
    table gives an empty table. Columns named sequence_id or offset are replaced.
    """
    pieces = common.without(pieces, "sequence_id", "offset")
    salt, rank_name, base_name = common.fresh(pieces, "salt", "rank", "base")
    # What a length's pieces are dealt into follows from their contents, so every read of them deals alike.
    salts = 8 * common.partitions(pieces.sparkSession)
    salted = common.written(pieces.withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in pieces.columns]), salts).cast("int")), "pieces")
    counts = common.written(salted.groupBy("length", salt).count(), "counts")
    base = counts.withColumn(base_name, F.sum("count").over(Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)))
    histogram = np.zeros(limit + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("count")).collect():
        histogram[length] = n
    places = salted.sparkSession.sparkContext.broadcast(plan(histogram, limit))
    rank = F.row_number().over(Window.partitionBy("length", salt).orderBy(*[F.col(f"`{c}`") for c in pieces.columns if c != "ids"])) - 1
    ranked = salted.withColumn(rank_name, rank.cast("long")).join(base.select("length", salt, F.coalesce(base_name, F.lit(0)).cast("long").alias(base_name)), ["length", salt])
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, first, _, sequence, offset = places.value
        order = size * (1 << 48) + first
        for batch in batches:
            length, r, own = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", rank_name, base_name))
            r = r + own
            at = np.searchsorted(order, length * (1 << 48) + r, "right") - 1
            keep = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence[at] + r - first[at], pa.int64()), pa.array(offset[at], pa.int64())], schema.names)

    return ranked.mapInArrow(place, schema)


@common.guarded("ids")
def pack_documents(df: DataFrame, limit: int = LIMIT, vocabulary: str | None = None, text: str = "text") -> DataFrame:
    """Pieces of all rows' token ids with their places: the columns of ``df`` but the text, and piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and one end token; null and empty texts are the end
    token alone. Only longer ones are cut. Other columns may hold nulls; those
    with the added names are replaced. An empty table gives an empty table.
    """
    df = common.without(df, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    pieces = tokenized(df, vocabulary, limit, END, text).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packed(pieces, limit)


def op6_query(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
