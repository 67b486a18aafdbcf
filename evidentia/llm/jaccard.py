"""N-gram Jaccard join by parity sketches: which shingle sets have a Jaccard index of at least a threshold, as components.

Linked sets of sizes a and b differ in at most D(a, b) shingles. Shingles are
dealt by hash into K blocks, K by band of sizes, and each block's shingles are
XORed into a wide bit sketch, of which a 64-bit linear code is kept. A shingle
that only one set has changes one block, so sketches lie no further apart than
sets do, and linked sets agree in K - D blocks or more (pigeonhole). Blocks
have an order that follows from their content alone (more shingles first, then
a hash): of two linked sets' common blocks the first is among the D + 1 first
blocks of both. So a set joins by these only, and light or empty blocks, which
unrelated sets have in common by chance, seldom take part.

Sets that share a block form a group. Groups of over TILE members are dealt
into parts that have one member in common. Pairs of a group meet in three
rounds, each by long parity sketches first and then exactly, by their texts:
each set with the nearest smaller one; the nearest pair of each two components
that a group still holds; then all pairs of different components that sketches
allow. Near copies share many blocks, by which each would meet the others over
and over: sets that are in SHARED groups together make a cluster that stands
for all groups inside it, of any size, where that takes at most half as many
rows (what is not inside meets as before). Of other groups in parts that still
hold several components there are two kinds. Where members have DENSE or more of them in common, as near copies
have, the groups that overlap become one cluster, so that a pair meets once
and not in each: at first in DENSE groups at most, and then the cluster's parts
meet by twos. Others, such as those of
a passage in many documents, are grouped anew by blocks of another hash, LEVELS
times at most, and what is still over TILE meets by twos of parts. Nothing is
dropped, no task holds more than two parts, and copies are one set throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, shingling
from .shingling import U

#: Members of a group that meet in one task; times that large groups are grouped anew; large groups of a set from which on they make a cluster.
TILE, LEVELS, DENSE = 512, 2, 4
#: Groups that a set has in common with their first member, from which on the two are in one cluster; bytes of groups that are counted at once.
SHARED, HELD = 2, 16 << 20
#: Ranges of set names in which memberships of large groups are counted.
RANGES = 64
CHUNK = 2 << 20
#: Pairs that are compared at once.
PAIRS = 1 << 18
#: Width of a set's name in bytes: 96 bits of a hash of all its shingles.
SID = 12
_SID = f"S{SID}"
#: Bands of sizes are (den / num) ** STEPS wide.
STEPS = 6


class Bands:
    """Sizes in bands: linked sets lie in the same band or in neighbouring ones."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.tops, self.blocks = num, den, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def reach(self, largest: int) -> None:
        tops, blocks = self.tops.tolist(), self.blocks.tolist()
        while not tops or tops[-1] < largest or len(tops) < np.searchsorted(tops, largest) + 2:
            tops.append(int(tops[-1] * (self.den / self.num) ** STEPS) + 1 if tops else 8)
            blocks.append(self._blocks(tops[-1]))
        self.tops, self.blocks = np.array(tops), np.array(blocks)

    def _blocks(self, top: int) -> int:
        """The number of blocks for which the last of the D + 1 heaviest is expected to hold most shingles."""
        need = int(self.differing(np.int64(2 * top))) + 1
        best = (0, need)
        for k in sorted({need + round(need * x / 16) for x in range(1, 17)}):
            # Of k blocks with Poisson counts, how many shingles the one at place ``need`` has.
            mean = top / k
            p = rest = math.exp(-mean)
            c = 0
            while k * (1 - rest) >= need + 1.5 * math.sqrt(k * rest * (1 - rest)):
                c += 1
                p *= mean / c
                rest += p
            if c > best[0]:
                best = (c, k)
        return best[1]

    def differing(self, total: np.ndarray) -> np.ndarray:
        """Most shingles that only one of two linked sets has, by the sum of their sizes."""
        return total * (self.den - self.num) // (self.den + self.num)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Each row's sorted distinct fingerprints of n words; of all its words if there are fewer; none without words."""
    data = shingling.lower(data)
    starts, ends, of = shingling.word_bounds(data, offsets)
    w = shingling.word_fingerprints(data, starts, ends, 0)
    whole = shingling.runs(w, n, 0)
    out = []
    for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(whole[a : b - n + 1]))
        else:
            out.append(shingling.runs(w[a:b], b - a, 1) if b > a else w[:0])
    return out


def set_id(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())[:SID]


def block_keys(sets: list[np.ndarray], bands: Bands, level: int = 0, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the blocks by which sets join in their own band and, where linked sets can lie there, the next; and the set of each.

    ``level`` chooses the hash that deals shingles out; ``within`` (a group of each set) keeps groups apart.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not sizes.sum():
        return none
    bands.reach(int(sizes.max()))
    partner = sizes * bands.den // bands.num
    place = shingling.mix(np.concatenate(sets) ^ U(0x9E3779B97F4A7C15 * level & 0xFFFFFFFFFFFFFFFF)) if level else np.concatenate(sets)
    code = shingling.mix(np.concatenate(sets) * U(0xC2B2AE3D27D4EB4F))
    row = np.repeat(np.arange(len(sets)), sizes)
    salt = np.zeros(len(sets), np.uint64) if within is None else within.view(np.uint64)
    own_band = np.searchsorted(bands.tops, sizes)
    keys, of = [], []
    for step in (0, 1):
        band = own_band + step
        most = np.minimum(partner, bands.tops[band]) if step == 0 else partner
        # Sets without a shingle to spare link with equal ones only, which are one set.
        need = bands.differing(sizes + most) + 1
        need[(need < 2) | (sizes == 0) | (step == 1) & (partner <= bands.tops[own_band])] = 0
        blocks = np.where(need > 0, bands.blocks[band], 0)
        if not blocks.sum():
            continue
        base = np.cumsum(blocks) - blocks
        some = need[row] > 0
        at = base[row[some]] + (((place[some] >> U(32)) * blocks[row[some]].astype(np.uint64)) >> U(32)).astype(np.int64)
        codes = code[some]
        if level:
            order = np.argsort(at, kind="stable")
            at, codes = at[order], codes[order]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        parity, count = np.zeros(int(blocks.sum()), np.uint64), np.zeros(int(blocks.sum()), np.int64)
        parity[at[first]] = np.bitwise_xor.reduceat(codes, first)
        count[at[first]] = np.diff(np.append(first, len(at)))
        own = np.repeat(np.arange(len(sets)), blocks)
        name = shingling.mix(((band[own].astype(np.uint64) << U(40)) + (np.arange(len(own)) - base[own]).astype(np.uint64)) ^ salt[own])
        key = shingling.mix(parity ^ name)
        order = np.lexsort((key, -count, own))
        kept = order[np.arange(len(own)) - base[own] < need[own]]
        keys.append(key[kept])
        of.append(own[kept])
    return (np.concatenate(keys), np.concatenate(of)) if keys else none


def _parts(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    data, offsets = common.text_buffer(batch.column(batch.schema.get_field_index("text")))
    for a, b in common.chunks(offsets, CHUNK):
        yield a, shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)


def _names(column: pa.Array) -> np.ndarray:
    """A column of set names as fixed-width strings."""
    return common.text_buffer(column)[0].view(_SID)


def _binary(names: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(np.arange(0, SID * len(names) + 1, SID, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(names).tobytes())])


def members(docs: DataFrame, n: int) -> DataFrame:
    """(doc, key, n_shingles, sid): the set of each document; sid is null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for _, part in _parts(batch, n) for s in part]
            doc, key = (batch.column(batch.schema.get_field_index(c)) for c in ("doc", "key"))
            yield pa.RecordBatch.from_arrays([doc, key, pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) if len(s) else None for s in sets], pa.binary())], ["doc", "key", "n_shingles", "sid"])

    return docs.mapInArrow(run, "doc long, key long, n_shingles long, sid binary")


def groups(rows: DataFrame, n: int, num: int, den: int, level: int) -> DataFrame:
    """(gid, part, members binary) of sets with a block in common, for ``rows`` of text and ``within``, the group that they must share.

    part is -1 for a whole group, given once however many blocks its members share; larger groups come in parts of
    TILE, numbered from 0, each with the group's first member.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for batch in batches:
            inside = batch.column(batch.schema.get_field_index("within")).to_numpy()
            for a, sets in _parts(batch, n):
                names = [set_id(s) for s in sets]
                once = list({(w, x): i for i, (w, x) in enumerate(zip(inside[a : a + len(sets)].tolist(), names, strict=True)) if len(sets[i])}.values())
                if not once:
                    continue
                keys, of = block_keys([sets[i] for i in once], bands, level, np.ascontiguousarray(inside[a:][once]))
                name = np.frombuffer(b"".join(names[i] for i in once), np.uint8).reshape(-1, SID)
                h1, h2 = np.ascontiguousarray(name[:, :8]).view(np.int64).ravel(), np.ascontiguousarray(name[:, 8:]).view(np.int32).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(h1[of]), pa.array(h2[of])], ["block", "h1", "h2"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, name, part, first = np.zeros(0, np.int64), np.zeros(0, _SID), 0, None

        def close(k: int, own: np.ndarray, last: bool) -> tuple[list, np.ndarray]:
            """Rows of the parts that ``own`` fills; what is left of it where more of the group may follow."""
            nonlocal part, first
            out = []
            while len(own) > TILE or last and part and len(own):
                first = own[:1] if part == 0 else first
                out.append((k, part, (own[:TILE] if part == 0 else np.append(first, own[:TILE])).tobytes()))
                own, part = own[TILE:], part + 1
            if last:
                if not part and len(own) > 1:
                    blob = own.tobytes()
                    out.append((xxhash.xxh3_64_intdigest(blob) - (1 << 63), -1, blob))
                part = 0
            return out, own

        def table(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["gid", "part", "members"])

        for batch in batches:
            k, h1, h2 = (batch.column(c).to_numpy() for c in range(3))
            wide = np.empty((len(k), SID), np.uint8)
            wide[:, :8], wide[:, 8:] = h1.view(np.uint8).reshape(-1, 8), h2.view(np.uint8).reshape(-1, 4)
            key, name = np.append(key, k), np.append(name, wide.reshape(-1).view(_SID))
            new = np.append(True, (key[1:] != key[:-1]) | (name[1:] != name[:-1]))
            key, name = key[new], name[new]
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size, out = np.diff(np.append(start, len(key))), []
            whole = np.flatnonzero(size[:-1] > 1)
            if part and len(start) > 1 and size[0] == 1:
                whole = np.append(0, whole)
            for i in whole.tolist():
                out += close(int(key[start[i]]), name[start[i] : start[i] + size[i]], True)[0]
            z = start[-1]
            more, left = close(int(key[z]), name[z:], False)
            if out or more:
                yield table(out + more)
            key, name = key[len(key) - len(left) :], left
        if len(key):
            out = close(int(key[0]), name, True)[0]
            if out:
                yield table(out)

    found = rows.mapInArrow(blocks, "block long, h1 long, h2 int").repartition("block").sortWithinPartitions("block", "h1", "h2")
    found = common.written(found.mapInArrow(gather, "gid long, part int, members binary"), "groups")
    return common.written(found.dropDuplicates(["gid", "part", "members"]), "groups")


def stars(group: DataFrame) -> DataFrame:
    """(rep, part, sid, n): in how many groups (rep, part, members) of a first member and part number a set is, itself left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            if held.nbytes > HELD:
                yield from counted(held)
                held = None
        if held is not None and held.num_rows:
            yield from counted(held)

    def counted(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Rows come in order of rep and part; what lies in two calls is summed up later."""
        rows = rows.combine_chunks()
        rep, part = _names(rows["rep"]), rows["part"].to_numpy()
        data, offsets = common.text_buffer(rows["members"])
        key = np.append(True, (rep[1:] != rep[:-1]) | (part[1:] != part[:-1])).cumsum() - 1
        sid, at = np.unique(data.view(_SID), return_inverse=True)
        pair, n = np.unique(np.repeat(key, np.diff(offsets) // SID) * len(sid) + at, return_counts=True)
        first = np.searchsorted(key, pair // len(sid))
        name = sid[pair % len(sid)]
        other = name != rep[first]
        yield pa.RecordBatch.from_arrays([_binary(rep[first][other]), pa.array(part[first][other]), _binary(name[other]), pa.array(n[other])], ["rep", "part", "sid", "n"])

    met = group.select("rep", "part", "members").repartition("rep", "part").sortWithinPartitions("rep", "part").mapInArrow(run, "rep binary, part int, sid binary, n long")
    return common.written(met.groupBy("rep", "part", "sid").agg(F.sum("n").alias("n")), "stars")


def collapsed(group: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``group`` without the groups that lie inside a cluster; (gid, sid) of these clusters, of sets that share SHARED groups or more.

    A cluster is taken only where its sets, in tiles, make at most half as many rows as the memberships that it stands for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.text_buffer(batch.column(2))
            name, away, out = data.view(_SID), batch.column(4), []
            for i, (a, b) in enumerate(zip((offsets[:-1] // SID).tolist(), (offsets[1:] // SID).tolist(), strict=True)):
                out.append(away[i].is_valid and bool(np.isin(name[a:b], _names(away[i].values)).any()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(np.diff(offsets) // SID), pa.array(out, pa.bool_())], ["gid", "rep", "size", "crosses"])

    group = group.withColumn("rep", F.substring("members", 1, SID))
    star = stars(group)
    # A set's least first member stands for its others: pairs of first members recur from set to set.
    shared = star.where(F.col("n") >= SHARED).groupBy("sid").agg(F.collect_set("rep").alias("reps"))
    edges = shared.select(F.array_min("reps").alias("u"), F.explode(F.concat("reps", F.array("sid"))).alias("v")).where("u <> v").distinct()
    label = components(common.written(edges, "shared"))
    end = lambda c, x: label.select(F.col("sid").alias(c), F.col("label").alias(x))
    away = star.join(end("sid", "_own"), "sid", "left").join(end("rep", "_rep"), "rep", "left").where("_own is null or _rep is null or _own <> _rep").groupBy("rep", "part").agg(F.collect_list("sid").alias("away"))
    told = group.join(away, ["rep", "part"], "left").select("gid", "part", "members", "rep", "away").mapInArrow(run, "gid long, rep binary, size long, crosses boolean")
    inside = common.written(told.groupBy("gid").agg(F.first("rep").alias("rep"), F.sum("size").alias("size"), F.max("crosses").alias("crosses")).where("not crosses").join(end("rep", "label"), "rep").select("gid", "label", "size"), "inside")
    sets = label.groupBy("label").agg(F.count("*").alias("sets"))
    taken = inside.groupBy("label").agg(F.sum("size").alias("size")).join(sets, "label").where(2 * F.col("sets") * F.ceil(F.col("sets") / F.lit(float(TILE))) <= F.col("size")).select("label")
    taken = common.written(taken, "taken")
    rest = common.written(group.drop("rep").join(inside.join(taken, "label", "left_semi").select("gid"), "gid", "left_anti"), "groups")
    return rest, common.written(label.join(taken, "label", "left_semi").select(F.xxhash64("label").alias("gid"), "sid"), "clusters")


def meeting(cluster: DataFrame) -> DataFrame:
    """(gid, part, sid) by which a cluster's sets first meet: all of them if they fit a TILE, else in DENSE ways of dealing them into parts."""
    parts = cluster.groupBy("gid").agg(F.ceil(F.count("*") / F.lit(float(TILE))).cast("int").alias("_parts"))
    ways = F.explode(F.sequence(F.lit(0), F.when(F.col("_parts") > 1, DENSE - 1).otherwise(0)))
    dealt = cluster.join(parts, "gid").select("gid", "sid", "_parts", ways.alias("_way"))
    return dealt.select("gid", (F.col("_way") * F.col("_parts") + F.pmod(F.xxhash64("sid", "_way"), "_parts")).cast("long").alias("part"), "sid")


def memberships(group: DataFrame) -> DataFrame:
    """(gid, part, sid)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.text_buffer(batch.column(2))
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets) // SID)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)).cast(pa.int64()), _binary(data.view(_SID))], ["gid", "part", "sid"])

    return group.select("gid", "part", "members").mapInArrow(run, "gid long, part long, sid binary")


def tiles(group: DataFrame) -> DataFrame:
    """(gid, part, sid, ...) of ``group`` (gid, sid, ...), such that each two members of a gid have a part in common, of about four TILEs."""
    parts = group.groupBy("gid").agg(F.ceil(F.count("*") / F.lit(2.0 * TILE)).cast("int").alias("_parts"))
    both = group.join(parts, "gid").withColumn("_side", F.pmod(F.xxhash64("sid"), "_parts").cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    low, high = F.least("_side", "_other").cast("long"), F.greatest("_side", "_other").cast("long")
    return both.withColumn("part", (high * (high + 1) / 2 + low).cast("long")).drop("_parts", "_side", "_other")


def ranges(large: DataFrame) -> DataFrame:
    """(bucket, gid, members) of the large groups' parts, cut by ranges of names: a set's memberships are in rows of one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.text_buffer(batch.column(1))
            name = data.view(_SID)
            of = np.repeat(np.arange(batch.num_rows), np.diff(offsets) // SID)
            # Parts are in order of names as numbers, whose highest byte is this one: a part lies in few ranges.
            bucket = data.reshape(-1, SID)[:, 7].astype(np.int64) * RANGES >> 8
            order = np.lexsort((bucket, of))
            name, of, bucket = name[order], of[order], bucket[order]
            first = np.flatnonzero(np.append(True, (np.diff(of) != 0) | (np.diff(bucket) != 0))) if len(of) else of
            blob = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((SID * np.append(first, len(of))).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(name).tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), batch.column(0).take(pa.array(of[first])), blob], ["bucket", "gid", "members"])

    return large.select("gid", "members").mapInArrow(run, "bucket long, gid long, members binary")


def _in_range(what):
    """Of all rows of one bucket each: what ``what`` gives for their distinct memberships, by set and then gid (sets, set of each, gids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            bucket = held["bucket"].to_numpy()
            if bucket[0] != bucket[-1]:
                last = int(np.searchsorted(bucket, bucket[-1]))
                for c in np.split(np.arange(last), np.flatnonzero(np.diff(bucket[:last])) + 1):
                    yield of(held.slice(int(c[0]), len(c)))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield of(held)

    def of(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        data, offsets = common.text_buffer(rows["members"])
        sid, at = np.unique(data.view(_SID), return_inverse=True)
        gid = np.repeat(rows["gid"].to_numpy(), np.diff(offsets) // SID)
        order = np.lexsort((gid, at))
        at, gid = at[order], gid[order]
        new = np.append(True, (np.diff(at) != 0) | (np.diff(gid) != 0))
        return what(sid, at[new], gid[new])

    return run


def _company(sid: np.ndarray, at: np.ndarray, gid: np.ndarray) -> pa.RecordBatch:
    """(gid, n, members): in how many large groups a group's members are, in all, and how many these are."""
    many = np.bincount(at)[at]
    name, of = np.unique(gid, return_inverse=True)
    return pa.RecordBatch.from_arrays([pa.array(name), pa.array(np.bincount(of, many).astype(np.int64)), pa.array(np.bincount(of))], ["gid", "n", "members"])


def _chosen(sid: np.ndarray, at: np.ndarray, gid: np.ndarray) -> pa.RecordBatch:
    """(sid, gids): of each set the first DENSE gids."""
    place = np.arange(len(at)) - np.searchsorted(at, at)
    kept = place < DENSE
    ends = np.append(np.searchsorted(at[kept], np.arange(len(sid))), kept.sum())
    return pa.RecordBatch.from_arrays([_binary(sid), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(gid[kept]))], ["sid", "gids"])


def _overlaps(sid: np.ndarray, at: np.ndarray, gid: np.ndarray) -> pa.RecordBatch:
    """(u, v): each group with the first groups of its members."""
    pairs = np.unique(np.stack([gid[np.searchsorted(at, at)], gid], 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])


def clusters(large: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of large groups in parts (gid, part, members): (gid, sid) of clusters of overlapping groups; (gid, part, sid) by which a cluster's sets first meet; (gid) of the groups in clusters.

    A group is in a cluster if its members are in DENSE or more large groups on average. Memberships stay packed: a set has
    one row in a cluster and first meets others in DENSE groups at most, however many it is in.
    """
    every = common.written(ranges(large), "ranges")
    by_range = lambda df, what, schema: df.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_in_range(what), schema)
    dense = common.written(by_range(every, _company, "gid long, n long, members long").groupBy("gid").agg(F.sum("n").alias("n"), F.sum("members").alias("m")).where(F.col("n") >= DENSE * F.col("m")).select("gid"), "dense")
    inner = common.written(every.join(dense, "gid", "left_semi"), "ranges")
    chosen = common.written(by_range(inner, _chosen, "sid binary, gids array<long>"), "chosen")
    to = components(common.written(by_range(inner, _overlaps, "u long, v long").distinct(), "overlaps"))
    cluster = chosen.select("sid", F.col("gids")[0].alias("g")).join(to.select(F.col("sid").alias("g"), "label"), "g")
    few = chosen.select("sid", F.explode("gids").alias("gid"))
    parts = few.groupBy("gid").agg(F.ceil(F.count("*") / F.lit(float(TILE))).cast("int").alias("_parts"))
    meet = few.join(parts, "gid").select("gid", F.pmod(F.xxhash64("sid"), "_parts").cast("long").alias("part"), "sid")
    return common.written(cluster.select(F.xxhash64("label").alias("gid"), "sid"), "clusters"), common.written(meet, "met"), dense


def texts_of(docs: DataFrame, member: DataFrame, sids: DataFrame) -> DataFrame:
    """(sid, text) of the sets ``sids``: the text of one of its documents each."""
    one = member.join(sids, "sid", "left_semi").groupBy("sid").agg(F.min(F.struct("doc", "key")).alias("at")).select("sid", "at.doc", "at.key")
    return common.written(docs.join(one, ["doc", "key"]).dropDuplicates(["doc", "key"]).select("sid", "text"), "texts")


def parities(texts: DataFrame, n: int, width: int) -> DataFrame:
    """(sid, n, parity binary): the parity sketch of each set, of ``width`` bits a shingle or up to twice as many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, parity = [], []
            for _, sets in _parts(batch, n):
                for s in sets:
                    bits = 1 << max(6, int(np.ceil(np.log2(width * len(s)))))
                    # Low bits of the place stay when a sketch is folded, so a shingle lies in one cell at all widths.
                    p = np.bincount((((s * U(0x9E3779B97F4A7C15)) >> U(20)) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
                    size.append(len(s))
                    parity.append(np.packbits(p.astype(bool), bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(parity, pa.binary())], ["sid", "n", "parity"])

    return texts.mapInArrow(run, "sid binary, n long, parity binary")


def _near(num: int, den: int, mode: str):
    """Pairs (u, v) of rows sorted by group that sketches allow to be linked; of different labels.

    ``mode``: nearest (one pair for each v, in a group), between (one for each two labels) or all.
    """

    def pairs(label: np.ndarray, sid: np.ndarray, size: np.ndarray, data: np.ndarray, offsets: np.ndarray, start: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """All pairs i before j of the runs, in blocks of PAIRS."""
        i = np.repeat(np.arange(len(sid)), np.repeat(start + length, length) - np.arange(len(sid)) - 1)
        for a in range(0, len(i), PAIRS):
            own = i[a : a + PAIRS]
            # How many pairs of a row came before: the rows' first places among all pairs.
            j = np.arange(a, a + len(own)) - np.searchsorted(i, own) + own + 1
            low, high = np.minimum(size[own], size[j]), np.maximum(size[own], size[j])
            able = (den * low >= num * high) & (label[own] != label[j])
            x, y = own[able], j[able]
            far, most = np.zeros(len(x), np.int64), (size[x] + size[y]) * (den - num) // (den + num)
            wide = np.diff(offsets)
            # The narrower sketch of each pair first; widths are one or two steps apart at most.
            x, y = np.where(wide[x] <= wide[y], x, y), np.where(wide[x] <= wide[y], y, x)
            for w in np.unique(wide[x]).tolist():
                for v in np.unique(wide[y[wide[x] == w]]).tolist():
                    at = np.flatnonzero((wide[x] == w) & (wide[y] == v))
                    step = max(1, (1 << 20) // v)
                    for b in range(0, len(at), step):
                        k = at[b : b + step]
                        left = data[offsets[x[k]][:, None] + np.arange(w)].view(np.uint64)
                        right = np.bitwise_xor.reduce(data[offsets[y[k]][:, None] + np.arange(v)].view(np.uint64).reshape(len(k), v // w, w // 8), axis=1)
                        far[k] = np.bitwise_count(left ^ right).sum(1)
            ok = far <= most
            yield x[ok], y[ok], far[ok]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            gid, piece = held["gid"].to_numpy(), held["part"].to_numpy()
            start = np.flatnonzero(np.append(True, (gid[1:] != gid[:-1]) | (piece[1:] != piece[:-1])))
            if len(start) > 1:
                yield from found(held.slice(0, int(start[-1])), start[:-1], np.diff(start))
                held = held.slice(int(start[-1]))
        if held is not None and held.num_rows > 1:
            yield from found(held, np.zeros(1, np.int64), np.array([held.num_rows]))

    def found(rows: pa.Table, start: np.ndarray, length: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        sid, label = _names(rows["sid"]), _names(rows["label"])
        data, offsets = common.text_buffer(rows["parity"])
        size = rows["n"].to_numpy()
        run_of = np.repeat(np.arange(len(start)), length)
        named, label_no = np.unique(label, return_inverse=True)
        best: list[tuple[np.ndarray, ...]] = []
        for x, y, far in pairs(label_no, sid, size, data, offsets, start, length):
            swap = sid[x] > sid[y]
            u, v = np.where(swap, y, x), np.where(swap, x, y)
            u, v, far = u[sid[u] != sid[v]], v[sid[u] != sid[v]], far[sid[u] != sid[v]]
            best.append((u, v, far))
            if mode != "all":
                u, v, far = (np.concatenate(c) for c in zip(*best, strict=True))
                a, b = (run_of[v], v) if mode == "nearest" else (np.minimum(label_no[u], label_no[v]), np.maximum(label_no[u], label_no[v]))
                order = np.lexsort((far, b, a))
                kept = order[np.append(True, (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0))] if len(order) else order
                best = [(u[kept], v[kept], far[kept])]
        for u, v, far in best:
            yield pa.RecordBatch.from_arrays([_binary(sid[u]), _binary(sid[v]), _binary(named[np.minimum(label_no[u], label_no[v])]), _binary(named[np.maximum(label_no[u], label_no[v])]), pa.array(far)], ["u", "v", "a", "b", "far"])

    return run


def candidates(rows: DataFrame, sketches: DataFrame, num: int, den: int, mode: str) -> DataFrame:
    """Distinct pairs (u, v) to verify, from ``rows`` (gid, part, sid, label)."""
    met = rows.join(sketches, "sid").select("gid", "part", "sid", "label", "n", "parity").repartition("gid", "part").sortWithinPartitions("gid", "part", "sid")
    near = met.mapInArrow(_near(num, den, mode), "u binary, v binary, a binary, b binary, far long")
    if mode == "all":
        return near.select("u", "v").distinct()
    by = ["v"] if mode == "nearest" else ["a", "b"]
    return near.groupBy(*by).agg(F.min(F.struct("far", "u", "v")).alias("p")).select("p.u", "p.v").distinct()


def verified(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (u, v) whose sets' Jaccard index is at least num / den, by their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch, keep = whole.slice(at, 256), []
                x, y = ([s for _, part in _parts(batch.select([c]).rename_columns(["text"]), n) for s in part] for c in ("x", "y"))
                for a, b in zip(x, y, strict=True):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(den * both >= num * (len(a) + len(b) - both))
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    a, b = texts.withColumnsRenamed({"sid": "u", "text": "x"}), texts.withColumnsRenamed({"sid": "v", "text": "y"})
    return common.written(pairs.join(a, "u").join(b, "v").select("u", "v", "x", "y").mapInArrow(run, "u binary, v binary"), "links")


def components(links: DataFrame) -> DataFrame:
    """(sid, label) of all ends of links: the smallest end that links reach. Labels spread along links and through labels."""
    edges = common.written(links.union(links.select("v", "u")).distinct(), "edges")
    labels = common.written(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")).withColumnRenamed("u", "sid"), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("sid", "v"), "v").groupBy("u").agg(F.min("label").alias("near")).withColumnRenamed("u", "sid")
        least = labels.join(near, "sid").select("sid", "label", F.least("label", "near").alias("to"))
        # A label is a set itself: where it has found a smaller one, all that carry it follow.
        hooked = least.groupBy("label").agg(F.min("to").alias("up"))
        step = common.written(least.join(hooked, "label").select("sid", F.least("to", "up").alias("label"), (F.least("to", "up") < F.col("label")).alias("moved")), "labels")
        common.discard(labels)
        labels = step
        if not step.where("moved").limit(1).count():
            common.discard(edges)
            return labels.select("sid", "label")


def roots(links: DataFrame) -> DataFrame:
    """(sid, label) of each v of links (u, v), of which it has one and u is smaller: where the way over such links ends."""
    up = common.written(links.select(F.col("v").alias("sid"), F.col("u").alias("label"), F.lit(True).alias("moved")), "roots")
    while up.where("moved").limit(1).count():
        above = up.select(F.col("sid").alias("label"), F.col("label").alias("_above"))
        step = common.written(up.join(above, "label", "left").select("sid", F.coalesce("_above", "label").alias("label"), F.col("_above").isNotNull().alias("moved")), "roots")
        common.discard(up)
        up = step
    return up.select("sid", "label")


def merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` after further links: only the labels that these connect are looked at."""
    end = lambda c, x: label.select(F.col("sid").alias(c), F.col("label").alias(x))
    pairs = links.join(end("u", "a"), "u", "left").join(end("v", "b"), "v", "left").select(F.coalesce("a", "u").alias("u"), F.coalesce("b", "v").alias("v")).where("u <> v").distinct()
    to = components(common.written(pairs, "pairs")).select(F.col("sid").alias("label"), F.col("label").alias("_to"))
    every = label.select("sid", "label").unionByName(to.select(F.col("label").alias("sid"), "label")).distinct()
    return common.written(every.join(to, "label", "left").select("sid", F.coalesce("_to", "label").alias("label")), "labels")


def linked(docs: DataFrame, member: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(sid, label) of the sets that are linked with another one: the components of the relation "linked"."""
    group = groups(docs.select("text", F.lit(0).cast("long").alias("within")), n, num, den, 0)
    group, cluster = collapsed(group)
    first = meeting(cluster)
    large = group.where("part >= 0")
    if large.limit(1).count():
        more, many, dense = clusters(large)
        group = common.written(group.join(dense, "gid", "left_anti"), "groups")
        cluster, first = cluster.unionByName(more), first.unionByName(many)
    met = common.written(memberships(group), "met")
    meet = met.unionByName(common.written(first, "met"))
    texts = texts_of(docs, member, meet.select("sid").distinct())
    narrow, wide = common.written(parities(texts, n, 2), "sketches"), None
    found = verified(candidates(meet.withColumn("label", F.col("sid")), narrow, num, den, "nearest"), texts, n, num, den)
    label = roots(found)
    for mode in ("between", "all"):
        named = lambda df: df.join(label, "sid", "left").withColumn("label", F.coalesce("label", "sid"))  # noqa: E731, B023
        mixed = lambda df, *by: df.join(df.groupBy(*by).agg(F.min("label").alias("_a"), F.max("label").alias("_b")).where("_a <> _b").select(*by), [*by], "left_semi")
        labelled = common.written(mixed(named(met), "gid"), "labelled")
        rows = mixed(labelled.where("part < 0"), "gid", "part")
        large = labelled.where("part >= 0")
        tiled = lambda df: mixed(common.written(named(tiles(mixed(named(df), "gid").drop("label"))), "tiles"), "gid", "part")  # noqa: E731, B023
        rows = rows.unionByName(tiled(cluster))
        for level in range(1, LEVELS + 1):
            if not large.limit(1).count():
                break
            again, near = collapsed(groups(large.select(F.col("gid").alias("within"), "sid").distinct().join(texts, "sid").select("text", "within"), n, num, den, level))
            rows = rows.unionByName(tiled(near))
            inner = common.written(mixed(named(memberships(again)), "gid"), "inner")
            rows = rows.unionByName(mixed(inner.where("part < 0"), "gid", "part"))
            large = inner.where("part >= 0")
            if level == LEVELS:
                rows = rows.unionByName(mixed(tiles(large.select("gid", "sid", "label").distinct()), "gid", "part"))
        if wide is None:
            wide = common.written(parities(texts.join(rows.select("sid").distinct(), "sid", "left_semi"), n, 8), "sketches")
        more = verified(candidates(rows, wide, num, den, mode), texts, n, num, den)
        if more.limit(1).count():
            label = merged(label, more)
    return label


@common.guarded("_doc", "_key")
def near_duplicates(df: DataFrame, n: int = 5, threshold: tuple[int, int] = (8, 10), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``df`` with n_shingles and component_id: the smallest id that links reach from a document, itself included.

    A document's set holds its distinct runs of ``n`` words (A-Z lower-cased);
    with fewer words, all of them as one; without words or text, nothing, and
    then it is linked with nothing. Documents link when their sets' Jaccard
    index is at least num / den = ``threshold``. Equal sets are linked, copies
    are one set throughout. Rows with a null id get a null component_id and
    link nothing. Rows of one id share it as their smallest. An empty table
    gives an empty table. Columns with the added names are replaced. Ids are
    whole numbers.
    """
    df = common.without(df, "n_shingles", "component_id")
    num, den = threshold
    rows = common.keyed(df, text, doc_id)
    docs = rows.select(F.col("_doc").alias("doc"), F.col("_key").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    member = common.written(members(docs, n), "members")
    known = member.where("doc is not null")
    label = linked(docs.where("doc is not null"), known, n, num, den)
    group = common.written(known.where("sid is not null").join(label, "sid", "left").select("doc", "key", F.coalesce("label", "sid").alias("group")).distinct(), "groups")
    least = common.written(group.groupBy("group").agg(F.min("doc").alias("component_id")), "least")
    ids = group.join(least, "group").select("doc", "key", "component_id")
    made = known.join(ids, ["doc", "key"], "left").select(F.col("doc").alias("_doc"), F.col("key").alias("_key"), "n_shingles", F.coalesce("component_id", "doc").alias("component_id")).dropDuplicates(["_doc", "_key"])
    none = rows.where("_doc is null").withColumn("_key", F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    lone = members(none.select(F.col("_doc").alias("doc"), F.col("_key").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")), n).select(F.col("key").alias("_key"), "n_shingles").distinct()
    given = none.join(lone, "_key", "left").withColumn("component_id", F.lit(None).cast("long"))
    columns = [*[f"`{c}`" for c in df.columns], "n_shingles", "component_id"]
    return rows.where("_doc is not null").join(made, ["_doc", "_key"], "left").select(*columns).unionByName(given.select(*columns))


def op5_query(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return near_duplicates(docs, 3, (9, 10)).select("doc_id", "n_shingles", "component_id")
