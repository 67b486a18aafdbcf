"""Removal of repeated passages of words, with a count-min prefilter.

Pass one counts the fingerprints of all windows of n words in partition
sketches, which are merged; the merged sketch overestimates counts. Pass two
takes the windows that it estimates as repeated, and no others, and groups
them exactly, by 96 bits. Within a chunk of rows only the windows of the
smallest document go to the shuffle, the others are known to repeat, so a
window that a third of all documents hold reaches its group once a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, shingling, sketch

N = 13
CHUNK = 2 << 20


def _windows(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = common.text_buffer(batch.column(batch.schema.get_field_index("text")))
    for a, b in common.chunks(offsets, CHUNK):
        part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, of = shingling.word_bounds(part, own)
        at = shingling.within_rows(of, n)
        yield a, part, starts, ends, of, at


def _fingerprints(n: int):
    def run(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, part, starts, ends, _, at in _windows(batch, n):
            yield shingling.runs(shingling.word_fingerprints(part, starts, ends, 0), n, 0)[at]

    return run


def consecutive(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs sorted by key and place: where runs of consecutive places begin, and their lengths."""
    new = np.append(True, (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)) if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(at)))


def smallest_first(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each occurrence, whether it is of its fingerprint's smallest document here."""
    order = np.lexsort((doc, h2, h1))
    new = np.append(True, (np.diff(h1[order]) != 0) | (np.diff(h2[order]) != 0)) if len(order) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    least = np.repeat(doc[order][first], np.diff(np.append(first, len(order))))
    out = np.empty(len(order), bool)
    out[order] = doc[order] == least
    return out


OCCURRENCES = "h1 long, h2 int, doc long, key long, at int, n int, known boolean"


def occurrences(rows: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["h1", "h2", "doc", "key", "at", "n", "known"])


def repeated_spans(docs: DataFrame, n: int = N) -> DataFrame:
    """(doc, key, at, n): runs of n windows from word ``at`` on that also start in a document with a smaller id."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    held = sketch.repeated(docs.select("text"), _fingerprints(n), size // 6, cascade=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_, keys = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("doc", "key"))
            for a, part, starts, ends, of, at in _windows(batch, n):
                h1 = shingling.runs(shingling.word_fingerprints(part, starts, ends, 0), n, 0)[at]
                some = np.flatnonzero(held.value(h1))
                if not len(some):
                    continue
                at, h1 = at[some], h1[some]
                h2 = (shingling.runs(shingling.word_fingerprints(part, starts, ends, 1), n, 1)[at] >> np.uint64(32)).astype(np.uint32)
                row = np.searchsorted(of, at, "right") - 1
                doc, place = docs_[a + row], at - of[row]
                least = smallest_first(h1, h2, doc)
                first, length = consecutive(row[~least], place[~least])
                rows = [(h1[least].view(np.int64), h2[least].view(np.int32), doc[least], keys[a + row[least]], place[least].astype(np.int32), np.ones(least.sum(), np.int32), np.zeros(least.sum(), bool))]
                r = a + row[~least][first]
                rows.append((docs_[r], np.zeros(len(r), np.int32), docs_[r], keys[r], place[~least][first].astype(np.int32), length.astype(np.int32), np.ones(len(r), bool)))
                yield occurrences(rows)

    found = docs.mapInArrow(run, OCCURRENCES)
    least = F.min("doc").over(Window.partitionBy("known", "h1", "h2"))
    return found.withColumn("least", least).where(F.col("known") | (F.col("doc") > F.col("least"))).select("doc", "key", "at", "n")


@common.guarded("_doc", "_key", "_at", "_n")
def remove_repeated(df: DataFrame, n: int = N, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``df`` with n_words, n_removed and kept_text: the words outside windows that a document with a smaller id also has.

    A window is ``n`` consecutive words (runs of anything but ASCII white
    space) of one document, read in the input; kept words are joined by one
    space. Null and empty texts have no words and an empty kept_text. Rows
    with a null id have no smaller or greater id: they keep all words. Rows
    with equal ids don't remove each other's words. An empty table gives an
    empty table. Columns with the added names are replaced; others stay. Ids
    are whole numbers.
    """
    df = common.without(df, "n_words", "n_removed", "kept_text")
    rows = common.keyed(df, text, doc_id)
    docs = rows.where("_doc is not null").select(F.col("_doc").alias("doc"), F.col("_key").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    spans = repeated_spans(docs, n).groupBy("doc", "key").agg(F.collect_list("at").alias("_at"), F.collect_list("n").alias("_n"))
    rows = rows.join(spans.withColumnsRenamed({"doc": "_doc", "key": "_key"}), ["_doc", "_key"], "left").drop("_doc", "_key")
    schema = T.StructType([*df.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, starts, lengths = (batch.column(batch.schema.get_field_index(c)) for c in (text, "_at", "_n"))
            counts, removed, kept = [], [], []
            for t, at, length in zip(texts, starts, lengths, strict=True):
                words = (t.as_py() or "").encode().split()
                counts.append(len(words))
                if at.is_valid:
                    gone = covered(len(words), np.asarray(at.values), np.asarray(length.values) + n - 1)
                    removed.append(int(gone.sum()))
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    removed.append(0)
                kept.append(b" ".join(words).decode())
            columns = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name not in ("_at", "_n")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], schema.names)

    return rows.select([f"`{c}`" for c in df.columns] + ["_at", "_n"]).mapInArrow(apply, schema)


def covered(size: int, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A mask of ``size`` places: those in some run of ``length`` from ``at`` on."""
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, at, 1)
    np.add.at(step, np.minimum(at + length, size), -1)
    return np.cumsum(step[:-1]) > 0


def op1_query(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return remove_repeated(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
