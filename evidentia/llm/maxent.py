"""Scoring by a hashed maximum-entropy language model.

A token's probability is that of its class given the context, times its own
within the class. Words are counted over all training texts; the most frequent
ones, with the end of a text, fill CLASSES - 1 classes of WIDTH words in order
of frequency, and all other words are the first class, within which a word has
its smoothed share of counts. Both softmaxes add weights of hashed context
features: the word before, the two before together, and, as skips, the second
and the third before alone. At zero weights the model is exactly the smoothed
unigram model, so training begins there.

Training is by rounds of distributed gradient updates. In each round every task
starts from the broadcast weights, takes AdaGrad steps through its share of the
round's texts and sends the changes of its weights, rounded to 16 bits; they
are averaged by how often each row was touched, in groups of at most FAN. Every
training text is in exactly one round. What passes through the driver, the
weights and the KNOWN most frequent words, has a size that parameters fix.
Counts of rarer words never leave the executors: the tokens of scored texts
that aren't known are joined with them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: The first class has the words of no other; hashed rows of each of both weight tables.
CLASSES, WIDTH, BITS = 32, 32, 16
#: Most frequent words (of at most LONGEST bytes) whose counts all tasks hold.
KNOWN, LONGEST = 1 << 18, 128
ROUNDS, RATE, BATCH, FAN, CHUNK = 3, 0.5, 1 << 13, 256, 1 << 22
#: Training tasks for each core, at least, and partitions for each beyond that; rows of a weight table that travel together.
TASKS, PARTITIONS, BLOCK = 2, 4, 1 << 10
SMOOTH = 0.1
#: The end of a text as a token, which no word equals.
END = ""
_NEVER = np.float32(-1e9)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def tokens(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of the rows' words in turn, the words that the codes stand for, and the rows' offsets. Only A-Z are lower-cased; null: none."""
    data, offsets = common.text_buffer(column)
    # Arrow's own lower-casing goes wrong on some slices.
    texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_LOWER[data]))
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.values.dictionary_encode()
    codes, offsets, words = coded.indices.to_numpy(), lists.offsets.to_numpy(), coded.dictionary
    blank = pc.index(words, pa.scalar("", words.type)).as_py()
    if blank >= 0:  # around leading and trailing white space
        keep = codes != blank
        offsets = np.append(0, np.cumsum(keep))[offsets]
        codes = codes[keep]
    return codes, words, offsets


def chunked(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, offsets = common.text_buffer(batch.column(batch.schema.get_field_index(text)))
        for a, b in common.chunks(offsets, CHUNK):
            yield batch.slice(a, b - a)


def token_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all rows; the end of a text is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, text):
            codes, words, _ = tokens(batch.column(batch.schema.get_field_index(text)))
            n = np.bincount(codes, minlength=len(words))
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([words.take(pa.array(seen)).cast(pa.string()), pa.array(n[seen], pa.int64())], ["word", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([batch.num_rows], pa.int64())], ["word", "n"])

    return df.select(F.col(f"`{text}`").alias(text)).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The most frequent words with their counts, the end first, and the totals of all: tokens, distinct tokens."""

    words: pa.Array
    counts: np.ndarray
    total: int
    distinct: int
    model_words: int

    @property
    def mass(self) -> float:
        return self.total + SMOOTH * (self.distinct + 1)

    @property
    def rest(self) -> float:
        """Mass of the first class: all words that the model doesn't name, and those never seen."""
        return self.mass - float(self.counts[: self.model_words].sum()) - SMOOTH * self.model_words

    def look_up(self, words: pa.Array) -> np.ndarray:
        """Place of each word, -1 if not known."""
        return pc.index_in(words.cast(self.words.type), value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def vocabulary(counts: DataFrame, known: int = KNOWN, model_words: int = (CLASSES - 1) * WIDTH) -> Vocabulary:
    """Of a written table of counts. The end is always known and the first word; ties go by the word."""
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()[0]
    top = counts.where(F.octet_length("word") <= LONGEST).orderBy((F.col("word") == END).desc(), F.desc("n"), "word").limit(known).toArrow()
    words, n = top.column("word").combine_chunks(), top.column("n").to_numpy()
    if not len(words):  # no training text: the end is a token without a count
        words, n = pa.array([END]), np.zeros(1, np.int64)
    return Vocabulary(words, n, total["n"] or 0, total["v"], min(model_words, len(words)))


class Model:
    def __init__(self, vocab: Vocabulary, classes: int = CLASSES, width: int = WIDTH, bits: int = BITS):
        m = min(vocab.model_words, (classes - 1) * width)
        own = np.log((vocab.counts[:m] + SMOOTH) / vocab.mass)
        padded = np.full((classes - 1) * width, -np.inf)
        padded[:m] = own
        grid = padded.reshape(classes - 1, width)
        with np.errstate(divide="ignore"):
            mass = np.log(np.exp(grid).sum(1))
        first = np.log(max(vocab.rest, SMOOTH) / vocab.mass)
        self.bits, self.width = bits, width
        self.class_bias = np.maximum(np.append(first, mass), _NEVER).astype(np.float32)
        self.word_bias = np.full((classes, width), _NEVER, np.float32)
        with np.errstate(invalid="ignore"):
            self.word_bias[1:] = np.maximum(np.nan_to_num(grid - mass[:, None], nan=-np.inf), _NEVER)
        self.tables = [np.zeros((1 << bits, classes), np.float32), np.zeros((1 << bits, width), np.float32)]

    def features(self, keys: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Hashes of the context features of the places ``at`` in ``keys``."""
        a, b, c = (keys[at - i] for i in (1, 2, 3))
        with np.errstate(over="ignore"):
            made = [a * _MIX[0], a * _MIX[1] + b * _MIX[2], b * _MIX[3], c * _MIX[4]]
            return [(h ^ (h >> np.uint64(29))) * _MIX[5] for h in made]

    def rows(self, hashes: list[np.ndarray], cls: np.ndarray | None = None) -> np.ndarray:
        shift = np.uint64(64 - self.bits)
        with np.errstate(over="ignore"):
            if cls is not None:
                hashes = [(h + cls.astype(np.uint64) * _MIX[2]) * _MIX[1] for h in hashes]
            return np.stack([h >> shift for h in hashes]).astype(np.int32)

    def softmax(self, table: int, rows: np.ndarray, bias: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of all outcomes, and the logarithm of that of ``y``."""
        z = self.tables[table].take(rows[0], axis=0)
        z += bias
        for r in rows[1:]:
            z += self.tables[table].take(r, axis=0)
        z -= z.max(1, keepdims=True)
        own = z[np.arange(len(y)), y]
        np.exp(z, out=z)
        total = z.sum(1)
        z /= total[:, None]
        return z, own - np.log(total)

    def parts(self, keys: np.ndarray, at: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For classes and then for words within them: (table, which tokens, feature rows, probabilities, the logarithm of that of what holds, what holds)."""
        hashes = self.features(keys, at)
        cls = np.where(ids >= 0, ids // self.width + 1, 0)
        rows = self.rows(hashes)
        yield 0, np.arange(len(ids)), rows, *self.softmax(0, rows, self.class_bias, cls), cls
        named = np.flatnonzero(ids >= 0)
        if len(named):
            rows, y = self.rows([h[named] for h in hashes], cls[named]), ids[named] % self.width
            yield 1, named, rows, *self.softmax(1, rows, self.word_bias[cls[named]], y), y

    def log10(self, keys: np.ndarray, at: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Of each token; for one of the first class (id -1), that of the class."""
        out = np.zeros(len(ids))
        for a in range(0, len(ids), BATCH):
            for _, which, _, _, log, _ in self.parts(keys, at[a : a + BATCH], ids[a : a + BATCH]):
                out[a + which] += log
        return out / np.log(10)


class Trainer:
    """AdaGrad on a copy of the weights, with one accumulator and one count of touches for each row."""

    def __init__(self, model: Model, rate: float):
        self.model, self.rate = model, rate
        self.before = model.tables
        model.tables = [t.copy() for t in model.tables]
        self.squares = [np.ones(len(t), np.float32) for t in model.tables]
        self.touched = [np.zeros(len(t), np.float32) for t in model.tables]

    def learn(self, keys: np.ndarray, at: np.ndarray, ids: np.ndarray) -> None:
        for a in range(0, len(ids), BATCH):
            for table, _, rows, grad, _, y in self.model.parts(keys, at[a : a + BATCH], ids[a : a + BATCH]):
                grad[np.arange(len(y)), y] -= 1
                flat = rows.ravel()
                order = np.argsort(flat.astype(np.uint16) if self.model.bits <= 16 else flat, kind="stable")  # 16 bits are sorted much faster
                flat = flat[order]
                starts = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
                own, times = flat[starts], np.diff(np.append(starts, len(flat)))
                order %= len(y)
                step = grad.take(order[starts], axis=0)
                many = np.flatnonzero(times > 1)  # most rows occur once in a batch and need no sum
                if len(many):
                    inside = np.repeat(times > 1, times)
                    step[many] = np.add.reduceat(grad.take(order[inside], axis=0), np.append(0, np.cumsum(times[many])[:-1]), axis=0)
                squares = self.squares[table].take(own) + np.einsum("ij,ij->i", step, step)
                self.squares[table][own] = squares
                step *= (self.rate / np.sqrt(squares))[:, None]
                self.model.tables[table][own] = self.model.tables[table].take(own, axis=0) - step
                self.touched[table][own] += times

    def changes(self, part: int) -> Iterator[tuple[int, int, int, bytes, bytes]]:
        """(part, table, block, touches, changes of the rows)."""
        for k, (old, new) in enumerate(zip(self.before, self.model.tables, strict=True)):
            for b in range(0, len(old), BLOCK):
                touched = self.touched[k][b : b + BLOCK]
                if touched.any():
                    yield part, k, b // BLOCK, touched.astype("<f4").tobytes(), (new[b : b + BLOCK] - old[b : b + BLOCK]).astype("<f2").tobytes()


def sequences(vocab: Vocabulary, column: pa.Array):
    """(keys, places, ids, codes, words, offsets) of a column's texts.

    Keys are hashes of words, three starts before every text; places are those
    of the tokens, ends included, in keys, and ids their places in the
    vocabulary (the end: 0; not known: -1); offsets are the rows' among the words.
    """
    codes, words, offsets = tokens(column)
    n, rows = len(codes), len(offsets) - 1
    hashed = np.fromiter((zlib.crc32(w) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words)) + np.uint64(2)
    known = vocab.look_up(words)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    place = np.arange(n) + 3 + 4 * row
    ends = offsets[1:] + 3 + 4 * np.arange(rows)
    keys, ids = np.ones(n + 4 * rows, np.uint64), np.zeros(n + 4 * rows, np.int64)
    keys[place], ids[place] = hashed[codes], known[codes]
    at = np.sort(np.concatenate([place, ends]))
    return keys, at, ids[at], codes, words, offsets


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("at")
    touched, changes = 0, 0
    for t, c in zip(group["touched"], group["changes"], strict=True):
        t = np.frombuffer(t, "<f4")
        changes = changes + np.frombuffer(c, "<f2").astype(np.float32).reshape(len(t), -1) * t[:, None]
        touched = touched + t
    first = group.iloc[0]
    mean = (changes / np.maximum(touched, 1e-9)[:, None]).astype("<f2").tobytes()
    return pd.DataFrame({"part": [first["part"]], "at": [first["part"]], "kind": [first["kind"]], "block": [first["block"]], "touched": [touched.astype("<f4").tobytes()], "changes": [mean]})


def updated(texts: DataFrame, vocab, model: Model, rate: float) -> Model:
    """The model after one round over ``texts`` (a column, text)."""
    spark = texts.sparkSession
    held = spark.sparkContext.broadcast(model)
    parts = texts.rdd.getNumPartitions()
    tasks = min(parts, max(TASKS * spark.sparkContext.defaultParallelism, parts // PARTITIONS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = Model.__new__(Model)
        own.__dict__.update(held.value.__dict__)
        trainer = Trainer(own, rate)
        for batch in chunked(batches, "text"):
            keys, at, ids, *_ = sequences(vocab.value, batch.column(0))
            trainer.learn(keys, at, np.where(ids < vocab.value.model_words, ids, -1))
        for part, kind, block, touched, changes in trainer.changes(TaskContext.get().partitionId()):
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((part, pa.int32()), (part, pa.int32()), (kind, pa.int32()), (block, pa.int32()), (touched, pa.binary()), (changes, pa.binary()))], ["part", "at", "kind", "block", "touched", "changes"])

    sent = texts.coalesce(tasks).mapInArrow(run, "part int, at int, kind int, block int, touched binary, changes binary")
    while True:
        sent = sent.withColumn("part", F.expr(f"cast(part div {FAN} as int)")).groupBy("part", "kind", "block").applyInPandas(_merge, sent.schema)
        tasks = -(-tasks // FAN)
        if tasks <= 1:
            break
    tables = [t.copy() for t in model.tables]
    for r in sent.select("kind", "block", "changes").toLocalIterator():  # the size of the weights, at half precision
        block = tables[r["kind"]][r["block"] * BLOCK : (r["block"] + 1) * BLOCK]
        block += np.frombuffer(r["changes"], "<f2").reshape(block.shape)
    held.unpersist()
    model.tables = tables
    return model


def fit_maxent(train: DataFrame, text: str = "text", rounds: int = ROUNDS, rate: float = RATE, known: int = KNOWN, classes: int = CLASSES, width: int = WIDTH, bits: int = BITS):
    """(counts, vocabulary, model) of all rows of ``train``: a written table (word, n) of every word, and what is broadcast."""
    spark = train.sparkSession
    texts = train.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    counts = common.written(token_counts(texts), "words")
    vocab = vocabulary(counts, known, (classes - 1) * width)
    model = Model(vocab, classes, width, bits)
    held = spark.sparkContext.broadcast(vocab)
    for i in range(rounds if vocab.total else 0):
        share = texts.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == i)
        model = updated(share, held, model, rate / (1 + i))
    return counts, vocab, model


ADDED = ("n_tokens", "n_known", "base_score", "score")


def score(df: DataFrame, counts: DataFrame, vocab: Vocabulary, model: Model, text: str = "text") -> DataFrame:
    """``df`` without its text, with n_tokens, n_known, base_score and score (log10 probabilities); null texts are empty.

    Words that aren't known to the tasks are joined with ``counts``. Rows keep
    apart by numbers of their own, so null and repeated ids don't matter; equal
    texts have equal scores but for the rounding of sums. Columns named as the
    added ones are replaced. An empty table gives an empty table.
    """
    spark = df.sparkSession
    df = common.without(df, *ADDED)
    row, rare, own = common.fresh(df, "row", "rare", "own")
    kept = [f for f in df.schema.fields if f.name != text]
    added = [T.StructField(row, T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField(rare, T.ArrayType(T.StringType()))]
    schema = T.StructType([*kept, *added])
    held = spark.sparkContext.broadcast((vocab, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vocab, model = held.value
        logs, at_row = np.log10(vocab.counts + SMOOTH), TaskContext.get().partitionId() << 40
        for batch in chunked(batches, text):
            keys, at, ids, codes, words, offsets = sequences(vocab, batch.column(batch.schema.get_field_index(text)))
            n, starts = batch.num_rows, offsets[:-1] + np.arange(batch.num_rows)
            known, named = ids >= 0, (ids >= 0) & (ids < vocab.model_words)
            counted = np.where(known, logs[np.maximum(ids, 0)], 0.0)
            by = lambda values: np.add.reduceat(values, starts)  # noqa: B023, E731
            lengths = np.diff(offsets) + 1
            base = by(counted) - lengths * np.log10(vocab.mass)
            own = by(model.log10(keys, at, np.where(named, ids, -1)) + np.where(named, 0.0, counted - np.log10(max(vocab.rest, SMOOTH))))
            none = np.flatnonzero(~known)  # among the tokens, ends included
            of = np.searchsorted(starts, none, "right") - 1
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), words.take(pa.array(codes[none - of])).cast(pa.string()))
            seen = by((known & (vocab.counts[np.maximum(ids, 0)] > 0)).astype(np.int64))
            made = [pa.array(np.arange(at_row, at_row + n)), pa.array(lengths, pa.int64()), pa.array(seen, pa.int64()), pa.array(base), pa.array(own), lists]
            at_row += n
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in kept), *made], schema.names)

    scored = common.written(df.mapInArrow(run, schema), "scored")
    exploded = scored.select(row, F.explode(rare).alias("word")).groupBy(row, "word").agg(F.count("*").alias("k"))
    missing = exploded.join(counts.withColumnRenamed("n", own), "word", "left").groupBy(row).agg(
        F.sum(F.when(F.col(own).isNotNull(), F.col("k"))).alias("k"), F.sum(F.col("k") * F.log10(F.coalesce(F.col(own), F.lit(0)) + SMOOTH)).alias("s")
    )
    joined = scored.drop(rare).join(missing.select(F.col(row), F.col("k").alias(rare), F.col("s").alias(own)), row, "left")
    plus = lambda c: F.col(c) + F.coalesce(F.col(own), F.lit(0.0))
    return joined.withColumns({"n_known": F.col("n_known") + F.coalesce(F.col(rare), F.lit(0)), "base_score": plus("base_score"), "score": plus("score")}).drop(row, rare, own)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))


def op13_query(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text", held_out().alias("held_out"))
    counts, vocab, model = fit_maxent(docs.where("not held_out"))
    return score(docs, counts, vocab, model).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(vocab.total).cast("long").alias("train_tokens"), "base_score", "score")
