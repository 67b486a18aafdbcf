"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are the byte n-grams of words, with one space for a word's edges;
ASCII letters are lower-cased and other ASCII characters separate words. Each
is hashed into a table of embeddings; a text is the mean of its subwords'
embeddings, and a linear softmax over that mean gives the languages. Both
layers are trained by stochastic gradient descent in numpy on a bounded sample
of labelled rows. Subwords that no training text has add nothing, so text of an
unknown kind has even posteriors. Part of the sample is kept out of the descent
and calibrates the result, with its scrambled letters and random letters as
text of no language: a temperature that minimises the log loss, where such text
should have even posteriors, and the score below which a text is rejected.

As the mean and the last layer are linear, prediction looks up the product of
embedding and layer, one small vector a subword, and adds. It sees whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

UNDETERMINED = "und"
BITS, DIM, ORDERS = 16, 16, (2, 3, 4)
#: Bounds of the training sample: rows of each label, and bytes of a row that may be in it.
ROWS_EACH, ROW_BYTES = 700, 20_000
#: More labels than this are an error; a rejected text of a language counts as so many kept ones of no language.
MOST_LABELS, DEAR = 10_000, 300
CHUNK = 1 << 20

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
#: With ``raw``, all but white space counts as it is.
_RAW = np.arange(256, dtype=np.uint8)
_RAW[:32] = 32


def subwords(data: np.ndarray, offsets: np.ndarray, raw: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table index of each subword of the rows (0: none), the position after it, and the rows' offsets among positions."""
    n = len(offsets) - 1
    flat = np.full(len(data) + n + 4, 32, np.uint8)
    folded, starts = (_RAW if raw else _FOLD)[data], offsets[:-1] + np.arange(n)
    for i in range(n):
        flat[starts[i] + 1 : starts[i] + 1 + offsets[i + 1] - offsets[i]] = folded[offsets[i] : offsets[i + 1]]
    gap = flat == 32
    m = len(data) + n
    gram, inner = flat[: m + 3].astype(np.uint32), np.zeros(m, bool)
    out = []
    for order in range(2, max(ORDERS) + 1):
        gram = gram[:m] | (flat[order - 1 : m + order - 1].astype(np.uint32) << np.uint32(8 * (order - 1)))
        if order > 2:
            inner |= gap[order - 2 : m + order - 2]
        if order in ORDERS:
            index = ((gram * np.uint32(2654435761)) ^ np.uint32(order * 40503)) * np.uint32(2246822519) >> np.uint32(32 - BITS)
            drop = inner | (gap[:m] & gap[order - 1 : m + order - 1]) if order > 2 else gap[:m] & gap[1 : m + 1]
            index[drop] = 0
            out.append(index)
    return out, np.append(starts, m)


def softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


@dataclass
class SubwordModel:
    labels: list[str]
    table: np.ndarray  # subword -> summand of each label's logit; row 0 is zero
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0
    raw: bool = False

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row for each text; without subwords, the bias."""
        out = np.zeros((len(offsets) - 1, len(self.labels)))
        for a, b in common.chunks(offsets, CHUNK):
            grams, starts = subwords(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], self.raw)
            summed, count = np.zeros((len(starts) - 1, len(self.labels))), np.zeros(len(starts) - 1)
            for index in grams:
                summed += np.add.reduceat(self.table[index], starts[:-1], axis=0, dtype=np.float64)
                count += np.add.reduceat((index != 0).astype(np.int32), starts[:-1])
            out[a:b] = summed / np.maximum(count, 1)[:, None]
        return out + self.bias

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Calibrated probabilities, a row for each text."""
        return softmax(self.logits(data, offsets) / self.temperature)


def _encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)])


def _bags(texts: list[str], raw: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct subwords and their shares."""
    grams, starts = subwords(*_encode(texts), raw)
    out = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        index, count = np.unique(np.concatenate([g[a:b] for g in grams]), return_counts=True)
        keep = index != 0
        out.append((index[keep], (count[keep] / max(1, count[keep].sum())).astype(np.float32)))
    return out


def fit(texts: list[str], labels: list[str], seed: int = 5, epochs: int = 6, rate: float = 0.5, snippets: int = 2, raw: bool = False, unknown: bool = True) -> SubwordModel | None:
    """Train on the texts and on ``snippets`` short pieces of each, so that short texts are known too. None without a label.

    Every fifth text is kept for calibration: the temperature, and the
    rejection score, at which the rejected texts and snippets of a language,
    each counting DEAR times, and the kept texts of none are fewest. Without
    ``unknown`` all texts are taken to have a label: nothing is rejected, and
    the temperature follows from the labelled texts alone.
    """
    names = sorted(set(labels))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held = set(order[: len(texts) // 5].tolist()) if len(texts) >= 50 else set()
    train, of = [], []
    for i, t in enumerate(texts):
        if i not in held:
            train.append(t)
            of.append(names.index(labels[i]))
            for _ in range(snippets if len(t) > 60 else 0):
                a = int(rng.integers(0, len(t) - 40))
                train.append(t[a : a + int(rng.integers(20, 160))])
                of.append(of[-1])
    bags = _bags(train, raw)
    seen = np.zeros(1 << BITS, bool)
    for index, _ in bags:
        seen[index] = True
    emb = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    top, bias = rng.normal(0, 0.1, (DIM, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    steps = 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            index, share = bags[i]
            lr = np.float32(rate * max(0.05, 1 - steps / (epochs * len(bags))))
            steps += 1
            if not len(index):
                continue
            x = share @ emb[index]
            z = x @ top + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[of[i]] -= 1
            back = top @ p
            top -= lr * np.outer(x, p)
            bias -= lr * p * np.float32(0.01)
            emb[index] -= (lr * len(index) ** 0.5) * np.outer(share, back)
    table = (emb @ top).astype(np.float32)
    table[0], table[~(seen | (not unknown))] = 0, 0
    model = SubwordModel(names, table, bias, raw=raw)
    if held:
        own = [(texts[i], names.index(labels[i])) for i in sorted(held)]
        short = [(t[k : k + 80], y) for t, y in own if len(t) > 200 for k in [int(rng.integers(0, len(t) - 80))]]
        some = model.logits(*_encode([t for t, _ in own + short]))
        y = np.array([y for _, y in own + short])
        none = model.logits(*_encode([x for t, _ in own[:400] for x in _no_language(t[:2000], rng)]))
        grid = np.geomspace(0.05, 10, 60)

        def loss(t: float) -> float:
            right = np.maximum(softmax(some / t)[np.arange(len(y)), y], 1e-12)
            return float(-np.log(right).mean() - unknown * np.log(np.maximum(softmax(none / t), 1e-12)).mean())

        model.temperature = float(min(grid, key=loss))
        p, q = softmax(some / model.temperature), softmax(none / model.temperature).max(1)
        right = p.max(1)[p.argmax(1) == y]
        cost = lambda s: DEAR * (right < s).mean() + (q >= s).mean() if len(right) else s
        model.reject_below = float(min(np.linspace(0, 1, 201), key=cost)) if unknown else 0.0
    return model


def _no_language(text: str, rng: np.random.Generator) -> list[str]:
    """The text with its letters in another order, and with random letters in their place."""
    at = [i for i, c in enumerate(text) if c.isalpha()]
    out = []
    for letters in ([text[i] for i in rng.permutation(at)] if at else [], rng.choice(list("abcdefghijklmnopqrstuvwxyz"), len(at)).tolist()):
        made = list(text)
        for i, c in zip(at, letters, strict=True):
            made[i] = c
        out.append("".join(made))
    return out


def sample(df: DataFrame, text: str, label: str, each: int = ROWS_EACH) -> tuple[list[str], list[str]]:
    """Texts and labels of ``each`` different texts of every label, or of all that it has, chosen by a hash of the text.

    Rows with null text or label, and texts of over ROW_BYTES, take no part. More than MOST_LABELS labels are an error.
    """
    t, y = F.col(f"`{text}`"), F.col(f"`{label}`")
    rows = df.select(t.alias("t"), y.cast("string").alias("y")).where(t.isNotNull() & y.isNotNull() & (F.octet_length(t) <= ROW_BYTES))
    counts = rows.groupBy("y").agg(F.count_distinct(F.xxhash64("t")).alias("count"))
    counts = common.written(counts, "labels")
    if counts.count() > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    key = F.pmod(F.xxhash64("t"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    few = rows.join(F.broadcast(counts), "y").where(key * F.col("count") <= 2 * each).select("y", "t").dropDuplicates()
    got = few.toPandas().sort_values(["y", "t"], ignore_index=True)
    got = got.sample(frac=1, random_state=3).groupby("y", sort=False).head(each) if len(got) else got
    return got["t"].tolist(), got["y"].tolist()


def classify(df: DataFrame, model: SubwordModel | None, text: str, fields: list[T.StructField], to_columns) -> DataFrame:
    """``df`` with columns that ``to_columns`` makes of the texts' probabilities (None without a model)."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.text_buffer(batch.column(batch.schema.get_field_index(text)))
            p = held.value.probabilities(data, offsets) if held.value else None
            made = to_columns(held.value, p, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *(f.name for f in fields)])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def _language(model: SubwordModel | None, p: np.ndarray | None, n: int) -> list[pa.Array]:
    if p is None:
        return [pa.array([UNDETERMINED] * n, pa.string()), pa.array(np.zeros(n)), pa.array(np.ones(n, bool))]
    best = p.argmax(1)
    score = p[np.arange(n), best]
    return [pa.array([model.labels[i] for i in best], pa.string()), pa.array(score), pa.array(score < model.reject_below)]


def identify(df: DataFrame, model: SubwordModel | None, text: str = "text") -> DataFrame:
    """``df`` with lang_pred, score (0 to 1) and rejected.

    Null texts and texts without a letter are ``und``, with score 0, and
    rejected; so is everything without a model. Other texts get a learned
    label; those with less than the model's calibrated score are rejected.
    Rows are kept as they are; columns with these names are replaced.
    """
    df = common.without(df, "lang_pred", "score", "rejected")
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    out = classify(df, model, text, fields, _language)
    blank = ~F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False))
    return out.select(
        *[f"`{c}`" for c in df.columns], F.when(blank, UNDETERMINED).otherwise(F.col("lang_pred")).alias("lang_pred"),
        F.when(blank, 0.0).otherwise(F.col("score")).alias("score"), (blank | F.col("rejected")).alias("rejected"),
    )


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit_languages(docs: DataFrame) -> SubwordModel | None:
    """A model of the ``lang`` values of ``docs``, without the documents that are held out."""
    return fit(*sample(docs.where(~held_out()), "text", "lang"))


def op2_query(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = fit_languages(docs)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
