"""Mixing documents to target weights of domains that they belong to softly.

A classifier of the labelled table gives each document posteriors of the
domains. The document rates (expected copies, not negative) minimise the
squares of what expected domain tokens miss of their targets, by projected
gradient: all steps so far are added to a rate of one and the sum is projected
onto rates that aren't negative. A document's gradient is its posteriors times
the domains' misses, so the steps so far are one number a domain. Steps are
scaled by the inverse Gram matrix of the documents whose rates are above zero,
and of several lengths, tried in one pass, the best is taken. A pass is one
distributed sum over the documents. Of all rates that meet the targets, those
found are the nearest to one copy of each token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, langid

#: Shares of tokens by domain of the labelled table.
TARGETS = {"good": 0.75, "poor": 0.2, "toxic": 0.05}
#: The fit ends with targets met to MISS of each, or where STALL steps don't lower the objective by more than FALL of it.
MISS, STALL, FALL = 1e-3, 4, 1e-2
#: Lengths of a step that one pass tries.
LENGTHS = (1.0, 0.5, 0.25, 0.1, 0.03, 0.01)


def labelled(docs: DataFrame, labels: DataFrame, each: int = 3 * langid.ROWS_EACH) -> DataFrame:
    """(text, domain) of labelled documents: toxic, else good or poor by quality. Rows without both labels take no part;
    an id with several rows is toxic if one says so, else poor if one does.

    Of each domain about ``each`` ids are chosen by their hash before any text is read, so the ids that go to all tasks
    are bounded whatever the sizes of both tables.
    """
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor")
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    rows = known.groupBy("doc_id").agg(F.max(domain).alias("domain"))
    rows = common.written(rows, "labelled")
    counts = rows.groupBy("domain").count()
    luck = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    few = rows.join(F.broadcast(counts), "domain").where(luck * F.col("count") <= each).select("doc_id", "domain")
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", "domain")


def posteriors(df: DataFrame, model: langid.SubwordModel | None, text: str = "text") -> DataFrame:
    """``df`` with posteriors (array in the order of the model's labels; of one element without a model) and tokens (words)."""
    df = common.without(df, "posteriors", "tokens")

    def columns(model, p, n) -> list[pa.Array]:
        p = np.ones((n, 1)) if p is None else p
        k = p.shape[1]
        return [pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k), pa.int32()), pa.array(p.ravel()))]

    out = langid.classify(df, model, text, [T.StructField("posteriors", T.ArrayType(T.DoubleType()))], columns)
    return out.withColumn("tokens", F.size(common.words(F.col(f"`{text}`"))).cast("long"))


def rates(p: np.ndarray, pushed: np.ndarray) -> np.ndarray:
    """Rates of documents with posteriors ``p`` after steps that add up to ``pushed``."""
    return np.maximum(0.0, 1.0 + p @ pushed)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def fit_rates(df: DataFrame, targets: np.ndarray, miss: float = MISS) -> tuple[np.ndarray, np.ndarray]:
    """The sum of all steps for ``df`` with posteriors and tokens, and the expected tokens by domain after them; ``targets`` are those wanted.

    Ends when no domain misses its target by more than ``miss`` of it, or when
    the objective has stopped falling, as it does for targets that no rates
    meet; then the steps with the least objective are given.
    """
    k = len(targets)
    scale = 1 / np.maximum(targets, 1e-3 * targets.sum())

    def passed(tried: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Expected tokens and Gram matrix of the documents with a rate above zero, for each sum of steps."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(tried), k, k + 1))
            for batch in batches:
                p, t = _matrix(batch.column(0)), batch.column(1).to_numpy().astype(float)
                if batch.num_rows:
                    for i, pushed in enumerate(tried):
                        x = rates(p, pushed)
                        total[i, :, 0] += p.T @ (x * t)
                        total[i, :, 1:] += (p * (t * (x > 0))[:, None]).T @ p
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], ["i", "x"])

        out = np.zeros(len(tried) * k * (k + 1))
        for r in df.select("posteriors", "tokens").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
            out[r["i"]] = r["x"]
        return [(x[:, 0], x[:, 1:]) for x in out.reshape(len(tried), k, k + 1)]

    objective = lambda got: float(((targets - got) ** 2 * scale).sum())
    pushed = np.zeros(k)
    got, gram = passed([pushed])[0]
    stalled = 0
    while stalled < STALL and (np.abs(targets - got) > miss * np.maximum(targets, 1)).any() and gram.any():
        step = np.linalg.pinv(gram, rcond=1e-12, hermitian=True) @ (targets - got)
        # Where the matrix is nearly singular, as it is for targets out of reach, the plain gradient of the objective does better.
        root = np.sqrt(scale)
        plain = scale * (targets - got) / max(1e-300, float(np.linalg.eigvalsh(root[:, None] * gram * root)[-1]))
        tried = [pushed + length * step for length in LENGTHS] + [pushed + length * 16 * plain for length in LENGTHS]
        best = min(zip(tried, passed(tried), strict=True), key=lambda x: objective(x[1][0]))
        stalled = 0 if objective(best[1][0]) < (1 - FALL) * objective(got) else stalled + 1
        if objective(best[1][0]) < objective(got):
            pushed, (got, gram) = best
        else:
            break
    return pushed, got


def mix(df: DataFrame, model: langid.SubwordModel | None, targets: dict[str, float] | None = None, tokens: float | None = None, text: str = "text", seed: int = 23) -> DataFrame:
    """``df`` with posteriors, tokens, rate, copies and miss, such that expected tokens by domain match ``targets``' shares of ``tokens``.

    ``tokens`` is that of all of ``df`` if not given. copies is the rate,
    rounded up or down by a hash of the row's text and id in proportion; equal
    rows get equal copies. Null and empty texts have no tokens and the rate
    of their posteriors. Domains without a target get none. Without a model or
    without tokens all rates are 1. miss (array in the order of the posteriors,
    equal in all rows) is what a domain's expected tokens are over its target,
    in shares of all wanted tokens; null where nothing was fitted. It is within
    MISS of each target unless no rates meet the targets. Columns with the
    added names are replaced.
    """
    df = common.without(df, "posteriors", "tokens", "rate", "copies", "miss")
    shares = TARGETS if targets is None else targets
    # Classified once; the steps read two columns of what is written.
    with_p = common.written(posteriors(df, model, text), "posteriors")
    slim = with_p.select("posteriors", "tokens")
    pushed = None
    over = F.lit(None)
    total = slim.agg(F.sum("tokens")).first()[0] or 0
    if model is not None and total:
        share = np.array([max(0.0, shares.get(d, 0.0)) for d in model.labels])
        if share.sum():
            wanted = share / share.sum() * (tokens or total)
            pushed, got = fit_rates(slim, wanted)
            over = F.lit(((got - wanted) / wanted.sum()).tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rate = np.ones(batch.num_rows) if pushed is None else rates(_matrix(batch.column(batch.schema.get_field_index("posteriors"))), pushed)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], [*batch.schema.names, "rate"])

    out = with_p.mapInArrow(run, T.StructType([*with_p.schema.fields, T.StructField("rate", T.DoubleType())]))
    luck = F.pmod(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType)]), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return out.withColumn("copies", (F.floor("rate") + (luck < F.col("rate") - F.floor("rate")).cast("int")).cast("long")).withColumn("miss", over.cast("array<double>"))


def fit_domains(docs: DataFrame, labels: DataFrame) -> langid.SubwordModel | None:
    """A classifier of the labelled documents' domains, from a sample of at most langid.ROWS_EACH rows of each."""
    return langid.fit(*langid.sample(labelled(docs, labels), "text", "domain"), epochs=30, rate=1.5, snippets=0, raw=True, unknown=False)


def repeated(df: DataFrame) -> DataFrame:
    """Each row as often as its ``copies``, without the columns of ``mix``."""
    (i,) = common.fresh(df, "i")
    return df.where("copies > 0").withColumn(i, F.explode(F.sequence(F.lit(1), F.col("copies")))).drop(i, "posteriors", "tokens", "rate", "copies", "miss")


def op4_query(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = fit_domains(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = mix(docs.select("doc_id", "text"), model)
    names = model.labels if model else []
    return out.select("doc_id", "tokens", *[F.round(F.col("posteriors")[i], 9).alias(f"p_{n}") for i, n in enumerate(names)], F.round("rate", 9).alias("rate"), "copies", *[F.round(F.col("miss")[i], 9).alias(f"miss_{n}") for i, n in enumerate(names)])
