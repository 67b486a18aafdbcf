"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histograms of character classes and of common words are compared
with references of several languages by Jensen-Shannon distance; what is far
from all references, in either histogram, is not kept. References are shares
over all documents of a language, so they are one sum for each of the listed
languages. How far is far follows from the distances of each language's own
documents. Texts too short for a histogram are not judged by it.
"""

from __future__ import annotations

from functools import reduce
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Common words by language.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "with", "was"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ist"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "que"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "las"),
}
WORDS = tuple(dict.fromkeys(w for own in COMMON.values() for w in own))
#: Patterns of the character classes; what is left are letters beyond ASCII and all else.
CLASSES = (r"[a-z]", r"[A-Z]", r"[0-9]", r"[\x20\x09-\x0D]", r"[.,;:!?'\x22()-]", r"[#*$%&|<>{}\[\]=+/\\@^_~`]")
LEAST_WORDS, LEAST_CHARS = 50, 200
#: A kept document is as near a reference as this quantile of the language's own documents, times a margin for each histogram ...
QUANTILE, CHARS_MARGIN, WORDS_MARGIN = 0.9, 1.5, 1.5
#: ... but never further than this, and in words than this part of the distance of a text without any common word.
BARE = 0.9
MOST_CHARS_DISTANCE, MOST_WORDS_DISTANCE = 0.45, 0.9


def base_counts(df: DataFrame, text: str = "_t") -> DataFrame:
    """``df`` with _w, the words of a text that isn't null, its _chars, and exact n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    Arrays that a lambda looks into are columns of their own: an expression there would be computed for each element.
    """
    t, w = F.col(text), F.col("_w")
    df = char_histogram(df, text).withColumn("_w", common.words(t)).withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(common.WORD)))
    df = df.withColumn("_windows", F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    df = df.withColumn("_placed", F.when(repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, j, d: F.coalesce(x["h"] == F.get(F.col("_placed"), j + d)["h"], F.lit(False))
    df = df.withColumn("_starts", F.when(F.col("_placed").isNotNull(), F.sort_array(F.transform(F.filter("_placed", lambda x, j: same(x, j, -1) | same(x, j, 1)), lambda x: x["i"]))))
    # Each window that occurs again covers its words up to the next one's start.
    covered = F.aggregate(F.transform("_starts", lambda s, j: F.least(F.lit(3), F.coalesce(F.get(F.col("_starts"), j + 1) - s, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    return df.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": (F.length(t) - F.col("_chars")[3]).cast("long"),
        "n_symbols": (F.length("_rest") - F.length(F.regexp_replace("_rest", r"[#*$%&|<>]+", ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.when(F.col("_starts").isNotNull(), covered).otherwise(0).cast("long"),
    }).drop("_rest", "_lines", "_windows", "_placed", "_starts")


def char_histogram(df: DataFrame, text: str) -> DataFrame:
    """``df`` with _chars, the counts of CLASSES and of all other code points, and _rest, the text without all classes but the last.

    Each class is taken out of what the classes before it have left, so later patterns see little of the text.
    """
    left = text
    for i, c in enumerate(CLASSES):
        df = df.withColumn(f"_left{i}", F.regexp_replace(F.col(left), f"{c}+", ""))
        left = f"_left{i}"
    ends = [text, *(f"_left{i}" for i in range(len(CLASSES)))]
    counts = [F.length(F.col(a)) - F.length(F.col(b)) for a, b in pairwise(ends)] + [F.length(F.col(ends[-1]))]
    return df.withColumn("_chars", F.array(*[c.cast("double") for c in counts])).withColumn("_rest", F.col(ends[-2])).drop(*ends[1:])


def word_histogram(own: Column, n_words: Column) -> Column:
    """Counts of WORDS, from a column with a text's common words (each between spaces), and of all other words."""
    counts = [(F.length(own) - F.length(F.replace(own, F.lit(f" {w} "), F.lit("")))) / (len(w) + 2) for w in WORDS]
    return F.array(*counts, n_words - reduce(lambda a, b: a + b, counts))


def common_words(words: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(F.array_join(F.filter(words, lambda w: F.lower(w).isin(*WORDS)), "  ")), F.lit(" "))


def divergence(counts: Column, reference: list[float]) -> Column:
    """The Jensen-Shannon distance, in base 2 and from 0 to 1, of a histogram and reference shares; null for an empty histogram."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(counts, F.lit(reference), lambda c, q: part(c / total, (c / total + q) / 2) + part(q, (c / total + q) / 2))
    return F.when(total > 0, F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2, F.lit(0.0))))


def references(counted: DataFrame, lang: str = "lang") -> dict[str, tuple[list[float], list[float]]]:
    """Shares of characters and words by language of COMMON, over all rows of that language in ``counted``."""
    sums = [F.sum(F.col("_chars")[i]).alias(f"c{i}") for i in range(len(CLASSES) + 1)] + [F.sum(F.col("_words")[i]).alias(f"w{i}") for i in range(len(WORDS) + 1)]
    rows = counted.where(F.col(f"`{lang}`").isin(*COMMON)).groupBy(F.col(f"`{lang}`").alias("_lang")).agg(*sums).collect()
    share = lambda x: [v / sum(x) for v in x] if sum(x) else [0.0] * len(x)
    return {r["_lang"]: (share([r[f"c{i}"] for i in range(len(CLASSES) + 1)]), share([r[f"w{i}"] for i in range(len(WORDS) + 1)])) for r in rows}


def limits(counted: DataFrame, known: dict[str, tuple[list[float], list[float]]], enough: Column, lang: str, chars_distance: float, words_distance: float) -> dict[str, tuple[float, float]]:
    """The largest distances of a kept document to each reference, from QUANTILE over all judged rows of its language; none of a language without such rows."""
    of, least = F.col(f"`{lang}`"), [0.0] * len(WORDS) + [1.0]
    own = lambda column, i: reduce(lambda rest, x: F.when(of == x[0], divergence(F.col(column), x[1][i])).otherwise(rest), known.items(), F.lit(None).cast("double"))
    bare = [divergence(F.array(*map(F.lit, least)), r[1]).alias(x) for x, r in known.items()]
    wordless = counted.sparkSession.range(1).select(*bare).first() if known else {}
    rows = counted.where(enough & of.isin(*known)).select(of.alias("_lang"), own("_chars", 0).alias("c"), own("_words", 1).alias("w"))
    found = rows.groupBy("_lang").agg(*[F.percentile_approx(c, QUANTILE, 10000).alias(c) for c in ("c", "w")]).collect()
    # A reference without any common word has no distance to fall short of.
    under = lambda x: BARE * x if x > 1e-6 else words_distance
    return {r["_lang"]: (min(CHARS_MARGIN * r["c"], chars_distance), min(WORDS_MARGIN * r["w"], words_distance, under(wordless[r["_lang"]]))) for r in found}


@common.guarded("_chars", "_words", "_w", "_t", "_own", "_rest", "_left0", "_left1", "_left2", "_left3", "_left4", "_left5", "_lines", "_windows", "_placed", "_starts", "_dc", "_dw")
def quality_rules(df: DataFrame, text: str = "text", lang: str = "lang", chars_distance: float = MOST_CHARS_DISTANCE, words_distance: float = MOST_WORDS_DISTANCE, keep_text: bool = True) -> DataFrame:
    """``df`` with the base counts, base_failed, js_chars and js_words (to the nearest reference) and kept.

    Null and empty texts have zero counts, null distances and base_failed.
    Texts under LEAST_WORDS words or LEAST_CHARS characters have null
    distances and are kept unless base_failed; so are all without any
    reference (no judged row with a language of COMMON). A text is far if it is
    beyond the limits (see ``limits``) of all references, in either histogram;
    ``chars_distance`` and ``words_distance`` bound the limits. Rows are kept
    as they are, equal ones too; columns with the added names are replaced.
    Without ``keep_text`` the result has no text column, and none is written.
    """
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "js_chars", "js_words", "kept")
    df = common.without(df, *added)
    # Counted once, written, and read again for the references and for the verdicts.
    texts = base_counts(df.withColumn("_t", F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    counted = texts.withColumn("_own", common_words(F.col("_w"))).withColumn("_words", word_histogram(F.col("_own"), F.col("n_words")))
    counted = counted.drop("_w", "_t", "_own", *([] if keep_text else [text]))
    counted = common.written(counted, "counted")
    known = references(counted, lang)
    enough = (F.col("n_words") >= LEAST_WORDS) & (F.aggregate("_chars", F.lit(0.0), lambda a, b: a + b) >= LEAST_CHARS)
    ends = limits(counted, known, enough, lang, chars_distance, words_distance) if known else {}
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    distances = [F.when(enough, F.array(*[divergence(F.col(c), known[x][i]) for x in ends])) if ends else F.lit(None).cast("array<double>") for i, c in enumerate(("_chars", "_words"))]
    judged = counted.withColumns({"base_failed": failed, "_dc": distances[0], "_dw": distances[1]}).withColumns({"js_chars": F.array_min("_dc"), "js_words": F.array_min("_dw")})
    beyond = lambda column, i: F.coalesce(reduce(lambda a, b: a & b, [F.col(column)[k] > end[i] for k, end in enumerate(ends.values())], F.col(column).isNotNull()), F.lit(False))
    far = beyond("_dc", 0) | beyond("_dw", 1)
    return judged.withColumn("kept", ~F.col("base_failed") & ~far).select(*[f"`{c}`" for c in df.columns if keep_text or c != text], *added)


def op3_query(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "lang", "text")
    return quality_rules(docs, keep_text=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "js_chars", "js_words")
