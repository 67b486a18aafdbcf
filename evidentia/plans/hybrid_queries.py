"""Queries of the stored hybrid index, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import hybrid, index, shared

from .coverage_queries import CYRILLIC, LATIN, TOKENS, cyrillic, stemmed
from .reference_queries import table

#: A question with endings to take off.
QUESTION = "тхе анды оф реед ен ла"


def hybrid_stored(spark, d):
    """Texts, in letters that have stems, and vectors of one id, searched by the first vector among rows of one label."""
    e = table(spark, d, "embeddings")
    rows = shared.dealt(table(spark, d, "documents").select("doc_id", "lang", "text")).withColumn("text", cyrillic(F.col("text"))).join(e, F.col("doc_id") == F.col("vec_id")).select("doc_id", "lang", "label", "text", "embedding")
    path = index.folder(spark, "hybrid")
    hybrid.build(rows, "doc_id", "text", "embedding", path, "table-64", ("lang", "label"))
    first = e.orderBy("vec_id").select(F.col("embedding").cast("array<double>").alias("v")).first()["v"]
    found = hybrid.search(spark, path, QUESTION, first, "table-64", 15, {"label": 1})
    return found.select(F.col("key").alias("doc_id"), "lang", F.round("score", 8).alias("score"), F.round("dense", 6).alias("dense"))


ORACLE_SQL = {
    "hybrid_stored": rf"""with q as (select embedding::double[] as v from embeddings order by vec_id limit 1),
own as (select doc_id, lang, label, text, embedding::double[] as v from documents join embeddings on doc_id = vec_id),
tokens as (select doc_id, unnest(regexp_extract_all(translate(lower(text), '{LATIN}', '{CYRILLIC}'), '{TOKENS}')) as w from own),
split as (select doc_id, w from tokens union all select doc_id, unnest(regexp_split_to_array(w, '[-.]')) from tokens where regexp_matches(w, '[-.]')),
known as (select w, {stemmed('w')} as term from (select distinct w from split)),
terms as (select doc_id, term from split join known using (w)),
asked as (select distinct {stemmed('w')} as term from (select unnest(string_split('{QUESTION}', ' ')) as w)),
dl as (select doc_id, count(term) as dl from own left join terms using (doc_id) group by 1),
tf as (select doc_id, term, count(*) as tf from terms join asked using (term) group by 1, 2),
df as (select term, count(*) as df from tf group by 1), s as (select count(*) as n, avg(dl) as a from dl),
told as (select doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))), 12) as score from tf join df using (term) join dl using (doc_id), s group by 1),
near as (select doc_id, round(list_cosine_similarity(own.v, q.v), 12) as score from own, q where label = 1),
ranked as (select doc_id, row_number() over (order by score desc, doc_id) as r from near
  union all select doc_id, row_number() over (order by score desc, doc_id) from told join own using (doc_id) where label = 1)
select doc_id, any_value(lang) as lang, round(sum(1 / (60 + r)), 8) as score, round(any_value(list_cosine_similarity(own.v, q.v)), 6) as dense
from ranked join own using (doc_id), q where r <= 60 group by 1 order by sum(1 / (60 + r)) desc, doc_id limit 15""",
}

QUERIES = {name: globals()[name] for name in ORACLE_SQL}
WITHOUT_SQL = {}
