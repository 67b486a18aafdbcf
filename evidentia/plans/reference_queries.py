"""Queries of the reference's operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.functions.text import CYRILLIC, LATIN
from evidentia.operators import evidence, graph, lookup, queue, retrieval

TERMS = ("the", "and", "house", "der", "que")
TABLES = ("customer", "nation", "part", "region", "supplier")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _norm(c: str) -> str:
    return rf"lower(translate(trim(regexp_replace({c}, '\s+', ' ', 'g')), '{LATIN}', '{CYRILLIC}'))"


def lookup_norm_eq(spark, d):
    p = table(spark, d, "part")
    return p.where(text.normalize_key(F.col("p_brand")) == text.normalize_key(F.lit(" brand#13 "))).select("p_partkey", "p_brand", text.locator("part", F.col("p_partkey")).alias("locator"))


def lookup_filters(spark, d):
    return lookup.lookup(table(spark, d, "orders"), {"o_orderstatus": ["F", "O"], "o_orderpriority": "1-URGENT"}, ["o_orderkey", "o_orderstatus"], ["o_orderkey"])


def lookup_range(spark, d):
    ranges = spark.createDataFrame([(1, 10, "small"), (11, 30, "medium"), (31, 50, "large")], "low int, high int, size_class string")
    p = table(spark, d, "part")
    return p.join(F.broadcast(ranges), lookup.in_range(F.col("p_size"), F.col("low"), F.col("high"))).groupBy("size_class").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_part"))


def near_miss_suggest(spark, d):
    return lookup.near_misses(table(spark, d, "part"), "p_brand", "brand#1", "p_partkey").select("p_partkey", "p_brand")


def nearest_enum(spark, d):
    typed = spark.createDataFrame([("germny",), ("FRANSE",), ("xx",), ("brasil",), ("iraq",), (" united  kingdom",), ("CHINA",)], "typed string")
    return lookup.nearest(typed, "typed", table(spark, d, "nation"), "n_name").select("value", "repaired")


def value_locations(spark, d):
    return lookup.value_locations({t: table(spark, d, t) for t in TABLES}, "asia")


def homoglyph_twins(spark, d):
    n = table(spark, d, "nation").select("n_name")
    return lookup.homoglyph_twins(n.union(n.select(F.translate("n_name", "AEO", "АЕО"))), "n_name").select("norm", F.array_join("twins", "|").alias("twins"))


def key_difference(spark, d):
    n = table(spark, d, "nation").select("n_name", F.translate("n_name", "AE", "АЕ").alias("typed"))
    return lookup.key_difference(n, "n_name", "typed")


def line_queue_topn(spark, d):
    li = table(spark, d, "lineitem")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    return queue.first_rows(li.select("l_suppkey", *order), ["l_suppkey"], [F.asc_nulls_last(c) for c in order], 3).select("l_suppkey", "l_orderkey", "l_linenumber", "rank", "total")


def order_neighbors(spark, d):
    out = queue.neighbors(table(spark, d, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], "event_id")
    return out.select("event_id", "user_id", "previous", "next", "position", "queue_length", text.locator("events", F.col("event_id")).alias("locator"))


def order_batches(spark, d):
    return queue.placed_orders(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", ["N"])


def log_search_events(spark, d):
    e = table(spark, d, "events")
    return e.where(F.lower("event_type").contains("c") & F.col("props").contains("1")).groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def json_prop_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def bm25_topk(spark, d):
    q = spark.createDataFrame([(t,) for t in TERMS], "term string")
    return retrieval.bm25(table(spark, d, "documents"), "doc_id", "text", q, 20).select("doc_id", F.round("score", 6).alias("score"))


def exclusive_lexicon(spark, d):
    docs = table(spark, d, "documents").where("lang is not null")
    return retrieval.exclusive_terms(docs.select("lang", F.explode(text.tokenize(F.col("text"))).alias("term")), "lang").groupBy("lang").agg(F.count("*").alias("n_terms"))


def _edges(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_suppkey").distinct(), li.select("l_partkey", "l_suppkey").distinct()


def set_diff_norm_code(spark, d):
    return graph.missing(table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


def citation_membership(spark, d):
    answers = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("see [Orders, row "), F.col("o_orderkey"), F.lit("] and [nothing at all] and [orders] and [ ] and [the Orders list, row "), F.col("o_orderkey"), F.lit("]")).alias("answer"))
    known = table(spark, d, "lineitem").select(F.lit("orders").alias("head"), F.col("l_orderkey").alias("row")).distinct()
    return evidence.known_citations(answers, "o_orderkey", "answer", known)


def evidence_flatten(spark, d):
    o = evidence.facts(table(spark, d, "orders"), F.lit("order status"), F.col("o_orderstatus"), "orders", F.col("o_orderkey"), "o_custkey", "o_orderkey")
    p = evidence.facts(table(spark, d, "part"), F.lit("part size"), F.col("p_size"), "part", F.col("p_partkey"), "p_brand", "p_partkey")
    return o.unionByName(p)


def required_vs_seen(spark, d):
    return evidence.coverage(table(spark, d, "conversations"), "conv_id", "role", ["system", "user", "assistant", "tool"])


def run_summary(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("questions"), F.sum(F.length("text")).alias("chars"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


def p50_p95(spark, d):
    return evidence.p95(table(spark, d, "events"), "event_type", "value")


def check_share(spark, d):
    r = table(spark, d, "labels")
    return r.agg(F.round(F.avg((F.col("quality") == 1).cast("int")), 3).alias("quality_share"), F.round(F.avg((F.col("toxic") == 0).cast("int")), 3).alias("clean_share"), F.count("*").alias("n"))


def gap_repeats(spark, d):
    return evidence.repeated_gaps(table(spark, d, "events").where("props is not null"), "props")


def redact(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.redact(F.concat(F.col("c_name"), F.lit(" Bearer abc."), F.col("c_custkey"), F.lit(" sk-abcdefgh"), F.col("c_custkey"))).alias("masked"))


def term_df(spark, d):
    tf = retrieval.term_counts(table(spark, d, "documents"), "doc_id", "text")
    return tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def bm25_idf(spark, d):
    docs = table(spark, d, "documents")
    return retrieval.idf(retrieval.term_counts(docs, "doc_id", "text"), docs.count()).select("term", "df", F.round("idf", 6).alias("idf"))


def _cosine_each(e: DataFrame, rows: DataFrame) -> DataFrame:
    near = retrieval.cosine_topk_each(rows.select("vec_id", "embedding"), e.where("vec_id % 100 = 0").select("vec_id", "embedding"), "vec_id", "embedding", 10)
    return near.select(F.col("query").alias("query_id"), "vec_id", F.round("score", 5).alias("score"))


def cosine_topk(spark, d):
    e = table(spark, d, "embeddings")
    return _cosine_each(e, e)


def cosine_topk_filtered(spark, d):
    e = table(spark, d, "embeddings")
    return _cosine_each(e, e.where("label = 1"))


def section_inherit(spark, d):
    return graph.inherited(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_suppkey").select("l_orderkey", "l_linenumber", F.array_join(F.col("tables").cast("array<string>"), ",").alias("tables"))


def graph_stats(spark, d):
    left, right = _edges(spark, d)
    return graph.stats(left, right, "l_suppkey")


def gap_repeats_all(spark, d):
    return evidence.repeated_gaps(table(spark, d, "conversations"), "text")


def code_for_clause(spark, d):
    left, right = _edges(spark, d)
    return graph.two_hops(left.withColumn("o", F.col("l_suppkey")), right, "l_orderkey", "l_suppkey", "l_partkey", "o")


_TOKENS = r"""tokens as (
  select doc_id, lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:[-.][\p{L}\p{N}]+)*')) as t from documents),
terms as (select doc_id, lang, t as term from tokens union all
  select doc_id, lang, unnest(regexp_split_to_array(t, '[-.]')) from tokens where regexp_matches(t, '[-.]'))"""

ORACLE_SQL = {
    "lookup_norm_eq": f"select p_partkey, p_brand, 'part, row ' || p_partkey as locator from part where {_norm('p_brand')} = {_norm(chr(39) + ' brand#13 ' + chr(39))}",
    "lookup_filters": "select o_orderkey, o_orderstatus, count(*) over () as total from orders where o_orderstatus in ('F', 'O') and o_orderpriority = '1-URGENT' order by o_orderkey limit 20",
    "lookup_range": "select s.size_class, count(*) as n, min(p_partkey) as first_part from part join (values (1, 10, 'small'), (11, 30, 'medium'), (31, 50, 'large')) s(low, high, size_class) on p_size between low and high group by 1",
    "near_miss_suggest": "select p_partkey, p_brand from part where contains(upper(p_brand), 'BRAND#1') order by p_partkey limit 5",
    "nearest_enum": r"""with t(value) as (values ('germny'), ('FRANSE'), ('xx'), ('brasil'), ('iraq'), (' united  kingdom'), ('CHINA')),
v as (select value, trim(regexp_replace(lower(value), '\s+', ' ', 'g')) as k from t), a as (select n_name, lower(n_name) as k from nation),
hits as (select value, min(n_name) filter (v.k = a.k) as exact, count(*) as n, min(n_name) as first, bool_or(value = n_name) as allowed from v join a
  on abs(length(v.k) - length(a.k)) <= 3 and levenshtein(v.k, a.k) <= case when length(v.k) <= 6 then 1 else 2 end group by 1)
select value, case when not allowed then coalesce(exact, case when n = 1 then first end) end as repaired from t left join hits using (value)""",
    "homoglyph_twins": f"""with n as (select n_name as raw from nation union select translate(n_name, 'AEO', 'АЕО') from nation)
select {_norm('raw')} as norm, array_to_string(list_sort(list(raw)), '|') as twins from n group by 1 having count(*) > 1""",
    "key_difference": """with n as (select n_name, translate(n_name, 'AE', 'АЕ') as typed, unnest(range(1, length(n_name) + 1)) as position from nation)
select n_name, typed, position::int as position, n_name[position] as left_char, typed[position] as right_char from n where n_name[position] <> typed[position]""",
    "line_queue_topn": """select l_suppkey, l_orderkey, l_linenumber, rank, total from (select *, row_number() over (partition by l_suppkey order by l_shipdate nulls last, l_orderkey, l_linenumber, l_partkey, l_extendedprice) as rank,
count(*) over (partition by l_suppkey) as total from lineitem) where rank <= 3""",
    "order_neighbors": """select event_id, user_id, lag(event_id) over w as previous, lead(event_id) over w as next, row_number() over w as position, count(*) over (partition by user_id) as queue_length, 'events, row ' || event_id as locator
from events where user_id is not null and ts is not null window w as (partition by user_id order by ts, event_id)""",
    "order_batches": "select l_orderkey, bool_or(l_returnflag <> 'N') as placed, array_to_string(list_sort(list(distinct l_returnflag)), ',') as lines, count(*) as n_batches from lineitem group by 1",
    "log_search_events": "select event_type, count(*) as n, min(event_id) as first_event from events where contains(lower(event_type), 'c') and contains(props, '1') group by 1",
    "json_prop_extract": "select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events",
    "bm25_topk": f"""with {_TOKENS},
dl as (select d.doc_id, count(t.term) as dl from documents d left join terms t using (doc_id) group by 1),
s as (select count(*) as n, avg(dl) as a from dl),
tf as (select doc_id, term, count(*) as tf from terms where term in {TERMS!r} group by all),
df as (select term, count(*) as df from tf group by 1)
select doc_id, round(sum(ln(1 + (s.n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / s.a))), 6) as score
from tf join df using (term) join dl using (doc_id), s group by 1 order by score desc, doc_id limit 20""",
    "exclusive_lexicon": rf"""with {_TOKENS}, w as (select term, min(lang) as lang from terms where lang is not null and length(term) >= 4 and not regexp_matches(term, '^[0-9]+$') group by 1 having count(distinct lang) = 1)
select lang, count(*) as n_terms from w group by 1""",
    "set_diff_norm_code": "select o_orderkey as k from orders except select l_orderkey from lineitem",
    "citation_membership": """select o_orderkey, 'Orders, row ' || o_orderkey as citation, exists (select 1 from lineitem where l_orderkey = o_orderkey) as is_known from orders
union all select o_orderkey, 'nothing at all', false from orders union all select o_orderkey, 'orders', true from orders
union all select o_orderkey, 'the Orders list, row ' || o_orderkey, exists (select 1 from lineitem where l_orderkey = o_orderkey) from orders""",
    "evidence_flatten": """select 'order status' as claim, o_orderstatus as value, 'orders' as source, 'orders, row ' || o_orderkey as locator from (select *, row_number() over (partition by o_custkey order by o_orderkey) as r from orders) where r <= 8
union all select 'part size', p_size::varchar, 'part', 'part, row ' || p_partkey from (select *, row_number() over (partition by p_brand order by p_partkey) as r from part) where r <= 8""",
    "required_vs_seen": "select conv_id, array_to_string(list_sort(list_filter(['system', 'user', 'assistant', 'tool'], lambda x: not list_contains(list(role), x))), ',') as missing from conversations group by 1",
    "run_summary": "select conv_id, count(*) as turns, count(*) filter (role = 'user') as questions, sum(length(text))::bigint as chars, array_to_string(list_sort(list(distinct role)), ',') as roles from conversations group by 1",
    "p50_p95": """with r as (select event_type, value, row_number() over (partition by event_type order by value) as r, count(*) over (partition by event_type) as n from events where value is not null)
select event_type, max(n) as n, median(value) as median, max(case when n > 1 and r = floor(n * 0.95) then value end) as p95 from r group by 1""",
    "check_share": "select round(avg((quality = 1)::int), 3) as quality_share, round(avg((toxic = 0)::int), 3) as clean_share, count(*) as n from labels",
    "gap_repeats": r"select substr(trim(regexp_replace(lower(props), '[ \t\n\r\f]+', ' ', 'g')), 1, 80) as gap, count(*) as n from events where props is not null group by 1 having count(*) > 1",
    "redact": "select c_custkey, c_name || ' Bearer *** sk-***' as masked from customer",
    "value_locations": None,
}
#: The columns that each table is searched in are found from its schema.
ORACLE_SQL["value_locations"] = f"""with f as (
  select 'nation' as table_name, 'n_name' as column_name, 1 as place, count(*) as n_rows from nation where {_norm('n_name')} = {_norm("'asia'")}
  union all select 'region', 'r_name', 1, count(*) from region where {_norm('r_name')} = {_norm("'asia'")}
  union all select 'customer', 'c_name', 1, count(*) from customer where {_norm('c_name')} = {_norm("'asia'")}
  union all select 'supplier', 's_name', 1, count(*) from supplier where {_norm('s_name')} = {_norm("'asia'")}
  union all select 'part', 'p_name', 1, count(*) from part where {_norm('p_name')} = {_norm("'asia'")})
select table_name, column_name, n_rows from f where n_rows > 0 order by table_name limit 4"""

_EACH = """with s as (select q.vec_id as query_id, e.vec_id, round(list_dot_product(e.embedding::double[], q.embedding::double[]), 12) as dot from embeddings e, embeddings q where q.vec_id % 100 = 0 and {}),
r as (select *, row_number() over (partition by query_id order by dot desc, vec_id) as r from s) select query_id, vec_id, round(dot, 5) as score from r where r <= 10"""
ORACLE_SQL |= {
    "term_df": f"with {_TOKENS} select term, count(distinct doc_id) as df, count(*) as tf from terms group by 1",
    "bm25_idf": f"with {_TOKENS} select term, count(distinct doc_id) as df, round(ln(1 + ((select count(*) from documents) - count(distinct doc_id) + 0.5) / (count(distinct doc_id) + 0.5)), 6) as idf from terms group by 1",
    "cosine_topk": _EACH.format("true"),
    "cosine_topk_filtered": _EACH.format("e.label = 1"),
    "section_inherit": """with own as (select distinct l_orderkey, l_linenumber from lineitem),
x as (select o.l_orderkey, o.l_linenumber, w.l_suppkey from own o join (select distinct l_orderkey, l_suppkey from lineitem) w using (l_orderkey)
  where not exists (select 1 from lineitem e where e.l_orderkey = o.l_orderkey and e.l_linenumber = o.l_linenumber and e.l_suppkey = w.l_suppkey))
select l_orderkey, l_linenumber, coalesce(array_to_string(list_sort(list(x.l_suppkey) filter (x.l_suppkey is not null)), ','), '') as tables from own left join x using (l_orderkey, l_linenumber) group by 1, 2""",
    "graph_stats": """with a as (select l_suppkey, count(distinct l_orderkey) as n from lineitem group by 1), b as (select l_suppkey, count(distinct l_partkey) as n from lineitem group by 1)
select (select sum(n)::bigint from a) as left_edges, (select sum(n)::bigint from b) as right_edges, (select count(*) from a) as left_tables, (select count(*) from b) as right_tables, (select count(*) from a join b using (l_suppkey)) as shared_tables""",
}

QUERIES = {name: globals()[name] for name in ORACLE_SQL}
#: Without SQL: the pairs are too many for it, or no text of the tables repeats.
WITHOUT_SQL = {"code_for_clause": code_for_clause, "gap_repeats_all": gap_repeats_all}
