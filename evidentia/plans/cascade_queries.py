"""Queries of lookups by the name of a table, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import cascade

from .reference_queries import _norm, table

#: The tables that calls may name: place, number, name, title, document, appendix.
CATALOGUE = ((1, "1", "region", "List of regions", "Rules A", "7"), (2, "2", "nation", "Nations of the world", "Rules B", "7"), (3, "3", "supplier", "Suppliers", "Rules A", "9"), (4, "4", "part", "Parts and brands", None, None))
KEYS = {"1": ("region", "r_regionkey"), "2": ("nation", "n_nationkey"), "3": ("supplier", "s_suppkey"), "4": ("part", "p_partkey")}


def _inputs(spark, d):
    catalogue = spark.createDataFrame(CATALOGUE, "place int, table_no string, slug string, title string, document string, appendix string")
    tables = {n: (table(spark, d, t), key) for n, (t, key) in KEYS.items()}
    headers = spark.createDataFrame([(n, i, c) for n, (df, _) in tables.items() for i, c in enumerate(df.columns)], "table_no string, position int, column string")
    return catalogue, headers, cascade.as_rows(tables)


def _calls(spark, d):
    """A call from each order: what it asks for follows from its priority and status, and the values from its customer and key."""
    o, c = table(spark, d, "orders"), F.col("o_custkey")
    brand, kind = F.concat(F.lit("Brand#"), (c % 30).cast("string")), F.element_at(F.array(*map(F.lit, ("ECONOMY", "STANDARD", "asia", "NАTION_3"))), (c % 4 + 1).cast("int"))
    nation = F.when(c % 3 == 0, F.concat(F.lit("NATION_"), (c % 40).cast("string"))).when(c % 3 == 1, F.element_at(F.array(*map(F.lit, ("ASIA", "NАTION_3", "red widget", "x"))), (c % 4 + 1).cast("int"))).otherwise(F.concat(F.lit("Supplier#"), F.lpad((c % 200).cast("string"), 9, "0")))
    one = lambda *pairs: F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in pairs])
    p, s = F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus")
    ref = F.when(p == "1", F.when(s == "F", "see table 4").otherwise(" PARTS  and brands")).when(p == "2", F.when(s == "F", "brands").otherwise("nation")).when(p == "3", F.when(s == "F", "appendix 7").otherwise("9")).when(p == "4", F.when(s == "F", "nothing").otherwise("table 2"))
    filters = (
        F.when(p == "1", one(("p_brand", brand), ("p_size", (c % 60).cast("string")))).when((p == "2") & (s == "F"), one(("type", kind), ("brand", brand))).when(p == "4", one(("n_name", nation)))
        .when((p == "2") & (c % 2 == 0), one(("colour", nation))).when(p == "2", one(("N_NAME", nation)))
    )
    return o.select(F.col("o_orderkey").alias("call"), ref.alias("ref"), filters.alias("filters"))


def lookup_cascade(spark, d):
    return cascade.lookups(_calls(spark, d), *_inputs(spark, d))


_ROWS = " union all ".join(f"select '{n}' as t, {key}::bigint as row, unnest([{cols}], recursive := true) from {t}" for n, (t, key, cols) in {
    "1": ("region", "r_regionkey", "{'p': 0, 'c': 'r_regionkey', 'v': r_regionkey::varchar}, {'p': 1, 'c': 'r_name', 'v': r_name}"),
    "2": ("nation", "n_nationkey", "{'p': 0, 'c': 'n_nationkey', 'v': n_nationkey::varchar}, {'p': 1, 'c': 'n_name', 'v': n_name}, {'p': 2, 'c': 'n_regionkey', 'v': n_regionkey::varchar}"),
    "3": ("supplier", "s_suppkey", "{'p': 0, 'c': 's_suppkey', 'v': s_suppkey::varchar}, {'p': 1, 'c': 's_name', 'v': s_name}, {'p': 2, 'c': 's_nationkey', 'v': s_nationkey::varchar}, {'p': 3, 'c': 's_acctbal', 'v': s_acctbal::varchar}"),
    "4": ("part", "p_partkey", "{'p': 0, 'c': 'p_partkey', 'v': p_partkey::varchar}, {'p': 1, 'c': 'p_name', 'v': p_name}, {'p': 2, 'c': 'p_brand', 'v': p_brand}, {'p': 3, 'c': 'p_type', 'v': p_type}, {'p': 4, 'c': 'p_size', 'v': p_size::varchar}, {'p': 5, 'c': 'p_retailprice', 'v': p_retailprice::varchar}"),
}.items())
ORACLE_SQL = {
    "lookup_cascade": rf"""with cells as ({_ROWS}), vals as (select t, c, min(p) as p, v, {_norm('v')} as k from cells where v is not null group by t, c, v),
o as (select o_orderkey as call, substr(o_orderpriority, 1, 1) as pr, o_orderstatus = 'F' as f, 'Brand#' || (o_custkey % 30) as brand, ['ECONOMY', 'STANDARD', 'asia', 'NАTION_3'][o_custkey % 4 + 1] as kind, (o_custkey % 60)::varchar as size, o_custkey % 2 = 0 as even,
  case o_custkey % 3 when 0 then 'NATION_' || (o_custkey % 40) when 1 then ['ASIA', 'NАTION_3', 'red widget', 'x'][o_custkey % 4 + 1] else 'Supplier#' || lpad((o_custkey % 200)::varchar, 9, '0') end as nation from orders),
r as (select *, case when pr = '1' then '4' when pr = '2' and f then '4' when pr = '2' then '2' when pr = '4' and not f then '2' end as t,
  case when pr = '3' then 'appendix' when t is null then 'unknown table' when pr = '2' and not f and even then 'unknown column' end as bad,
  case when pr = '3' and f then 'Rules A 1; Rules B 2' when pr = '3' then 'Rules A 3' when bad = 'unknown column' then 'colour' end as why from o),
flt as (select call, t, 0 as i, case when pr = '1' then 'p_brand' when pr = '2' and f then 'p_type' else 'n_name' end as c, case when pr = '1' then brand when pr = '2' and f then kind else nation end as v from r where bad is null
  union all select call, t, 1, case when pr = '1' then 'p_size' else 'p_brand' end, case when pr = '1' then size else brand end from r where bad is null and (pr = '1' or f)),
asked as (select call, t, max(c) filter (i = 0) as c0, max(v) filter (i = 0) as v0, max(c) filter (i = 1) as c1, max(v) filter (i = 1) as v1 from flt group by 1, 2),
quest as (select distinct t, c0, v0, c1, v1 from asked),
hits as (select q.t, c0, v0, c1, v1, count(*) as total, min(a.row) as first_row from quest q join cells a on a.t = q.t and a.c = c0 and a.v = v0 left join cells b on b.t = q.t and b.row = a.row and b.c = c1 and b.v = v1 where c1 is null or b.row is not null group by all),
found as (select call, total, first_row from asked join hits h on h.t = asked.t and h.c0 = asked.c0 and h.v0 = asked.v0 and h.c1 is not distinct from asked.c1 and h.v1 is not distinct from asked.v1),
absent as (select f.*, {_norm('f.v')} as k, (select min(x.v) from vals x where x.t = f.t and x.c = f.c and x.k = {_norm('f.v')}) as twin from flt f where not exists (select 1 from found where found.call = f.call) and not exists (select 1 from vals x where x.t = f.t and x.c = f.c and x.v = f.v)),
alike as (select call, arg_min(v || ' ~ ' || twin, i) as d from absent where twin is not null group by 1),
plc as (select a.call, x.t, arg_min(x.c, x.p) as c from absent a join vals x on x.k = a.k and x.t <> a.t and length(a.k) >= 2 where not exists (select 1 from alike where alike.call = a.call) group by 1, 2),
els as (select call, string_agg('table ' || t || ', ' || c, '; ' order by t) as d from plc group by 1)
select r.call, case when bad is not null then bad when found.call is not null then 'found' when alike.call is not null then 'look-alike' when els.call is not null then 'elsewhere' else 'missing' end as outcome,
  case when outcome in ('found', 'look-alike', 'missing') then 'evidence' else 'failed' end as route, r.t as table_no, coalesce(total, 0) as total, first_row,
  case when bad is not null then why when outcome = 'found' then 'table ' || r.t || ', row ' || first_row when outcome = 'missing' then 'table ' || r.t || ' (no matches)' else coalesce(alike.d, els.d) end as detail
from r left join found using (call) left join alike using (call) left join els using (call)""",
}

QUERIES = {name: globals()[name] for name in ORACLE_SQL}
WITHOUT_SQL = {}
