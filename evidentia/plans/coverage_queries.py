"""Queries of the coverage of conditions and the grounding of conflicts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.operators import coverage, grounding, retrieval, shared, stages

from .reference_queries import table
from .rule_queries import CYRILLIC, LATIN



def cyrillic(c):
    return F.translate(F.lower(c), LATIN, CYRILLIC)


def _dictionary(spark, d):
    """A name of two words and an identifier of the same from each first turn; its table and whether it holds numbers."""
    first = table(spark, d, "conversations").where("turn = 0 and text is not null")
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)), 2, 2)
    rows = first.select("conv_id", words.alias("w"), F.concat(F.lit("src"), F.col("conv_id") % 8).alias("table_name"), (F.length("text") % 4 > 0).alias("is_number")).where("size(w) = 2")
    return rows.select("conv_id", cyrillic(F.array_join("w", " ")).alias("name"), F.array_join("w", "_").alias("ident"), "table_name", "is_number")


def _clauses(spark, d):
    return table(spark, d, "documents").where("lang is not null").select(F.col("lang").alias("stage"), F.col("doc_id").alias("clause"), F.col("doc_id").alias("place"), cyrillic(F.col("text")).alias("text"), F.array("source").alias("tables"))


def _code(spark, d):
    stage = F.regexp_extract("url", "/(de|en|es|fr)/", 1)
    return table(spark, d, "pages").select(stage.alias("stage"), F.col("page_id").alias("place"), F.col("html").alias("text"))


def uncovered_conditions(spark, d):
    rows = _dictionary(spark, d)
    params = coverage.parameters(rows, "name", "ident", "conv_id")
    columns = rows.select(F.col("name").alias("param"), "table_name", "is_number")
    code = _code(spark, d)
    return coverage.with_places(coverage.uncovered(params, _clauses(spark, d), code, columns), code)


def reverse_names(spark, d):
    return coverage.reverse_names(coverage.parameters(_dictionary(spark, d), "name", "ident", "conv_id"))


def stemmed(word: str) -> str:
    """SQL of a word without its ending, taken off twice."""
    once = lambda w: rf"case when regexp_matches({w}, '[а-яё]') then regexp_replace({w}, '{text.STEM}', '\1') else {w} end"
    return once(f"({once(word)})")


TOKENS = r"[\p{L}\p{N}]+(?:[-.][\p{L}\p{N}]+)*"
_DICTIONARY = rf"""t as (select conv_id, regexp_extract_all(lower(text), '\p{{L}}+')[2:3] as w, 'src' || (conv_id % 8) as table_name, length(text) % 4 > 0 as is_number from conversations where turn = 0 and text is not null),
rows as (select conv_id, translate(array_to_string(w, ' '), '{LATIN}', '{CYRILLIC}') as param, array_to_string(w, '_') as ident, table_name, is_number from t where len(w) = 2),
named as (select param, min(conv_id) as place, arg_min(ident, (conv_id, ident)) as ident from rows group by 1),
name_terms as (select distinct param, {stemmed('w')} as stem from (select param, unnest(regexp_extract_all(param, '{TOKENS}')) as w from named)),
stems as (select * from name_terms where length(stem) >= 3),
params as (select * from named where param in (select param from stems)),
parts as (select distinct param, part from (select param, unnest(list_concat(regexp_split_to_array(lower(ident), '[_\s]+'), [replace(param, ' ', '')])) as part from params) where length(part) >= 3)"""

ORACLE_SQL = {
    "reverse_names": f"with {_DICTIONARY} select part, stem, count(*) as n from parts join name_terms using (param) group by 1, 2",
    "uncovered_conditions": rf"""with {_DICTIONARY},
words as (select distinct doc_id, w from (select doc_id, unnest(regexp_extract_all(translate(lower(text), '{LATIN}', '{CYRILLIC}'), '{TOKENS}')) as w from documents where lang is not null)),
split as (select doc_id, w from words union select doc_id, unnest(regexp_split_to_array(w, '[-.]')) from words where regexp_matches(w, '[-.]')),
known as (select w, {stemmed('w')} as stem from (select distinct w from split)),
terms as (select distinct doc_id, stem from split join known using (w)),
told as (select distinct a.param, s.stem from parts a join parts b using (part) join name_terms s on s.param = b.param),
sense as (select param, stem from stems union select * from told),
hits as (select param, doc_id from stems join terms using (stem) group by 1, 2 having count(*) = (select count(*) from stems s where s.param = stems.param)),
facts as (select param, list(distinct table_name) as own, bool_or(is_number) as is_number from rows group by 1),
ranked as (select h.param, p.place, d.doc_id, d.lang as stage, row_number() over (partition by d.lang, h.param order by not list_contains(f.own, d.source),
  -(select count(*) from sense s join terms t using (stem) where s.param = h.param and t.doc_id = h.doc_id), d.doc_id) as r
  from hits h join params p using (param) join facts f using (param) join documents d on d.doc_id = h.doc_id where f.is_number),
code as (select page_id, regexp_extract(url, '/(de|en|es|fr)/', 1) as stage, regexp_replace(lower(html), '[_ ]', '', 'g') as body from pages),
missed as (select stage, place, param, doc_id as clause from ranked r where r = 1 and not exists (select 1 from code c join params p on p.param = r.param
  where c.stage = r.stage and (contains(c.body, regexp_replace(lower(p.ident), '[_ ]', '', 'g')) or contains(c.body, replace(p.param, ' ', ''))))),
first as (select *, row_number() over (partition by stage order by place, param) as rank from missed)
select f.stage, rank::int as rank, param, clause, c.page_id as code_place from first f left join code c using (stage) where rank <= 6""",
}

QUERIES = {name: globals()[name] for name in ORACLE_SQL}
WITHOUT_SQL = {}


def conflict_grounding(spark, d):
    """Orders as runs: lines that came back are what was read, open lines are conflicts about a part, and all lines' parts are omissions in turn."""
    li = table(spark, d, "lineitem").where("l_orderkey is not null and l_partkey is not null and l_suppkey is not null")
    lines = li.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("run"), "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_discount", cyrillic(F.col("p_name")).alias("name"),
    )
    lines = shared.stored(lines, "lines")
    clause, code = F.concat(F.lit("part, row "), "l_partkey").alias("clause"), F.concat(F.lit("supplier, row "), "l_suppkey").alias("code")
    place = F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey")
    n = place * 1_000_000 + F.col("l_suppkey")
    read = lines.where("l_returnflag <> 'N'")
    known = read.select("run", F.explode(F.array(F.struct(F.lit("part").alias("head"), F.col("l_partkey").alias("row")), F.struct(F.lit("supplier").alias("head"), F.col("l_suppkey").alias("row")))).alias("k")).select("run", "k.head", "k.row")
    # Locators are written out for distinct rows.
    conflicts = lines.where("l_linestatus = 'O'").select("run", n.alias("n"), "name", "l_partkey", "l_suppkey").distinct().select("run", "n", F.col("name").alias("subject"), clause.alias("expected_source"), code.alias("actual_source"))
    omissions = lines.select("run", place.alias("place"), "name", "l_partkey").distinct().select("run", "place", F.col("name").alias("param"), clause)
    places = lines.groupBy("run", "l_suppkey").agg(F.min(place).alias("code_order")).select("run", code, "code_order")
    links = lines.groupBy("l_partkey", "l_suppkey").agg(F.min("run").alias("link_order")).select(clause, code, "link_order")
    said = lines.where("l_discount > 0.05").groupBy("run").agg(F.array_join(F.array_sort(F.collect_set("name")), " ").alias("question"))
    questions = table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), (F.col("o_orderstatus") == "F").alias("checking")).join(said, "run", "left")
    return grounding.ground(conflicts, omissions, places, links, known, questions)


def stage_of_turns(spark, d):
    """Turns as questions about languages as stages: sources' first documents name some, and what only one language's documents have tells the others."""
    docs = table(spark, d, "documents").where("lang is not null and text is not null")
    # A language's words are stemmed once each.
    tokens = shared.stored(shared.dealt(docs.select("lang", "text")).select("lang", F.array_distinct(text.tokenize(cyrillic(F.col("text")))).alias("words")), "words")
    # Stored, as conditions on stems would be pushed to where every word of a text is stemmed for them.
    words = shared.stored(tokens.select("lang", F.explode("words").alias("word")).distinct(), "distinct")
    stems = words.select("lang", text.stem(F.col("word")).alias("term"))
    lexicon = retrieval.exclusive_terms(stems, "lang").select("term", F.col("lang").alias("stage"))
    opening = F.regexp_replace(F.regexp_extract(cyrillic(F.col("text")), r"^\P{L}*+(\p{L}++(?:\P{L}++\p{L}++)?)", 1), r"\P{L}+", " ")
    names = docs.groupBy(opening.alias("name")).agg(F.min("lang").alias("stage")).where("length(name) >= 5")
    none = lambda kind: spark.createDataFrame([], kind)
    turns = table(spark, d, "conversations").where("text is not null").select((F.col("conv_id") * 100 + F.col("turn")).alias("turn"), cyrillic(F.col("text")).alias("q"), F.lit(None).cast("string").alias("e"))
    return stages.detect(turns, "turn", "q", "e", "e", "e", names, none("code string, stage string"), none("number int, stage string"), none("title string, number int"), lexicon)


ORACLE_SQL["stage_of_turns"] = rf"""with d as (select lang, translate(lower(text), '{LATIN}', '{CYRILLIC}') as t from documents where lang is not null and text is not null),
q as (select conv_id * 100 + turn as turn, trim(regexp_replace(translate(lower(text), '{LATIN}', '{CYRILLIC}'), '\s+', ' ', 'g')) as q from conversations where text is not null),
dw as (select distinct lang, unnest(regexp_extract_all(t, '{TOKENS}')) as w from d), ds as (select * from dw union select lang, unnest(regexp_split_to_array(w, '[-.]')) from dw where regexp_matches(w, '[-.]')),
qw as (select distinct turn, unnest(regexp_extract_all(q, '{TOKENS}')) as w from q), qs as (select * from qw union select turn, unnest(regexp_split_to_array(w, '[-.]')) from qw where regexp_matches(w, '[-.]')),
stem as (select w, {stemmed('w')} as s from (select w from ds union select w from qs)),
lexicon as (select s, min(lang) as lang from ds join stem using (w) where length(s) >= 4 and not regexp_matches(s, '^[0-9]+$') group by 1 having count(distinct lang) = 1),
votes as (select turn, lang, count(*) as n from (select distinct turn, s from qs join stem using (w)) join lexicon using (s) group by 1, 2),
top as (select turn, arg_max(lang, n) as lang from (select *, max(n) over (partition by turn) as most from votes) where n = most group by turn having count(*) = 1 and max(n) >= 2),
names as (select array_to_string(regexp_extract_all(t, '\p{{L}}+')[1:2], ' ') as name, min(lang) as lang from d group by 1 having length(name) >= 5),
named as (select turn, arg_min(lang, (-length(name), lang)) as lang from q join names on contains(q, name) group by 1)
select q.turn, coalesce(n.lang, t.lang) as stage, case when n.turn is not null then 'document' when t.turn is not null then 'lexicon' else 'none' end as how
from q left join named n using (turn) left join top t using (turn)"""
ORACLE_SQL["conflict_grounding"] = rf"""with lines as (select l_orderkey as run, l_linenumber, l_partkey as p, l_suppkey as s, l_returnflag, l_linestatus, l_discount, translate(lower(p_name), '{LATIN}', '{CYRILLIC}') as name,
  l_linenumber::bigint * 1000000000 + l_partkey as place from lineitem join part on l_partkey = p_partkey where l_orderkey is not null and l_suppkey is not null),
stem as (select name, w, {stemmed('w')} as stem from (select distinct name, unnest(regexp_extract_all(name, '{TOKENS}')) as w from lines)),
parts as (select distinct run, p from lines where l_returnflag <> 'N'), codes as (select distinct run, s from lines where l_returnflag <> 'N'),
conflicts as (select distinct run, place * 1000000 + s as n, name, p, s, exists (select 1 from parts k where k.run = l.run and k.p = l.p) and exists (select 1 from codes k where k.run = l.run and k.s = l.s) as stays from lines l where l_linestatus = 'O'),
omissions as (select distinct run, place, name, p from lines),
read as (select run, s, min(place) as code_order from lines semi join codes using (run, s) group by 1, 2),
links as (select p, s, min(run) as link_order from lines group by 1, 2),
near as (select o.run, o.p, arg_min(r.s, (l.link_order, 'supplier, row ' || r.s)) as s from (select distinct run, p from omissions semi join parts using (run, p)) o join links l on l.p = o.p join read r on r.run = o.run and r.s = l.s group by 1, 2),
shown as (select o.run, o.place, o.name, o.p, coalesce(near.s, f.s) as s from omissions o semi join parts using (run, p) join (select run, arg_min(s, (code_order, 'supplier, row ' || s)) as s from read group by 1) f on f.run = o.run left join near on near.run = o.run and near.p = o.p),
match as (select c.run, c.n, min(o.place) as place from conflicts c join stem a on a.name = c.name join stem b on b.stem = a.stem join omissions o on o.run = c.run and o.name = b.name where not c.stays group by 1, 2),
judged as (select c.run, case when c.stays then 'grounded' when x.run is not null then 'rescued' else 'dropped' end as origin, c.n, coalesce(x.name, c.name) as subject, coalesce(x.p, c.p) as p, coalesce(x.s, c.s) as s
  from conflicts c left join match m on m.run = c.run and m.n = c.n left join shown x on x.run = m.run and x.place = m.place),
taken as (select distinct j.run, stem from judged j join stem on name = subject where origin <> 'dropped'),
said as (select distinct run, stem from lines join stem using (name) where l_discount > 0.05),
found as (select x.* from shown x join orders on o_orderkey = x.run where not exists (select 1 from stem join taken using (stem) where stem.name = x.name and taken.run = x.run)
  and (o_orderstatus = 'F' or not exists (select 1 from stem where stem.name = x.name and stem.stem not in (select stem from said where said.run = x.run))))
select run, origin, n, subject, 'part, row ' || p as expected_source, 'supplier, row ' || s as actual_source from judged
union all select run, 'found', place, name, 'part, row ' || p, 'supplier, row ' || s from found"""

QUERIES = {name: globals()[name] for name in ORACLE_SQL}
