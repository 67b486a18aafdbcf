"""Queries of chunks, sentences, rules, stages and the stored index over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.operators import chunks, evidence, index, rules, sentences, shared, stages

from .reference_queries import ORACLE_SQL as OTHERS
from .reference_queries import TERMS, table

APPENDIX = {"2": "11", "3": "9", "5": "30"}
NUMBERS = {"assortment": "7", "waste_exceptions": "12", "extrusion_outcome": "10", "color_matrix": "4"}
HINTS = [("регламент", "regulations"), ("код", "code"), ("журнал", "logs"), ("план", "plan")]
QUESTIONS = (
    "Что на этапе печати?", "Верно ли по  ТР-КОЛ-2026 и ТР-КОЛ?", "Почему на ЛК2 и эк1?", "Что в табл. 12", "Таблица минимальных блоков", "переход калибра", "переход и краска", "Где заказ?",
)


def strike_sentences(spark, d):
    k = F.col("o_orderkey")
    answer = F.concat(F.lit("Order "), k, F.lit(" is open [Orders, row "), k, F.lit("].  Nothing [made up. Or so] holds. It is late! so it goes. End"))
    answers = table(spark, d, "orders").select("o_orderkey", answer.alias("answer"))
    known = table(spark, d, "lineitem").select(F.lit("orders").alias("head"), F.col("l_orderkey").alias("row")).distinct()
    bad = evidence.known_citations(answers, "o_orderkey", "answer", known).where("not is_known")
    return sentences.strike(answers, "o_orderkey", "answer", bad, "citation").select("o_orderkey", "kept", F.array_join("dropped", "|").alias("dropped"))


def clause_chunks(spark, d):
    n = F.col("l_linenumber").cast("string")
    head = F.concat(n, F.lit(". "), F.when(F.col("l_returnflag") == "A", "Охрана труда").otherwise(F.concat(F.lit("Порядок "), "l_returnflag")))
    rule = F.concat(F.lit("1."), n, F.when(F.col("l_linenumber") % 2 == 0, ". ").otherwise("  "), F.lit("Линия "), F.col("l_suppkey").cast("string"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber").isin(2, 4), head).otherwise(rule).alias("paragraph"))
    return chunks.clauses(rows, "l_orderkey", ["l_linenumber"], "paragraph")


def table_refs(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    body = F.concat(F.lit("По ПРИЛОЖЕНИЯМ 2, 3 и "), F.col("l_suppkey") % 9, F.lit(", см. табл. "), F.col("l_partkey") % 40)
    return li.select("l_suppkey", "l_partkey", F.array_join(chunks.referenced_tables(body, APPENDIX), ",").alias("tables"))


def code_tables(spark, d):
    key = F.element_at(F.lit(["assortment", "waste_exceptions", "unknown_key"]), (F.col("p_size") % 3 + 1).cast("int"))
    source = F.concat(F.lit("rows = tables[ '"), key, F.lit("' ]  # Таблица "), F.col("p_partkey") % 20, F.when(F.col("p_size") % 2 == 0, "\nself.perf_index[x]").otherwise("\nself.color_indexes"))
    return table(spark, d, "part").select("p_partkey", F.array_join(chunks.code_tables(source, NUMBERS), ",").alias("tables"))


def document_heads(spark, d):
    t = F.when(F.col("turn") == 0, F.concat(F.lit("Технологический регламент. Этап "), F.when(F.col("conv_id") % 2 == 0, "печати").otherwise("Сушки"), F.lit(" "), "conv_id"))
    t = t.when((F.col("turn") == 1) & (F.col("conv_id") % 3 > 0), F.concat(F.lit("Номер документа:  ТР-"), "conv_id", F.lit("-2026/03. Введён"))).otherwise(F.lit("Иное"))
    return chunks.heads(table(spark, d, "conversations").select("conv_id", "turn", t.alias("paragraph")), "conv_id", "turn", "paragraph")


def symbol_search(spark, d):
    found = table(spark, d, "part").where(text.code_key(F.col("p_type")).contains(text.code_key(F.lit("O_")))).select("p_partkey", "p_type")
    return found.orderBy("p_partkey").limit(10).join(F.broadcast(found.agg(F.count("*").alias("total"))), F.lit(True))


def _state(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        "o_orderkey", (k % 3).alias("facts"), (k % 5 % 2).alias("failed"), (k % 7 % 2).alias("calls"), (k % 11 % 3).alias("iterations"), (k % 13 % 2).alias("missing"), (k % 17 % 3).alias("repeats"),
        F.when(k % 19 == 0, "max_iterations").alias("reached"), F.element_at(F.lit(["confirmed", "conflict", "error", "clarify", "insufficient"]), (k % 23 % 5 + 1).cast("int")).alias("status"),
        (k % 101 / 100).alias("confidence"), (k % 2 == 0).alias("flag"), (k % 29 % 2).alias("unknown"), (k % 31 % 3).alias("found"), (k % 37 % 2).alias("critical"), (k % 41 % 4 == 1).cast("int").alias("struck"), (k % 43 % 2).alias("revisions"),
    )


def observe_rules(spark, d):
    c = F.col
    return _state(spark, d).select("o_orderkey", rules.observe(c("facts"), c("failed"), c("calls"), F.lit(1), F.lit(0), c("iterations"), c("missing"), c("repeats"), c("reached")).alias("action"))


def route_rules(spark, d):
    c = F.col
    s = _state(spark, d).withColumn("settled", rules.consistency(c("status"), c("confidence"), c("flag")))
    return s.select(
        "o_orderkey", "settled", rules.after_classify(c("status")).alias("classified"), rules.after_observe(c("status"), c("flag")).alias("observed"), rules.after_consistency(c("settled")).alias("concluded"),
        rules.after_verify(c("critical"), c("revisions"), c("flag"), c("status") == "conflict").alias("verified"),
    )


def verdict_rules(spark, d):
    c = F.col
    v = rules.verdict(c("unknown"), c("found"), F.least("critical", "found"), c("struck"), c("flag"), c("revisions"), c("status") == "conflict", c("status"), F.when(c("confidence") > 0.5, "high").otherwise("mid"))
    return _state(spark, d).select("o_orderkey", v.alias("v")).select("o_orderkey", "v.action", "v.status", "v.label")


def source_plan(spark, d):
    c = F.col
    gaps = F.when(c("failed") == 1, F.lit(["нет записи в журнале", "Код не прочитан, план тоже"])).otherwise(F.lit(["иное"]))
    asked = F.when(c("flag"), F.lit(["что говорит РЕГЛАМЕНТ"])).otherwise(F.lit(["что в плане"]))
    plan = rules.planned_sources(F.lit(["nsi", "plan"]), rules.hinted(asked, HINTS), F.when(c("facts") == 0, "B-1"), rules.hinted(gaps, HINTS), c("critical") == 1, c("iterations"), F.lit(["logs", "config"]))
    return _state(spark, d).select("o_orderkey", F.array_join(plan, ",").alias("sources"))


def case_checks(spark, d):
    c, none = F.col, F.array().cast("array<string>")
    s = _state(spark, d)
    s = s.select(
        "o_orderkey", F.when(c("facts") > 0, F.lit(["confirmed", "conflict"])).otherwise(none).alias("w_intents"), F.when(c("failed") == 1, "deep").otherwise("").alias("w_role"), F.lit(["nsi", "plan"]).alias("w_sources"),
        F.lit(["confirmed", "insufficient"]).alias("w_statuses"), F.when(c("calls") == 1, F.lit(["Табл. 7", "п. 3.1"])).otherwise(none).alias("w_cite"), F.lit(["наверное"]).alias("w_forbidden"), (c("missing") == 1).alias("w_ticket"),
        c("status").alias("intent"), F.when(c("flag"), "deep").otherwise("fast").alias("role"), F.when(c("repeats") > 0, F.lit(["plan", "nsi", "code"])).otherwise(F.lit(["nsi"])).alias("seen"), c("status").alias("status"),
        F.when(c("iterations") == 0, "Наверное, по табл. 7").otherwise("По табл. 7").alias("answer"), F.when(c("critical") == 1, "обращение").alias("ticket"),
        F.when(c("unknown") == 1, F.lit(["x"])).otherwise(none).alias("unknown"), F.when(c("revisions") == 1, F.lit(["ТР-ПЕЧ П. 3.1"])).otherwise(none).alias("known"),
    )
    want = {x: f"w_{x}" for x in ("intents", "role", "sources", "statuses", "cite", "forbidden", "ticket")}
    out = rules.case_checks(s, want, {x: x for x in ("intent", "role", "seen", "status", "answer", "ticket", "unknown", "known")})
    return out.select("o_orderkey", *[x for x in out.columns if x.startswith("check_")], "passed")


def detect_stage(spark, d):
    q = F.element_at(F.lit(list(QUESTIONS)), (F.col("event_id") % 8 + 1).cast("int"))
    rows = table(spark, d, "events").select("event_id", q.alias("q"), F.when(F.col("event_id") % 24 == 7, "на экструзии").alias("named"), F.when(F.col("event_id") % 24 == 15, "ЛК2").alias("line"), F.lit(None).cast("string").alias("no"))
    pairs = lambda rows, names: spark.createDataFrame(rows, names)
    return stages.detect(
        rows, "event_id", "q", "named", "line", "no", pairs([("ТР-КОЛ-2026", "кольцевание"), ("ТР-КОЛ", "экструзия")], "name string, stage string"),
        pairs([("ЛК2", "кольцевание"), ("ЭК1", "экструзия")], "code string, stage string"), pairs([(12, "печать"), (15, "экструзия")], "number int, stage string"),
        pairs([("Минимальные блоки", 15), ("Выход печати", 12)], "title string, number int"), pairs([("переход", "экструзия"), ("калибр", "экструзия"), ("краск", "печать")], "term string, stage string"),
    )


def bm25_stored(spark, d):
    path = index.folder(spark, "terms")
    index.build(shared.dealt(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", path)
    return index.search(spark, path, " ".join(TERMS), 20).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


_STATE = """s as (select o_orderkey, o_orderkey % 3 as facts, o_orderkey % 5 % 2 as failed, o_orderkey % 7 % 2 as calls, o_orderkey % 11 % 3 as iterations, o_orderkey % 13 % 2 as missing, o_orderkey % 17 % 3 as repeats,
  o_orderkey % 19 = 0 as reached, ['confirmed', 'conflict', 'error', 'clarify', 'insufficient'][o_orderkey % 23 % 5 + 1] as status, (o_orderkey % 101) / 100 as confidence, o_orderkey % 2 = 0 as flag,
  o_orderkey % 29 % 2 as unknown, o_orderkey % 31 % 3 as found, o_orderkey % 37 % 2 as critical, o_orderkey % 41 % 4 = 1 as struck, o_orderkey % 43 % 2 as revisions from orders)"""

ORACLE_SQL = {
    "strike_sentences": """with k as (select o_orderkey, 'Order ' || o_orderkey || ' is open [Orders, row ' || o_orderkey || '].' as s, exists (select 1 from lineitem where l_orderkey = o_orderkey) as ok from orders)
select o_orderkey, case when ok then s || ' ' else '' end || 'It is late! so it goes. End' as kept, case when ok then '' else s || '|' end || 'Nothing [made up. Or so] holds.' as dropped from k""",
    "clause_chunks": """with p as (select l_orderkey, l_linenumber as n, case when l_returnflag = 'A' then 'Охрана труда' else 'Порядок ' || l_returnflag end as title, 'Линия ' || l_suppkey as body from lineitem),
s as (select *, last_value(case when n in (2, 4) then n || '. ' || title end ignore nulls) over (partition by l_orderkey order by n, title rows between unbounded preceding and current row) as section from p)
select l_orderkey, '1.' || n as number, body, coalesce(section, '0. Без раздела') as section, coalesce(section not like '%Охрана%', true) as relevant from s where n not in (2, 4)""",
    "table_refs": """with p as (select distinct l_suppkey, l_partkey from lineitem)
select l_suppkey, l_partkey, array_to_string(list_sort(list_distinct([11, 9, l_partkey % 40] || case when l_suppkey % 9 = 5 then [30] else [] end)), ',') as tables from p""",
    "code_tables": "select p_partkey, array_to_string(list_sort(list_distinct([p_partkey % 20] || case p_size % 3 when 0 then [7] when 1 then [12] else [] end || case when p_size % 2 = 0 then [10] else [] end)), ',') as tables from part",
    "document_heads": """with c as (select conv_id, bool_or(turn = 0) as t, bool_or(turn = 1) and conv_id % 3 > 0 as n from conversations group by 1)
select conv_id, case when n then 'ТР-' || conv_id || '-2026/03' else conv_id::varchar end as number, split_part(case when n then 'ТР-' || conv_id || '-2026/03' else conv_id::varchar end, '-20', 1) as code,
  case when t then 'Технологический регламент. Этап ' || case when conv_id % 2 = 0 then 'печати' else 'Сушки' end || ' ' || conv_id else conv_id::varchar end as title, case when t and conv_id % 2 = 0 then 'печать' else '' end as stage from c""",
    "symbol_search": "select p_partkey, p_type, count(*) over () as total from part where contains(replace(replace(lower(p_type), '_', ''), ' ', ''), 'o') order by p_partkey limit 10",
    "observe_rules": f"""with {_STATE} select o_orderkey, case when facts = 0 then case when failed > 0 and not reached then 'retry_after_tool_error' when calls = 0 and not reached then 'retry_without_tool_calls' else 'insufficient' end
  when facts <= 1 and failed = 0 and iterations >= 2 then 'stop_no_progress' when missing = 1 and not reached and repeats < 2 then 'source_missing' else 'judge' end as action from s""",
    "route_rules": f"""with {_STATE}, t as (select *, case when status = 'confirmed' or status = 'conflict' and not flag then case when confidence >= 0.6 then 'confirmed' else 'insufficient' end else status end as settled from s)
select o_orderkey, settled, case status when 'error' then 'insufficient' when 'clarify' then 'clarify' else 'plan' end as classified, case when status = 'insufficient' then status when flag then 'consistency' else 'act' end as observed,
  case settled when 'conflict' then 'ticket' when 'confirmed' then 'answer' else 'insufficient' end as concluded, case when critical = 1 and revisions = 0 and flag and status <> 'conflict' then 'answer' else 'end' end as verified from t""",
    "verdict_rules": f"""with {_STATE}, t as (select *, least(critical, found) = 1 as c, unknown = 1 or struck as m, case when confidence > 0.5 then 'high' else 'mid' end as own from s),
a as (select *, case when not m and found = 0 and not flag then 'approved' when c and revisions = 0 and status <> 'conflict' then 'returned' when flag then 'unavailable' when m or (c and revisions = 0) then 'flagged' else 'flagged_minor' end as action from t)
select o_orderkey, action, case when action = 'flagged' and status = 'confirmed' then 'insufficient' else status end as status, case action when 'flagged' then 'low' when 'flagged_minor' then case own when 'high' then 'mid' else 'low' end else own end as label from a""",
    "source_plan": f"""with {_STATE}, l as (select *, 'nsi,plan' || case when flag then ',regulations' else '' end || case when facts = 0 then ',task' else '' end || case when failed = 1 then ',code,logs' else '' end as a from s),
m as (select *, a || case when critical = 1 and not contains(a, 'regulations') then ',regulations' else '' end || case when critical = 1 and failed = 0 then ',code' else '' end as b from l)
select o_orderkey, b || case when iterations >= 1 then case when contains(b, 'logs') then '' else ',logs' end || ',config' else '' end as sources from m""",
    "case_checks": f"""with {_STATE}, t as (select o_orderkey, case when facts > 0 then status in ('confirmed', 'conflict') end as check_intent, case when failed = 1 then flag end as check_role, repeats > 0 as check_sources, status in ('confirmed', 'insufficient') as check_status,
  unknown = 0 as check_known, case when calls = 1 then revisions = 1 end as check_cited, iterations > 0 as check_forbidden, case when missing = 1 then critical = 1 end as check_ticket from s)
select *, coalesce(check_intent, true) and coalesce(check_role, true) and check_sources and check_status and check_known and coalesce(check_cited, true) and check_forbidden and coalesce(check_ticket, true) as passed from t""",
    "detect_stage": """with e as (select event_id, case when event_id % 24 = 7 then 8 else event_id % 8 end as w, event_id % 24 = 15 as line from events)
select event_id, case when w = 0 then 'печать' when w = 1 then 'кольцевание' when w = 2 then 'кольцевание' when w = 3 then 'печать' when w in (4, 5, 8) then 'экструзия' when line then 'кольцевание' end as stage,
  case when w in (0, 8) then 'named' when w = 1 then 'document' when w = 2 or line then 'line' when w = 3 then 'table' when w = 4 then 'title' when w = 5 then 'lexicon' else 'none' end as how from e""",
    "bm25_stored": OTHERS["bm25_topk"],
}

QUERIES = {name: globals()[name] for name in ORACLE_SQL}
WITHOUT_SQL = {}
