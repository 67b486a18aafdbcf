"""Lookups by name against plain loops over one call at a time."""

import random
import re

import pytest
from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.operators import cascade

TABLES = {
    "3": ("lines", "Линии печати", "ТР-1", "5", ["Line", "Код линии", "Калибр"], [(1, "ЛП1", "Флексо", "40"), (2, "ЛП2", "Цифра", "50"), (4, "ЛП2", None, "60")]),
    "12": ("blocks", "Минимальные блоки", "ТР-2", "5", ["Калибр", "Блок 3"], [(1, "40", "ЛП1"), (2, "A1", "Q")]),
    "20": ("speed", "Нормы линии", None, None, ["Line", "норма"], []),
}
REFS = ["table 3", "12", "Табл. 20", "LINES", "линии  печати", "линии", "минимальн", "Приложение 5", "7", "nothing", "", None, "блоки 99", "А1"]


@pytest.fixture(scope="module")
def inputs(spark):
    catalogue = spark.createDataFrame([(i, n, t[0], t[1], t[2], t[3]) for i, (n, t) in enumerate(TABLES.items())], "place int, table_no string, slug string, title string, document string, appendix string")
    headers = spark.createDataFrame([(n, i, c) for n, t in TABLES.items() for i, c in enumerate(t[4])], "table_no string, position int, column string")
    frames = {n: (spark.createDataFrame(t[5], "r long, " + ", ".join(f"`{c}` string" for c in t[4])), "r") for n, t in TABLES.items()}
    rows = cascade.as_rows(frames).withColumn("cells", F.map_filter("cells", lambda k, _: k != "r"))
    words = {w for r in REFS for w in [r]} | {c for t in TABLES.values() for c in (t[0], t[1], *t[4])} | {v for t in TABLES.values() for row in t[5] for v in row[1:]}
    return catalogue, headers, rows, words


def keys(spark, words):
    got = spark.createDataFrame([(w,) for w in words if w is not None], "w string").select("w", text.normalize_key(F.col("w")).alias("k")).collect()
    return {None: ""} | {r["w"]: r["k"] for r in got}


def brute(ref, filters, key):
    """(route, outcome, table, total, first row, detail) of one call."""
    number = re.search(r"\d+", ref or "")
    table = number[0] if number and number[0] in TABLES else None
    k = key[ref]
    table = table or next((n for n, t in TABLES.items() if k and k in (key[t[0]], key[t[1]])), None) or next((n for n, t in TABLES.items() if k and k in key[t[1]]), None)
    if not table:
        hints = sorted(" ".join(x for x in (t[2], n) if x) for n, t in TABLES.items() if number and t[3] == number[0])
        return ("failed", "appendix", None, 0, None, "; ".join(hints)) if hints else ("failed", "unknown table", None, 0, None, None)
    columns = TABLES[table][4]
    where = []
    for name, value in filters:
        c = next((c for c in columns if key[c] == key[name]), None) or next((c for c in columns if key[name] and key[name] in key[c]), None)
        if not c:
            return ("failed", "unknown column", table, 0, None, min(n for n, _ in filters if not any(key[n] and key[n] in key[c] for c in columns)))
        where.append((c, value))
    rows = [r for r in TABLES[table][5] if all(r[1 + columns.index(c)] == v and v is not None for c, v in where)]
    if rows:
        return ("evidence", "found", table, len(rows), rows[0][0], f"table {table}, row {rows[0][0]}")
    absent = []
    for c, v in where:
        there = {r[1 + columns.index(c)] for r in TABLES[table][5]} - {None}
        if v not in there:
            absent.append((v, min((x for x in there if key[x] == key[v] and v is not None), default=None)))
    if twin := next(((v, t) for v, t in absent if t), None):
        return ("evidence", "look-alike", table, 0, None, f"{twin[0]} ~ {twin[1]}")
    places = []
    for n, t in TABLES.items():
        first = next((c for i, c in enumerate(t[4]) for v, _ in absent if v and len(key[v]) >= 2 and any(r[1 + i] is not None and key[r[1 + i]] == key[v] for r in t[5])), None)
        if n != table and first:
            places.append(f"table {n}, {first}")
    return ("failed", "elsewhere", table, 0, None, "; ".join(places[:4])) if places else ("evidence", "missing", table, 0, None, f"table {table} (no matches)")


def test_every_outcome_against_plain_loops(spark, inputs):
    catalogue, headers, rows, words = inputs
    rng = random.Random(3)
    names = ["Line", "калибр", "код", "блок 3", "норма", "line", "цвет", "к"]
    values = ["ЛП1", "ЛП2", "лп1", "40", "60", "Флексо", "A1", "Q", "q", "нет", "", None]
    key = keys(spark, words | set(names) | set(values) | {"3"})
    calls = [(i, rng.choice(REFS), [(rng.choice(names), rng.choice(values)) for _ in range(rng.choice((0, 1, 1, 2)))]) for i in range(700)]
    calls = [(i, r, list(dict(f).items())) for i, r, f in calls] + [(9000, "3", None)]
    df = spark.createDataFrame(calls, "call int, ref string, filters array<struct<name:string,value:string>>")
    answers = cascade.lookups(df, catalogue, headers, rows)
    got = {r["call"]: tuple(r)[1:] for r in answers.select("call", "route", "outcome", "table_no", "total", "first_row", "detail").collect()}
    assert len(got) == len(calls) == answers.count()
    for i, ref, filters in calls:
        assert got[i] == brute(ref, filters or [], key), (ref, filters)
    assert {g[1] for g in got.values()} == {"found", "look-alike", "missing", "elsewhere", "appendix", "unknown table", "unknown column"}
    shown = cascade.rows_of(df, answers, headers, rows, limit=2).collect()
    assert {i for i, g in got.items() if g[1] == "found"} == {r["call"] for r in shown}
    for i, g in got.items():
        own = sorted(r["row"] for r in shown if r["call"] == i)
        assert len(own) == min(2, g[3]) and (not own or own[0] == g[4])


def test_empty_tables_and_no_nested_loop(spark, inputs):
    catalogue, headers, rows, _ = inputs
    none = spark.createDataFrame([], "call int, ref string, filters array<struct<name:string,value:string>>")
    out = cascade.lookups(none, catalogue, headers, rows)
    assert out.count() == 0 and "NestedLoop" not in out._jdf.queryExecution().toString() and "CartesianProduct" not in out._jdf.queryExecution().toString()
