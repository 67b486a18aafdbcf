"""Coverage of conditions against brute force, by plain loops over the same rules."""

import random
import re

from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.operators import coverage

NAMES = [("Диаметр кольца", "ring_diameter"), ("Калибр", "caliber"), ("Блок 3, км", "min_caliber_block"), ("Вид оболочки", "kind"), ("Вид оболочки", "other"), ("мм", "mm"), (None, "x"), ("Цвет", None)]


def brute(params, clauses, code, columns, stems_of, most):
    """params: (name, ident) in order; the rules of the reference, one parameter at a time."""
    key = lambda s: re.sub("[_ ]", "", s.lower())
    table = {}
    for name, ident in params:
        if name and ident and any(len(t) >= 3 for t in stems_of(name.lower().strip())):
            table.setdefault(name.lower().strip(), ident)
    alias = {n: (i, n.replace(" ", "")) for n, i in table.items()}
    pieces = {n: {p for a in alias[n] for p in re.split(r"[_\s]+", a.lower()) if len(p) >= 3} for n in table}
    out = []
    for stage in {c[0] for c in clauses}:
        bodies = [key(c[2]) for c in code if c[0] == stage and c[2]]
        found = []
        for n in table:
            own = [r for r in columns if r[0].lower().strip() == n]
            if any(key(a) in b for a in alias[n] for b in bodies) or (any(r[2] for r in columns) and not any(r[2] for r in own)):
                continue
            stems = {t for t in stems_of(n) if len(t) >= 3}
            sense = stems | {t for o in table if pieces[o] & pieces[n] for t in stems_of(o)}
            hits = [c for c in clauses if c[0] == stage and c[3] and stems <= set(stems_of(c[3]))]
            if hits:
                tables = {r[1] for r in own}
                found.append((n, min(hits, key=lambda c: (not tables & set(c[4] or []), -len(sense & set(stems_of(c[3]))), c[2], c[1]))[1]))
        out += [(stage, i, *f) for i, f in enumerate(found[:most], 1)]
    return sorted(out)


def stemmer(spark, texts):
    rows = spark.createDataFrame([(t,) for t in set(texts)], "t string").select("t", text.terms(F.col("t")).alias("s")).collect()
    known = {r["t"]: r["s"] for r in rows}
    return known.__getitem__


def run(spark, params, clauses, code, columns, most=6):
    p = coverage.parameters(spark.createDataFrame([(i, *r) for i, r in enumerate(params)], "i int, name string, ident string"), "name", "ident", "i")
    got = coverage.uncovered(
        p, spark.createDataFrame(clauses, "stage string, clause string, place int, text string, tables array<string>"), spark.createDataFrame(code, "stage string, place string, text string"),
        spark.createDataFrame(columns, "param string, table_name string, is_number boolean"), most,
    )
    return sorted(tuple(r) for r in got.select("stage", "rank", "param", "clause").collect())


def test_the_clause_that_applies_a_parameter_is_found(spark):
    """The clause that refers to the parameter's table goes before a definition, and the one with more of its sense before another."""
    clauses = [
        ("экструзия", "п. 1.1", 1, "Блок — совокупность заказов, км", []),
        ("экструзия", "п. 3.2", 2, "Проверять блок 3, км общий", ["12"]),
        ("экструзия", "п. 3.5", 3, "Формирование блока 3 по калибру, км", ["12"]),
        ("кольцевание", "п. 5.1", 4, "Норматив для калибра и диаметра кольца", ["20"]),
        ("кольцевание", None, 5, None, None),
    ]
    code = [("экструзия", "run", "self.min_common_block + caliber"), ("кольцевание", "ring", "df.caliber == Caliber"), ("кольцевание", "none", None)]
    columns = [("Блок 3, км", "12", True), ("Диаметр кольца", "20", True), ("Калибр", "20", True), ("Вид оболочки", "20", False)]
    got = run(spark, NAMES, clauses, code, columns)
    assert got == [("кольцевание", 1, "диаметр кольца", "п. 5.1"), ("экструзия", 1, "блок 3, км", "п. 3.5")]


def test_random_rules_against_plain_loops(spark):
    rng = random.Random(4)
    words = ["калибр", "калибра", "кольца", "кольцо", "блок", "блока", "вид", "печати", "линии", "ширина", "цвет", "год"]
    idents = ["caliber", "ring", "block", "kind", "print", "line", "width", "color", "ab"]
    params = [(" ".join(rng.sample(words, rng.choice((1, 2, 2, 3)))).capitalize(), "_".join(rng.sample(idents, rng.choice((1, 2))))) for _ in range(40)]
    clauses = [(rng.choice("AB"), f"c{i}", rng.randrange(30), " ".join(rng.choices(words, k=rng.randrange(0, 9))), rng.sample(["1", "2", "3"], rng.randrange(3))) for i in range(60)]
    clauses += clauses[:3]
    code = [(rng.choice("AB"), f"f{i}", " ".join(rng.choices([*idents, "min_block", "Вид печати", "x=1"], k=2))) for i in range(3)]
    columns = [(n, rng.choice("123"), rng.random() < 0.7) for n, _ in params]
    stems_of = stemmer(spark, [n.lower().strip() for n, _ in params] + [c[3] for c in clauses])
    clauses_by_place = [(s, c, p, t, k) for s, c, p, t, k in clauses]
    expected = brute(params, [(s, c, p, t, k) for s, c, p, t, k in clauses_by_place], [(s, p, t) for s, p, t in code], columns, stems_of, 6)
    assert run(spark, params, clauses, code, columns) == expected and len(expected) > 4


def test_candidates_take_the_rarest_and_lose_none(spark):
    rng = random.Random(9)
    sets = [(i, [rng.choice("abcdefghij") for _ in range(rng.randrange(6))]) for i in range(300)] + [(1000 + i, ["a", "b"]) for i in range(400)] + [(2000, None)]
    asked = [(i, rng.sample("abcdefghijz", rng.choice((1, 2, 3)))) for i in range(60)] + [(99, []), (98, None)]
    s, a = spark.createDataFrame(sets, "s int, e array<string>"), spark.createDataFrame(asked, "a int, w array<string>")
    got = {(r["a"], r["s"]) for r in coverage.containing(s, "e", a, "w").collect()}
    assert got == {(i, j) for i, w in asked if w for j, e in sets if set(w) <= set(e or [])}


def test_no_nested_loop_and_empty_tables(spark):
    p = coverage.parameters(spark.createDataFrame([], "i int, name string, ident string"), "name", "ident", "i")
    c = spark.createDataFrame([], "stage string, clause string, place int, text string, tables array<string>")
    f = spark.createDataFrame([], "stage string, place string, text string")
    columns = spark.createDataFrame([], "param string, table_name string, is_number boolean")
    got = coverage.uncovered(p, c, f, columns)
    assert coverage.uncovered(p, c, f).count() == 0 and got.count() == 0 and coverage.with_places(got, f).count() == 0 and coverage.reverse_names(p).count() == 0
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
