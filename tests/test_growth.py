"""Steps whose shuffles, groups or broadcasts grew faster than their input: results against plain loops, and what a plan may not do."""

import math
import random
import re

import pytest
from evidentia.functions import records, text
from evidentia.operators import cascade, containment, coverage, dispatch, evidence, graph, grounding, hybrid, index, ranges, shared, stages
from evidentia.operators.plan import read_plan
from evidentia.plans import catalog
from pyspark.sql import functions as F


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [containment.MOST, 0])
def test_names_within_texts_by_both_ways(spark, monkeypatch, most):
    monkeypatch.setattr(containment, "MOST", most)
    rng = random.Random(4)
    texts = [(i, "".join(rng.choice("ab c") for _ in range(rng.randrange(0, 25)))) for i in range(60)] + [(60, None), (61, "abc abc abc"), (62, "abc abc abc")]
    names = ["a", "ab", "abc", " c", "abcabc", "abc abc", "abc abc abc", "", None, "zz", "a b c", "a"]
    got = containment.within(spark.createDataFrame(texts, "k int, t string"), "t", spark.createDataFrame([(n,) for n in names], "n string"), "n")
    want = sorted((k, t, n) for k, t in texts for n in set(names) if t and n and n in t)
    assert sorted(map(tuple, got.select("k", "t", "n").collect())) == want
    if most:
        assert "Exchange hash" not in plan(got)  # texts stay where they are read
    empty = containment.within(spark.createDataFrame(texts, "k int, t string"), "t", spark.createDataFrame([("",)], "n string"), "n")
    assert empty.columns == ["k", "t", "n"] and empty.count() == 0


@pytest.mark.parametrize("most", [containment.MOST, 0])
def test_sets_with_all_that_is_asked_for_by_both_ways(spark, monkeypatch, most):
    monkeypatch.setattr(containment, "MOST", most)
    rng = random.Random(8)
    sets = [(i, [rng.choice("abcdefg") for _ in range(rng.randrange(0, 6))]) for i in range(50)]
    asked = [(i, [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 4))], i % 3) for i in range(40)]
    got = containment.containing(spark.createDataFrame(sets, "s int, e array<string>"), "e", spark.createDataFrame(asked, "a int, w array<string>, x int"), "w")
    assert sorted((r["a"], r["s"], r["x"]) for r in got.collect()) == sorted((a, s, x) for a, w, x in asked for s, e in sets if w and set(w) <= set(e))
    if most:
        assert "Exchange hash" not in plan(got)


def test_citations_without_a_row_or_a_known_head_are_not_looked_up(spark):
    texts = ["[Orders, row 1]", "[Orders, row 9] [orders]", "[nothing at all] [orders, rows 1, 2]", "[the Orders list, row 2] [x, row 1]", "[]", None]
    known = spark.createDataFrame([("orders", 1), ("orders", 2)], "head string, row long")
    got = evidence.known_citations(spark.createDataFrame(list(enumerate(texts)), "i int, a string"), "i", "a", known)
    assert {(r["i"], r["citation"]): r["is_known"] for r in got.collect()} == {
        (0, "Orders, row 1"): True, (1, "Orders, row 9"): False, (1, "orders"): True, (2, "nothing at all"): False, (2, "orders, rows 1, 2"): True, (3, "the Orders list, row 2"): True, (3, "x, row 1"): False,
    }
    assert "isnotnull(row" in plan(got).lower()  # nulls don't go to the join


def test_calls_are_not_broadcast(spark):
    """Calls in compressed files looked small enough to be sent to every task, and to the driver first."""
    region = spark.createDataFrame([(1, "ASIA"), (2, "AFRICA")], "k int, name string")
    rows = cascade.as_rows({"1": (region, "k")})
    catalogue = spark.createDataFrame([(1, "1", "region", "Regions", None, None)], "place int, table_no string, slug string, title string, document string, appendix string")
    headers = spark.createDataFrame([("1", 0, "k"), ("1", 1, "name")], "table_no string, position int, column string")
    calls = spark.createDataFrame([(1, "region", [("name", "ASIA")]), (2, "1", [("name", "asia")]), (3, "1", [("name", None)]), (4, "reg", [("k", "7"), ("name", "ASIA")])], "call int, ref string, filters array<struct<name:string,value:string>>")
    got = cascade.lookups(calls, catalogue, headers, rows)
    assert {r["call"]: r["outcome"] for r in got.collect()} == {1: "found", 2: "look-alike", 3: "missing", 4: "missing"}
    assert "BroadcastHashJoin [call" not in plan(got)


def test_runs_are_not_broadcast_and_links_are_gone_through_by_the_fewer(spark):
    omissions = spark.createDataFrame([(r, r, "p", "c") for r in range(9)], "run int, place int, param string, clause string")
    places = spark.createDataFrame([(r, k, f"f{k}") for r in range(9) for k in range(r % 3 + 1)], "run int, code_order int, code string")
    links = spark.createDataFrame([("c", 9 - k, f"f{k}") for k in range(2)] + [("c", 1, "f7"), ("c", 20, "f0")], "clause string, link_order int, code string")
    read = spark.createDataFrame([(r, x) for r in range(9) for x in ("c", "f0", "f1", "f2")[: 5 - r % 2]], "run int, locator string")
    got = grounding.grounded_omissions(omissions, places, links, read)
    assert {r["run"]: r["code"] for r in got.collect()} == {r: "f0" if r % 3 == 0 else "f1" for r in range(9)}
    assert "BroadcastHashJoin [run" not in plan(got)


def test_numbers_in_ranges_without_their_pairs(spark):
    """Half a million values in each of 20,000 ranges are 10^10 pairs."""
    values = spark.range(500_000).selectExpr("cast(id as double) / 7 as v", "if(id % 3 = 0, null, 500000 - id) as m")
    table = spark.range(20_000).selectExpr("id as k", "-1.0 * id as low", "1e6 + id as high")
    got = ranges.summary(values, "v", "m", table, "low", "high").agg({"k": "count", "n": "min", "first": "max"}).first()
    assert sorted(got) == [1, 20_000, 500_000]


def test_numbers_in_ranges_against_every_pair(spark):
    rng = random.Random(9)
    number = lambda: rng.choice([rng.uniform(-5, 5), float(rng.randrange(-20, 20)), 0.0, -0.0, 1e300, float("inf"), None, float("nan")])
    values = [(number(), rng.choice([None, rng.randrange(100)])) for _ in range(300)]
    table = [(i, a, rng.choice([a, number(), (a or 0.0) + 2.0 ** rng.randrange(-3, 6)]), number()) for i in range(200) for a in [number()]]
    want, fine = {}, lambda x: x is not None and x == x
    for k, a, b, e in table:
        low, high = (a, b) if a is not None and b is not None else (e, e)
        held = [m for x, m in values if fine(x) and fine(low) and fine(high) and low <= x <= high]
        if held:
            want[k] = len(held), min((m for m in held if m is not None), default=None)
    v, t = spark.createDataFrame(values, "v double, m int"), spark.createDataFrame(table, "k int, a double, b double, e double")
    got = ranges.summary(v, "v", "m", t, "a", "b", "e")
    assert {r["k"]: (r["n"], r["first"]) for r in got.collect()} == want and len(want) > 100
    assert ranges.summary(v.limit(0), "v", "m", t, "a", "b", "e").count() == ranges.summary(v, "v", "m", t.limit(0), "a", "b", "e").count() == 0


def test_questions_meet_documents_in_blocks(spark):
    """The same, whatever the blocks, also where keys or requests are repeated."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(f"k{i % 50:02}", " ".join(rng.choices(words, k=rng.randrange(9))) or None, rng.choice(["A", "B", None])) for i in range(60)], "key string, text string, stage string")
    asked = spark.createDataFrame([(i, rng.choice([None, "", "w1 w2", "w3 w3 w4", "w9", "none"]), rng.choice([None, "A", "C"])) for i in range(90)], "req int, query string, stage string")
    told = lambda **sizes: sorted(map(tuple, dispatch.bm25_each(asked, docs, 3, **sizes).collect()))
    whole = told()
    assert told(block=7, most=2) == whole and len({r for r, *_ in whole}) > 20


def test_equal_requests_are_answered_once(spark):
    """4,000 equal requests of 4,000 names each are no 16,000,000 rows."""
    functions = spark.range(4000).selectExpr("id as key", "'name ' || id as full_name", "true as planning", "array('t') as tables", "'text' as text")
    requests = spark.range(4000).selectExpr("id as req", "null::string as query", "null::string as clause", "if(id % 2 = 0, 't', null) as table_no", "'name' as symbol")
    got = dispatch.search_code(requests, functions, spark.createDataFrame([], "clause string, table_no string, place int"), 3, 2)
    assert {tuple(r) for r in got.groupBy("way", "rank", "key", "total").count().collect()} == {(w, k + 1, k, 4000, 2000) for w in ("table", "symbol") for k in range(2)}
    first = dispatch._ranked(requests.select("req", "table_no"), functions.selectExpr("concat('t', key % 2) as table_no", "key"), ["table_no"], 2)
    assert "WindowGroupLimit" in plan(first)  # no task holds all names


def test_pairs_of_parameters_and_clauses_are_reduced_without_sorting(spark):
    rows = spark.createDataFrame([(i, f"линия печать{i % 3}", f"line_{i}") for i in range(9)], "place int, name string, ident string")
    clauses = spark.createDataFrame([("s", f"c{i}", 9 - i, f"линия печать{i % 3}", ["t"]) for i in range(9)], "stage string, clause string, place int, text string, tables array<string>")
    code = spark.createDataFrame([("s", 1, "nothing")], "stage string, place int, text string")
    got = coverage.uncovered(coverage.parameters(rows, "name", "ident", "place"), clauses, code)
    assert [(r["param"], r["clause"]) for r in got.orderBy("rank").collect()] == [(f"линия печать{i}", f"c{6 + i}") for i in range(3)]
    reduced = [x for x in plan(got).splitlines() if "partial_min" in x and "own_place" in x]
    assert reduced and not any("SortAggregate" in x for x in reduced)


@pytest.mark.parametrize("narrow", [graph.NARROW, 3])
def test_pairs_of_two_hops_are_not_shuffled(spark, monkeypatch, narrow):
    monkeypatch.setattr(graph, "NARROW", narrow)
    monkeypatch.setattr(graph, "SOURCES", 5)
    rng = random.Random(5)
    left = [(rng.choice([None, *range(25)]), rng.choice([None, *"abcdefgh"]), rng.choice([None, 1, 2, 3])) for _ in range(90)]
    right = [(rng.choice([None, *"abcdefghi"]), rng.choice([None, *range(30)])) for _ in range(110)]
    got = graph.two_hops(spark.createDataFrame(left, "s int, v string, o int"), spark.createDataFrame(right, "v string, t int"), "s", "v", "t", "o")
    edges, want = {}, {}
    for s, v, o in left:
        edges.setdefault((s, v), []).extend([] if o is None else [o])
    for (s, v), o in edges.items():  # an edge without an order comes first
        for w, t in right:
            if v is not None and v == w:
                want[s, t] = min((min(o, default=-1), v), want.get((s, t), (9, "")))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and {(s, t): v for s, t, v in rows} == {k: v for k, (_, v) in want.items()}
    if narrow > 3:
        assert "Aggregate" not in plan(got)  # each pair is told where it is made


def test_records_are_dealt_out_and_computed_once(spark):
    assert "RoundRobinPartitioning(4)" in plan(catalog.queries()["redact_nested"](spark, "/root/testdata/sf0.001"))
    given = spark.createDataFrame([(["sk-12345678 x", None] * 26,), ([],), (None,), (["y" * 801],)], "a array<string>")
    got = [r["a"] for r in given.select(records.clean(F.split(F.array_join("a", "|"), r"\|"), given.schema["a"].dataType).alias("a")).collect()]
    assert got == [["*** x"] * 26, [""], None, ["y" * 800 + "… (+1 симв.)"]]
    long = [r["a"] for r in given.select(records.clean(F.col("a"), given.schema["a"].dataType).alias("a")).collect()]
    assert long == [["*** x", None] * 25 + ["… ещё 2"], [], None, ["y" * 800 + "… (+1 симв.)"]]
    assert plan(given.select(records.clean(F.col("a"), given.schema["a"].dataType).alias("a"))).count("slice(") == 1


def test_equal_questions_for_a_stage_are_answered_once(spark, monkeypatch):
    counts, stored = {}, shared.stored

    def counted(df, name):
        out = stored(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(shared, "stored", counted)
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    kinds = [("Печать  чего", None, None, None), ("ТР-1 и ЛК2", None, None, None), ("пусто", None, "лк2", None), ("табл. 7", None, None, 9), (None, None, None, None), ("ТР-1", "экструзия", "ЛК2", None), ("ТР-1", "экструзия", "", 7)]
    rows = [(i, *kinds[i % 7]) for i in range(70)]
    got = stages.detect(
        table(rows, "k int, q string, n string, l string, no int"), "k", "q", "n", "l", "no", table([("ТР-1", "кольцевание")], "name string, stage string"), table([("ЛК2", "печать")], "code string, stage string"),
        table([(7, "экструзия")], "number int, stage string"), table([("Ширина", 7)], "title string, number int"), table([("краск", "печать")], "term string, stage string"),
    )
    want = [("печать", "named"), ("кольцевание", "document"), ("печать", "line"), ("экструзия", "table"), (None, "none"), ("экструзия", "named"), ("экструзия", "named")]
    assert sorted(map(tuple, got.collect())) == [(i, *want[i % 7]) for i in range(70)]
    assert counts["questions"] == counts["answers"] == 6


def test_indexes_are_built_of_rows_dealt_out(spark, monkeypatch):
    built = []
    for module in (index, hybrid):
        monkeypatch.setattr(module, "build", lambda df, *args, build=module.build, **kwargs: (built.append(plan(df)), build(df, *args, **kwargs)))
    for name in ("bm25_stored", "hybrid_stored"):
        built.clear()
        catalog.queries()[name](spark, "/root/testdata/sf0.001").collect()
        assert "RoundRobinPartitioning(4)" in built[0], name


def test_words_of_one_stem_are_one_posting(spark, tmp_path):
    df = spark.createDataFrame([(1, "линия линии линия-line"), (2, "линией линии"), (3, None)], "k long, t string")
    index.build(df, "k", "t", f"{tmp_path}/i")
    stem = "лин"
    got = {(r["key"], r["term"]): r["tf"] for r in index.postings(spark, f"{tmp_path}/i").collect()}
    assert len(got) == index.postings(spark, f"{tmp_path}/i").count() and sum(got.values()) == 7
    assert sum(n for (k, t), n in got.items() if k == 2 and t.startswith(stem)) == 2
    assert {r["key"]: r["dl"] for r in spark.read.parquet(f"{tmp_path}/i/sizes").collect()} == {1: 5, 2: 2, 3: 0}


def test_neighbours_in_a_plan_are_not_joined_to_their_batches(spark):
    batches = [(f"b{i}", f"O{i % 4}", [None, "L1", "L2"][i % 3], [None, "A", "B", "B"][i % 4], i, [None, 5.0, float("nan"), 1.0, 2.0][i % 5]) for i in range(40)]
    requests = [(i, f"o{i % 5}" if i % 3 else None, "l2" if i % 2 else None, "b" if i % 7 else None) for i in range(20)]
    got = read_plan(spark.createDataFrame(requests, "req int, order_no string, line string, stage string"), spark.createDataFrame(batches, "batch string, order_no string, line string, stage string, seq int, started double"))
    joins = plan(got).replace("\n", " ")
    assert "batch#" not in "".join(x.split("]")[0] for x in joins.split("Join [")[1:])
    queues = {}
    for b, _, line, stage, _, at in batches:
        if line and stage and at is not None and at == at:
            queues.setdefault((line, stage), []).append((at, b))
    near = {b: (q[i - 1][1] if i else None, q[i + 1][1] if i + 1 < len(q) else None, i + 1, len(q)) for q in map(sorted, queues.values()) for i, (_, b) in enumerate(q)}
    told = [r for r in got.collect() if r["way"] == "order"]
    assert {(r["batch"], (r["previous"], r["next"], r["position"], r["queue_length"])) for r in told} == {(b, near.get(b, (None,) * 4)) for b in {r["batch"] for r in told}}
    assert {r["req"] for r in told} and all(sum(x["req"] == r["req"] for x in told) == 10 for r in told)


def test_cited_locators_are_read_and_parsed_once(spark):
    """Each further step of the look-up parsed all that is cited again."""
    read = spark.sparkContext.accumulator(0)
    rows = [(r, x) for r in range(20) for x in ("rules, row 1", "rules, row 9", "Rules,  rows 1, 2", "the rules, row 2", "rules", "nowhere, row 1", "arrow, row 1")]
    cited = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(lambda x: read.add(1) or x), "run int, locator string")
    known = spark.createDataFrame([(r, "rules", k) for r in range(19) for k in (1, 2)], "run int, head string, row long")
    got = {(r["run"], r["locator"]): r["is_known"] for r in evidence.known_locators(cited, known).collect()}
    fine = {"rules, row 1", "Rules,  rows 1, 2", "the rules, row 2", "rules"}
    assert got == {(r, x): r < 19 and x in fine for r, x in rows}
    assert read.value == len(rows)


def test_parts_of_plain_locators_are_those_of_all_others(spark):
    heads = ["rules", "the rules", "план печати", "arrow", "rows", "a row", "Rules", "a  b", "rules ", "rules,", "a row 3", "", "x1"]
    texts = [h + t for h in heads for t in (", row 7", ", rows 7", ", row 007", ",row 7", " row 7", ", row 7\n", ", row 7, 8", ", row", ", row 123456789012345678")]
    parts = [text.locator_head(F.col("c")), text.locator_rows(F.col("c"))]
    plain = spark.createDataFrame([(t,) for t in texts], "c string").select("c", *parts).collect()
    general = [F.expr(r"trim(regexp_replace(lower(regexp_extract(c, '^(.*?)(?:,?\\s*rows?\\s+\\d.*)?$', 1)), '\\s+', ' '))"), F.expr(r"transform(regexp_extract_all(regexp_extract(c, 'rows?\\s+(\\d.*)$', 1), '\\d+', 0), x -> cast(x as long))")]
    assert sorted(map(tuple, plain)) == sorted(map(tuple, spark.createDataFrame([(t,) for t in texts], "c string").select("c", *general).collect()))


@pytest.mark.parametrize("step", [1, 2, 100])
def test_parameters_are_compared_until_each_stage_has_its_first(spark, monkeypatch, step):
    """Every pair of a parameter and a clause was made, and its terms compared, for the first few of each stage."""
    monkeypatch.setattr(coverage._first, "__defaults__", (step,))
    made, containing = [], coverage.containing
    monkeypatch.setattr(coverage, "containing", lambda sets, elements, asked, wanted: made.append(asked.count()) or containing(sets, elements, asked, wanted))
    rows = [(i, f"линия печать{i}", f"line_{i}") for i in range(40)]
    clauses = [(s, f"{s}{i}", i, f"линия печать{i} печать{i + 1} и линии", ["t"]) for i in range(39) for s in ("a", "b", None) if s != "b" or i % 8 == 0]
    code = [("a", 1, "x line_3 y"), ("a", 2, None), ("b", 1, "LINE_1 line_8"), ("c", 1, "line_9")]
    params = coverage.parameters(spark.createDataFrame(rows, "place int, name string, ident string"), "name", "ident", "place")
    got = coverage.uncovered(params, spark.createDataFrame(clauses, "stage string, clause string, place int, text string, tables array<string>"), spark.createDataFrame(code, "stage string, place int, text string"), most=4)
    want = {}
    for s in ("a", "b", None):
        for i in range(40):
            own = [c for c in clauses if c[0] == s and f"печать{i}" in c[3].split()]
            if own and not any(t == s and f"line{i}" in (x or "").lower().replace("_", "").replace(" ", "") for t, _, x in code):
                want.setdefault(s, []).append((f"линия печать{i}", own[0][1]))
    assert {(r["stage"], r["rank"]): (r["param"], r["clause"]) for r in got.collect()} == {(s, k + 1): x for s, v in want.items() for k, x in enumerate(v[:4])}
    assert made[-1] <= 12  # whole terms are compared for those that are given
    if step < 100:
        assert made[0] == step


def test_words_lose_the_longest_ending_twice(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("аеиоуыэюямвйлнтсьхгштbx-", k=rng.randrange(1, 11))) + rng.choice(["", *text.SUFFIXES]) for _ in range(3000)] + ["a\nями", "ями", "кольцами\n", "столовая"]

    def once(w):
        return next((w[: -len(e)] for e in sorted(text.SUFFIXES, key=len, reverse=True) if w.endswith(e) and len(w) >= len(e) + 3), w)

    plain = [w for w in words if "\n" not in w]
    got = spark.createDataFrame([(w,) for w in plain], "w string").select("w", text.stem(F.col("w")).alias("s")).collect()
    assert all(r["s"] == once(once(r["w"])) for r in got)


def test_documents_are_split_once_and_the_best_of_many_are_those_of_plain_loops(spark):
    """The texts were split twice, each word of them was stemmed, and all scores of a block were rounded and sorted."""
    read, rng = spark.sparkContext.accumulator(0), random.Random(6)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(words, [40 - j for j in range(40)], k=rng.randrange(30))), rng.choice("AB")) for i in range(1500)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(lambda x: read.add(1) or x), "key int, text string, stage string")
    requests = [(i, " ".join(rng.choices(words, k=3)), rng.choice([None, "A", "C"])) for i in range(60)]
    got = {(r["req"], r["rank"]): (r["key"], round(r["score"], 6)) for r in dispatch.bm25_each(spark.createDataFrame(requests, "req int, query string, stage string"), docs, 4).collect()}
    size, split = sum(len(t.split()) for _, t, _ in rows) / len(rows), {k: t.split() for k, t, _ in rows}
    df = {w: sum(w in t for t in split.values()) for w in words}
    want = {}
    for req, query, stage in requests:
        scores = []
        for k, _, own in rows:
            tf = [(w, split[k].count(w)) for w in sorted(set(query.split())) if w in split[k]]
            if tf and stage in (None, own):
                scores.append((-round(sum(math.log(1 + (1500 - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * len(split[k]) / size)) for w, n in tf), 12), k))
        want |= {(req, x + 1): (k, round(-s, 6)) for x, (s, k) in enumerate(sorted(scores)[:4])}
    assert got == want and len(want) > 150
    assert read.value == len(rows)


def test_an_array_of_which_each_element_is_a_row_is_made_once(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "k int, t string")
    got = containment.each(df, F.array_distinct(F.split("t", " ")), "e").select("k", "e")
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (1, "b"), (2, "")]
    assert plan(got).split("== Initial Plan ==")[0].count("array_distinct") == 1


def test_pairs_of_two_hops_meet_by_marks_before_their_lists(spark):
    edges = spark.createDataFrame([(s, v) for s in range(30) for v in range(s % 7, s % 7 + 4)], "s int, v int")
    got = graph.two_hops(edges.withColumn("o", F.col("v")), edges.select("v", F.col("s").alias("t")), "s", "v", "t", "o")
    assert sorted(map(tuple, got.collect())) == sorted((s, t, max(s % 7, t % 7)) for s in range(30) for t in range(30) if abs(s % 7 - t % 7) < 4)
    assert re.search(r"&.*OR NOT arrays_overlap", plan(got))


def test_texts_of_a_plan_are_stored_as_keys_only(spark, monkeypatch):
    kept, stored = [], shared.stored
    monkeypatch.setattr(shared, "stored", lambda df, name: kept.append(df.columns) or stored(df, name))
    batches = spark.createDataFrame([("b1", "O 1", "L1", "A", 1, 1.0), ("b2", "o  1", "P", "A", 2, None)], "batch string, order_no string, line string, stage string, seq int, started double")
    got = read_plan(spark.createDataFrame([(1, "O 1", None, "a")], "req int, order_no string, line string, stage string"), batches, ["P"])
    assert [(r["batch"], r["asked_stage"], r["placed"], r["position"]) for r in got.orderBy("rank").collect()] == [("b1", True, True, 1), ("b2", True, True, None)]
    assert kept and not any({"order_no", "line", "stage"} & set(c) for c in kept)
