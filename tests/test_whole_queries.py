"""Queries over all rows against brute force on small fixtures."""

import math
import re
import zlib
from collections import Counter

import pytest
from evidentia.operators import evidence, graph, lookup, retrieval
from evidentia.plans import catalog


def test_code_for_clause_of_all_orders(spark, tmp_path):
    rows = [(o, o * s % 11, s) for o in (1, 2, 49, 50, 51, 52, 9000) for s in range(1, 5)] + [(51, 3, 2), (51, 3, 2), (9000, 8, None)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {}
    for o, _, s in rows:
        for _, p, t in rows:
            if s is not None and s == t:
                want[o, p] = min(s, want.get((o, p), s))
    got = catalog.without_sql()["code_for_clause"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r["l_orderkey"], r["l_partkey"]): r["l_suppkey"] for r in got} == want


def test_two_hops_take_the_first_table_in_order(spark):
    left = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (1, "b", 3), (2, "a", 1)], "s int, v string, o int")
    right = spark.createDataFrame([("a", 5), ("b", 5), ("b", 5), ("a", 6)], "v string, t int")
    assert sorted(map(tuple, graph.two_hops(left, right, "s", "v", "t", "o").collect())) == [(1, 5, "b"), (1, 6, "a"), (2, 5, "a"), (2, 6, "a")]


def test_gaps_are_told_apart_by_eighty_characters(spark, tmp_path):
    texts = ["The same first words, one end", "The same first words, other end", "No  source for Line 4", "no source for line 4 ", "x" * 80 + "a", "X" * 80 + "b", None]
    spark.createDataFrame([(t,) for t in texts], "text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["gap"]: r["n"] for r in catalog.without_sql()["gap_repeats_all"](spark, str(tmp_path)).collect()}
    assert got == {"no source for line 4": 2, "x" * 80: 2}


def test_hashed_ngrams_are_those_of_brute_force(spark):
    texts = {1: "Flexo-4  line", 2: "ab", 3: "", 4: None, 5: "ёж и Ёж"}
    got = {}
    for r in retrieval.hashed_ngrams(spark.createDataFrame(list(texts.items()), "k int, t string"), "k", "t", 64).collect():
        got.setdefault(r["k"], {})[r["place"]] = round(r["weight"], 9)
    want = {}
    for k, t in texts.items():
        low = (t or "").lower()
        flat = re.sub(r"\s+", " ", low)
        found = re.findall(r"[^\W_]+(?:[-.][^\W_]+)*", low) + [flat[i : i + n] for n in (3, 4, 5) for i in range(len(flat) - n + 1)]
        counts = Counter(zlib.crc32(f.encode()) % 64 for f in found)
        norm = math.sqrt(sum(math.log1p(c) ** 2 for c in counts.values()))
        if counts:
            want[k] = {p: round(math.log1p(c) / norm, 9) for p, c in counts.items()}
    assert got == want


def test_a_lookup_needs_an_order(spark):
    with pytest.raises(ValueError):
        lookup.lookup(spark.range(3), {"id": 1})


def test_coverage_of_runs_that_saw_nothing(spark):
    seen = spark.createDataFrame([(1, "a"), (1, "b")], "run int, source string")
    got = evidence.coverage(seen, "run", "source", ["b", "a"], spark.createDataFrame([(1,), (2,)], "run int")).collect()
    assert sorted(map(tuple, got)) == [(1, ""), (2, "a,b")]


def test_known_citations(spark):
    known = spark.createDataFrame([("plan of line 4", 1), ("plan of line 4", 2), ("notes", None)], "head string, row long")
    texts = ["[Plan of line 4, rows 1, 2] [plan of line 4] [plan of line 4, row 3] [notes, row 1] [  ] [Notes ]", "[line 4, row 2] [nothing here]"]
    got = evidence.known_citations(spark.createDataFrame(list(enumerate(texts)), "i int, a string"), "i", "a", known).collect()
    assert {(r["i"], r["citation"]): r["is_known"] for r in got} == {
        (0, "Plan of line 4, rows 1, 2"): True, (0, "plan of line 4"): True, (0, "plan of line 4, row 3"): False, (0, "notes, row 1"): False, (0, "Notes"): True,
        (1, "line 4, row 2"): True, (1, "nothing here"): False,
    }


def test_cosine_leaves_other_dimensions_out_and_refuses_mixed_queries(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0]), (4, None), (5, [])], "i int, v array<double>")
    got = retrieval.cosine_topk_each(df, df.where("i < 3"), "i", "v", 5).collect()
    assert sorted((r["query"], r["i"], r["score"]) for r in got) == [(1, 1, 1.0), (1, 2, 0.0), (2, 1, 0.0), (2, 2, 1.0)]
    assert retrieval.cosine_topk_each(df, df.where("i = 4"), "i", "v", 5).count() == 0
    with pytest.raises(ValueError, match="between 1 and 2"):
        retrieval.cosine_topk_each(df, df.where("i in (1, 3)"), "i", "v", 5)
