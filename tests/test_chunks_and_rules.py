"""Chunks, sentences, rules and the stored index on small fixtures: nulls, empty texts, ties, empty tables."""

from evidentia.operators import chunks, index, retrieval, rules, sentences
from pyspark.sql import functions as F


def test_sentences_end_outside_of_brackets_only():
    cases = {
        None: [], "": [], "  ": [], "One. Two": ["One.", "Two"], "One. two": ["One. two"], "See [a. B [c. D]. E]. Next! ": ["See [a. B [c. D]. E].", "Next!"],
        "Open [a. B. C": ["Open [a. B. C"], "x] y. Z": ["x] y.", "Z"], "v1.2. Да?  Нет": ["v1.2.", "Да?", "Нет"], "Wait... What": ["Wait...", "What"],
    }
    assert {t: sentences.parts(t) for t in cases} == cases


def test_strike_drops_what_holds_a_bad_locator(spark):
    answers = spark.createDataFrame([(1, "A [x]. B [y]. C"), (2, None), (3, "Only [z].")], "k int, t string")
    bad = spark.createDataFrame([(1, "y"), (1, "y"), (3, "z"), (4, "A")], "k int, l string")
    assert sorted(map(tuple, sentences.strike(answers, "k", "t", bad, "l").collect())) == [(1, "A [x]. C", ["B [y]."]), (2, "", []), (3, "", ["Only [z]."])]


def test_clauses_stand_under_the_last_section(spark):
    rows = [(1, 1, "1.1 before any"), (1, 2, "2. Уборка цеха"), (1, 3, "2.1.  body one "), (1, 4, None), (1, 5, "plain"), (1, 6, "2.2 more"), (2, 1, "3. Порядок"), (2, 2, "3.1\tx")]
    df = spark.createDataFrame(rows, "d int, p int, t string").repartition(3)
    got = sorted(map(tuple, chunks.clauses(df, "d", ["p"], "t").collect()))
    assert got == [(1, "1.1", "before any", "0. Без раздела", True), (1, "2.1", "body one", "2. Уборка цеха", False), (1, "2.2", "more", "2. Уборка цеха", False), (2, "3.1", "x", "3. Порядок", True)]
    assert chunks.clauses(df.limit(0), "d", ["p"], "t").count() == 0


def test_tables_are_numbers_in_order_each_once(spark):
    texts = [("приложения 2 и 5, табл. 10; Таблица 9 и табл.10", ["9", "10", "11"]), (None, []), ("", []), ("таблиц много", [])]
    got = spark.createDataFrame([t for t, _ in texts], "string").select("value", chunks.referenced_tables(F.col("value"), {"2": "11"}).alias("r")).collect()
    assert {r["value"]: r["r"] for r in got} == dict(texts)


def test_findings_need_a_claim_and_facts(spark):
    kind = "f array<struct<claim:string,severity:string,checked_facts:array<int>>>"
    df = spark.createDataFrame([([(" a ", "minor", [1]), ("b", None, [2]), ("", "minor", [3]), ("c", "critical", [])],), ([],)], kind)
    got = [[tuple(f) for f in r["x"]] for r in df.select(rules.findings(F.col("f")).alias("x")).collect()]
    assert got == [[("a", "minor", [1]), ("b", "critical", [2])], []]


def test_a_stored_index_scores_as_the_texts_do(spark):
    rows = [(1, "the house and the dog"), (2, "house"), (3, None), (4, ""), (5, "дома и дом the")]
    df, path = spark.createDataFrame(rows, "k int, t string"), index.folder(spark, "index")
    index.build(df, "k", "t", path)
    got = [(r["key"], round(r["score"], 9)) for r in index.search(spark, path, "the House", 10).collect()]
    want = retrieval.bm25(df, "k", "t", spark.createDataFrame([("the",), ("house",)], "term string"), 10).collect()
    assert got == [(r["k"], round(r["score"], 9)) for r in want] and len(got) == 3
    assert index.stats(spark, path).first().asDict() == {"documents": 5, "avgdl": 2.0, "terms": 6, "postings": 8}
    assert index.search(spark, path, "", 10).count() == 0
