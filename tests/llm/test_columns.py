from pyspark.sql import functions as F

from evidentia.llm import jaccard, mixing, packing, quality, substring, suffixes, urls


def test_columns_with_clashing_names_come_back(spark):
    row = (1, "a b c " * 30, "u", "v", 3, 4, 5, "w")
    df = spark.createDataFrame([row, (2, *row[1:])], "doc_id long, text string, _at string, _key string, _n int, _length int, _rank int, _doc string")
    for f in (substring.remove_repeated, suffixes.remove_repeated_bytes, jaccard.near_duplicates):
        got = f(df)
        assert got.columns[: len(df.columns)] == df.columns
        assert sorted(tuple(r)[:8] for r in got.collect()) == [row, (2, *row[1:])]
    assert {tuple(r)[:7] for r in packing.pack_documents(df).select("doc_id", "_at", "_key", "_n", "_length", "_rank", "_doc").collect()} == {(i, "u", "v", 3, 4, 5, "w") for i in (1, 2)}


def test_internal_names_of_other_operators_come_back_too(spark):
    df = spark.createDataFrame([(1, "one two three " * 30, "en", "http://a.b/c", 4, 5, 6, 7)], "doc_id long, text string, lang string, url string, _w int, _LEFT0 int, ids int, _found int")
    own = lambda out: [tuple(r) for r in out.select(df.columns).collect()]
    assert own(quality.quality_rules(df)) == own(df) and own(urls.judge_urls(df)) == own(df)
    assert [r["ids"] for r in packing.pack_documents(df).collect()] == [6]
    mixed = df.withColumnsRenamed({"ids": "_i"}).withColumns({"copies": F.lit(2).cast("long"), "posteriors": F.lit(1), "tokens": F.lit(1), "rate": F.lit(1.0), "miss": F.lit(1)})
    assert [r["_i"] for r in mixing.repeated(mixed).collect()] == [6, 6]


def test_an_id_that_is_labelled_twice_is_toxic_before_poor_before_good(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(4)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 1), (1, 1, 0), (1, 0, 0), (2, 1, 0), (2, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    assert {r["text"]: r["domain"] for r in mixing.labelled(docs, labels).collect()} == {"text 0": "toxic", "text 1": "poor", "text 2": "good"}
