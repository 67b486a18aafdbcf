from evidentia.llm import langid


def test_held_out_accuracy_and_blank_texts(spark):
    df = langid.op2_query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = df.where("held_out and lang_pred <> 'und'").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows) > 0


def test_edges(spark):
    model = langid.fit(["the house and the garden of the king"] * 40 + ["el perro de la casa y el gato"] * 40, ["en"] * 40 + ["es"] * 40)
    rows = [(None, 1.0), ("", 1.0), ("123 !!", 1.0), ("the king and the house", 1.0), ("x" * 300_000, 1.0)]
    got = langid.identify(spark.createDataFrame(rows, "text string, score double"), model).collect()
    assert [r["lang_pred"] for r in got[:4]] == ["und", "und", "und", "en"]
    assert all(r["rejected"] for r in got[:3]) and all(0 <= r["score"] <= 1 for r in got)
    assert langid.identify(spark.createDataFrame([], "text string"), model).count() == 0
    assert [r["lang_pred"] for r in langid.identify(spark.createDataFrame([("abc",)], "text string"), None).collect()] == ["und"]
