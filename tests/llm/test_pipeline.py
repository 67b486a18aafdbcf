import corpus_pipeline
from evidentia.llm import common

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, SF), "stage")
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
        sizes.append(docs.count())
    assert sizes[1] >= 0.97 * sizes[0] and sizes[1] > sizes[2] >= sizes[3] > 0.5 * sizes[0] and sizes[4] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


def test_one_row_of_each_component_stays(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(7, long), (7, long), (7, long + " end"), (9, long), (None, long), (None, "other words that are copies of each other"), (None, "other words that are copies of each other"), (7, "a text of the same id that links with nothing else"), (3, ""), (3, ""), (4, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [(r["doc_id"], r["text"].removesuffix(" end")) for r in corpus_pipeline.near_duplicates(spark, df, SF).collect()]
    assert sorted(got, key=repr) == sorted([(7, long), (None, rows[5][1]), (7, rows[7][1]), (3, ""), (4, "")], key=repr)
