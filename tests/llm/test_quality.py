import math
import random
import re

from evidentia.llm import quality
from pyspark.sql import functions as F


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, places = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            places.update(j for i in at for j in (i, i + 1, i + 2))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(places)


def test_counts_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = quality.op3_query(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["kept"] and r["base_failed"])


def test_edges_and_junk(spark):
    r = random.Random(2)
    prose = " ".join(r.choice(["the", "of", "and", "to", "in", "is", "that", "town", "village", "market"]) + f" {r.choice('aeiou')}{r.choice('rstlnm')}{r.choice('aeiou')}{i % 7 * 'n'}" for i in range(150))
    junk = " ".join(f"{{#{i}|%{i * 7}&<{i}>}}==" for i in range(200))
    odd = [None, "", "a b c a b c a b c", "x\n\nx\n x\nx", "é É ́ #"]
    df = spark.createDataFrame([(i, t, "en", "k") for i, t in enumerate([prose, junk, *odd])], "doc_id int, text string, lang string, kept string")
    refs = spark.createDataFrame([(99, prose, "en", "k")] * 9, df.schema)
    rows = {r["doc_id"]: r for r in quality.quality_rules(df.where("doc_id <> 1").union(refs).union(df.where("doc_id = 1").withColumn("lang", F.lit(None).cast("string")))).collect()}
    assert rows[0]["kept"] and not rows[1]["kept"] and not rows[1]["base_failed"]
    for i, t in enumerate(odd):
        r = rows[i + 2]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(t) and r["base_failed"]
    assert quality.quality_rules(df.limit(0)).count() == 0


def test_distance(spark):
    got = spark.range(1).select(quality.divergence(F.array(F.lit(3.0), F.lit(1.0)), [0.25, 0.75]), quality.divergence(F.array(F.lit(1.0), F.lit(0.0)), [0.0, 1.0])).first()
    kl = lambda p, m: sum(a * math.log2(a / b) for a, b in zip(p, m, strict=True) if a)
    assert abs(got[0] - math.sqrt((kl([0.75, 0.25], [0.5, 0.5]) + kl([0.25, 0.75], [0.5, 0.5])) / 2)) < 1e-12 and abs(got[1] - 1) < 1e-12


def test_limits_come_from_each_languages_documents(spark):
    r = random.Random(4)
    letters = lambda a, b: "".join(r.choice("etaoinshrdlucmfwgp") for _ in range(r.randint(a, b)))
    prose = lambda lang, n: " ".join(r.choice(quality.COMMON[lang]) if r.random() < 0.3 else letters(3, 9) for _ in range(n)).capitalize() + "."
    docs = [(f"{lang}{i}", prose(lang, r.randint(60, 400)), lang) for lang in quality.COMMON for i in range(60)]
    clean = [(f"clean {lang}", prose(lang, 250), None) for lang in quality.COMMON]
    symbols = lambda x: "".join(c if r.random() < 0.7 else r.choice("#*$%&|<>") for c in x)
    bad = [("no words", " ".join(letters(3, 9) for _ in range(250)), "en"), ("list", "\n".join(letters(4, 9) for _ in range(60)), "de"), ("symbols", symbols(prose("en", 250)), "en"), ("shuffled", "".join(r.sample(prose("fr", 250), 1200)), "fr")]
    df = spark.createDataFrame([*docs, *clean, *bad], "doc_id string, text string, lang string")
    kept = {x["doc_id"]: x["kept"] for x in quality.quality_rules(df).collect()}
    assert [kept[x[0]] for x in clean] == [True] * 4 and [kept[x[0]] for x in bad] == [False] * 4
    assert sum(kept[x[0]] for x in docs) >= 0.97 * len(docs)
