import hashlib
import random

from evidentia.llm import substring


def brute(docs, n):
    first = {}
    words = {i: (t or "").encode().split() for i, t in docs}
    for i, w in words.items():
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone.update(range(k, k + n))
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out


def cases():
    r = random.Random(4)
    vocabulary = ["a", "the", "éa", "of", "x,", "zzz", " b", "q" * 50]
    line = " ".join(r.choice(vocabulary) for _ in range(40))
    docs = []
    for i in range(120):
        t = " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60)))
        if i % 3 == 0:
            t = t[: r.randint(0, 20)] + "\n\t" + line[r.randint(0, 10) :] + " " + t
        docs.append((i * 7 % 120, t))
    docs += [(500, None), (501, ""), (502, " \n "), (503, "the " * 300), (504, "the\n" * 200), (505, docs[3][1]), (506, "w" * 9000 + " " + line)]
    return docs


def test_against_brute_force(spark):
    docs = cases()
    want = brute(docs, 13)
    df = spark.createDataFrame([(i, t, i) for i, t in docs], "doc_id long, text string, n_words long").repartition(3)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring.remove_repeated(df).collect()}
    assert got == want
    assert sum(x[1] for x in want.values()) > 500


def test_edges(spark):
    text = " ".join(map(str, range(30)))
    df = spark.createDataFrame([(None, text), (4, text), (4, text), (9, text), (9, text + " x"), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in substring.remove_repeated(df).collect())
    assert got == [(-1, 0, 0), (-1, 30, 0), (4, 30, 0), (4, 30, 0), (9, 30, 30), (9, 31, 30)]
    assert substring.remove_repeated(df.limit(0)).count() == 0


def test_query_keeps_every_document(spark):
    rows = substring.op1_query(spark, "/root/testdata/sf0.001").collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = {i: (n, k, hashlib.sha256(t.encode()).hexdigest()) for i, (n, k, t) in brute(docs, 13).items()}
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows} == want
