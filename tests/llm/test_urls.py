from evidentia.llm import urls

URLS = [None, "", "nothing", "http://example.org", "HTTP://A.Example.ORG/es/1?q", "https://example.org/en/17#x", "https://example.org/en/2", "x://site.com/fr/", "x://site.com/de", "x://site.com/de/a", "x://notexample.org?/es/", "x://b.net/es/", "a://org/x", "a://xcom/fr/", "x://a.com/fr/b\nc"]
WANT = [None, None, None, None, "example.org/es/", "example.org/en/1", "org/", "com/fr/", None, "com/de/", None, None, "org/", None, "com/fr/"]


def frame(spark):
    return spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id int, url string, rule string")


def test_longest_rule_wins(spark):
    got = urls.judge_urls(frame(spark)).orderBy("page_id").collect()
    assert [r["rule"] for r in got] == WANT
    assert [r["verdict"] for r in got] == [dict(urls.RULES).get(w, "allow") for w in WANT]
    assert (got[4]["host"], got[4]["path"]) == ("a.example.org", "/es/1")


def test_large_lists_are_joined(spark, monkeypatch):
    want = urls.judge_urls(frame(spark)).orderBy("page_id").collect()
    monkeypatch.setattr(urls, "TRIE_BYTES", 1)
    assert urls.judge_urls(frame(spark)).orderBy("page_id").collect() == want
    assert urls.judge_urls(frame(spark).limit(0)).count() == 0


def test_ties_and_many_prefixes_of_one_segment(spark, monkeypatch):
    rules = [("com/aaaa", "allow"), ("x.com/aa", "block"), ("y.com/b", "allow"), ("com/bbb", "allow"), ("net/", "allow"), ("net/", "block"), *((f"m.org/p{i}", "block") for i in range(500))]
    df = spark.createDataFrame([(u,) for u in ("h://x.com/aaaa", "h://z.y.com/bbb", "h://net/q", "h://m.org/p499x", "h://m.org/q")], "url string")
    want = [("x.com/aa", "block"), ("y.com/b", "allow"), ("net/", "block"), ("m.org/p499", "block"), (None, "allow")]
    assert [(r["rule"], r["verdict"]) for r in urls.judge_urls(df.coalesce(1), rules).collect()] == want
    monkeypatch.setattr(urls, "TRIE_BYTES", 1)
    assert sorted((r["rule"] or "", r["verdict"]) for r in urls.judge_urls(df, rules).collect()) == sorted((a or "", b) for a, b in want)
