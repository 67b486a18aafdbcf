"""Log lines, profiles, ranges, runs in order and nested records against plain loops."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from evidentia.functions import records
from evidentia.operators import ranges, sequences
from evidentia.sources import logs, profile


def test_line_numbers_over_many_splits_are_those_of_a_whole_read(spark, tmp_path):
    rng = random.Random(2)
    files = {}
    for name, n in (("a.log", 4000), ("b.log", 1), ("c.log", 0), ("d.log", 900)):
        files[name] = [f"{i} INFO  {rng.choice(['СНЯТ ПО НСИ', 'ПОСТАВЛЕН', 'снят'])} Z-{rng.randrange(30)} {'x' * rng.randrange(60)}" for i in range(n)]
        (tmp_path / name).write_bytes(b"".join(x.encode() + rng.choice([b"\n", b"\r\n"]) for x in files[name]))
    (tmp_path / "e.log").write_bytes(b"ok\nbad \xff\xfe Z-7 INFO \xd0\x90\xd0\x91\n\nno end")
    files["e.log"] = ["ok", "bad �� Z-7 INFO АБ", "", "no end"]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        every = logs.lines(spark, str(tmp_path))
        assert every.where("file like '%a.log'").select("split").distinct().count() > 20
        got = {}
        for r in logs.numbered(every).collect():
            got.setdefault(r["file"].rsplit("/", 1)[1], {})[r["line_no"]] = r["line"]
        assert got == {f: dict(enumerate(own, 1)) for f, own in files.items() if own}
        found = logs.search(spark, str(tmp_path), [" z-7 ", None, "info"], 12)
        rows = found.collect()
        for f, own in files.items():
            hits = [(i, x) for i, x in enumerate(own, 1) if "z-7" in x.lower() and "info" in x.lower()][:12]
            assert sorted((r["line_no"], r["line"], r["locator"]) for r in rows if r["file"].endswith(f)) == [(i, x.strip(), f"{f}, line {i}") for i, x in hits]
            events = sorted({m[1] for _, x in hits if (m := re.search(r"INFO\s+([А-ЯЁ]+(?:\s+[А-ЯЁ]+)*)", x))})
            assert [r["events"] for r in logs.events(found).collect() if r["file"].endswith(f)] == ([events] if hits else [])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with pytest.raises(ValueError, match="pattern"):
        logs.search(spark, str(tmp_path), ["", None])


def test_profile_of_any_schema(spark):
    a = spark.createDataFrame([(1, "1,5", "x", None, [1]), (2, " 7 ", "3", None, None), (None, None, None, None, [])], "Key int, `Min block` string, name string, none string, list array<int>")
    b = spark.createDataFrame([], "`key` double, other boolean")
    p = profile.columns({"12": a, "7": b})
    assert sorted(map(tuple, p.collect())) == [
        ("12", 0, "Key", "number", 2, 1.0, 2.0), ("12", 1, "Min block", "number", 2, 1.5, 7.0), ("12", 2, "name", "text", 2, None, None), ("12", 3, "none", "empty", 0, None, None), ("12", 4, "list", "text", 2, None, None),
        ("7", 0, "key", "empty", 0, None, None), ("7", 1, "other", "empty", 0, None, None),
    ]
    assert {tuple(r) for r in profile.header_terms(p).where("columns > 1").collect()} == {("key", 2, 2)}
    assert sorted(map(tuple, profile.tables_with(p, " BLOCK").collect())) == [("12", "Min block")] and profile.tables_with(p, "").count() == 0
    assert ("key", "12", True) in {tuple(r) for r in profile.named_columns(p).collect()}


def test_ranges_against_every_pair(spark):
    rng = random.Random(8)
    number = lambda: rng.choice([rng.uniform(-5, 5), rng.uniform(-1e6, 1e6), float(rng.randrange(-20, 20)), 0.0, -0.0, 1e300, None, float("nan")])
    values = [(i, number()) for i in range(300)]
    table = [(i, a, rng.choice([a, number(), (a or 0.0) + 2.0 ** rng.randrange(-30, 30)]), number()) for i in range(200) for a in [number()]]
    v, t = spark.createDataFrame(values, "i int, v double"), spark.createDataFrame(table, "k int, `From` double, upto double, one double")
    fine = lambda x: x is not None and x == x
    expected = set()
    for i, x in values:
        for k, a, b, e in table:
            low, high = (a, b) if a is not None and b is not None else (e, e)
            if fine(x) and fine(low) and fine(high) and low <= x <= high:
                expected.add((i, k))
    got = ranges.in_ranges(v, "v", t, "from", "UPTO", "one")
    assert sorted(tuple(r) for r in got.select("i", "k").collect()) == sorted(expected) and len(expected) > 500
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "CartesianProduct" not in got._jdf.queryExecution().toString()
    assert {r["k"] for r in ranges.in_ranges(v, "v", t, "no", "upto", "one").collect()} <= {k for k, *_, e in table if fine(e)}
    with pytest.raises(ValueError, match="no range and no exact column among k, From"):
        ranges.in_ranges(v, "v", t, "from", "no", "nothing")
    assert ranges.in_ranges(v, "v", t.limit(0), "from", "upto").count() == 0


def test_a_gap_named_a_third_time_ends_a_run(spark):
    rng = random.Random(5)
    rows = [(run, n, rng.choice([True, False, False, None]), [rng.choice(["Нет  НОРМЫ", "нет нормы", "b" * 90 + str(rng.randrange(3)), "c", None]) for _ in range(rng.randrange(4))]) for run in range(60) for n in range(rng.randrange(7))]
    key = lambda g: " ".join(g.lower().split())[:80]
    expected = {}
    for run in range(60):
        seen = []
        for _, n, enough, gaps in sorted(r for r in rows if r[0] == run):
            stuck = [g for g in gaps if g is not None and seen.count(key(g)) >= 2]
            if stuck and not enough:
                expected[run] = (n, stuck[0])
                break
            seen += [key(g) for g in gaps if g is not None]
    rounds = spark.createDataFrame(rows, "run int, round int, enough boolean, gaps array<string>")
    stops = sequences.gap_stops(rounds)
    assert {r["run"]: (r["round"], r["gap"]) for r in stops.collect()} == expected and len(expected) > 10
    kept = {(r["run"], r["round"]): r["limited_by"] for r in sequences.until_stop(rounds, stops).collect()}
    assert kept == {(r, n): "gap_repeated" if r in expected and n == expected[r][0] else None for r, n, *_ in rows if r not in expected or n <= expected[r][0]}


def test_islands_of_failures_over_buckets(spark):
    rng, start = random.Random(7), dt.datetime(2024, 1, 1)
    rows = []
    for p, share in (("a", 0.5), ("b", 0.97), ("c", 1.0), ("d", 0.1)):
        rows += [(p, start + dt.timedelta(minutes=rng.randrange(3000)), i, rng.random() < share) for i in range(300)]
    rows += [("a", None, 1, True), ("b", start, 999, None)]
    expected = []
    for p in "abcd":
        own, run = sorted((t, i, f) for q, t, i, f in rows if q == p and t), []
        for t, _, f in [*own, (None, 0, False)]:
            if f:
                run.append(t)
            else:
                if len(run) >= 3:
                    expected.append((p, run[0], run[-1], len(run), run[-1] + dt.timedelta(seconds=60)))
                run = []
    df = spark.createDataFrame(rows, "provider string, ts timestamp, call int, failed boolean")
    for bucket in ("hour", "minute", "year"):
        assert sorted(tuple(r) for r in sequences.failure_islands(df, bucket=bucket).collect()) == sorted(expected)
    assert sequences.failure_islands(df.limit(0)).count() == 0


def test_secrets_at_any_depth(spark):
    kind = "note string, apiKey string, tokens_in int, inner struct<Authorization: struct<a: int>, list: array<struct<password: int, text: string>>>, extra map<string, string>, more map<string, array<string>>, words array<string>, n array<int>"
    row = ("a sk-12345678 b Bearer abc.d, " + "x" * 900, "k", 5, ((1,), [(3, "Bearer z"), None]), {"Secret": "s", "token_count": "7", "x": None, "said": "bearer y sk-1"}, {"my_token": ["a"], "ok": ["sk-abcdefgh"]}, ["w"] * 52, list(range(60)))
    df = spark.createDataFrame([(row,), (None,)], f"r struct<{kind.replace('note string', 'note: string').replace('apiKey string', 'apiKey: string').replace('tokens_in int', 'tokens_in: int').replace('inner struct', 'inner: struct').replace('extra map', 'extra: map').replace('more map', 'more: map').replace('words array', 'words: array').replace('n array<int>', 'n: array<int>')}>")
    got = [r["r"] for r in df.select(records.clean(F.col("r"), df.schema["r"].dataType).alias("r")).collect()]
    assert got[1] is None
    r = got[0].asDict(recursive=True)
    masked = "a *** b *** " + "x" * 900
    assert r["note"] == masked[:800] + f"… (+{len(masked) - 800} симв.)"
    assert r["apiKey"] == "***" and r["tokens_in"] == 5 and r["inner"] == {"Authorization": "***", "list": [{"password": "***", "text": "***"}, None]}
    assert r["extra"] == {"Secret": "***", "token_count": "7", "x": None, "said": "bearer y sk-1"} and r["more"] == {"my_token": None, "ok": ["***"]}
    assert r["words"] == ["w"] * 50 + ["… ещё 2"] and r["n"] == list(range(50))
