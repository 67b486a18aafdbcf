import random

import numpy as np

from evidentia.llm import jaccard

ASCII = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute(docs, n, num, den):
    sets = {}
    for i, t in docs:
        w = (t or "").translate(ASCII).encode().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and den * len(sets[x] & sets[y]) >= num * len(sets[x] | sets[y]):
                a, b = sorted((root(x), root(y)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def cases():
    r, docs = random.Random(6), []
    for base in range(12):
        words = [f"w{r.randint(0, 300)}" for _ in range([4, 12, 25, 60, 150, 400][base % 6])]
        for _ in range(14):
            w = list(words)
            for _ in range(r.randint(0, 1 + len(w) // 25)):
                w[r.randrange(len(w))] = f"v{r.randint(0, 9)}"
            docs.append(" ".join(w) if r.random() < 0.8 else " ".join(w).upper())
    docs += [None, "", " \n", "a", "A", "a b", "b a", "the the the the the", "x " * 500, docs[3]]
    r.shuffle(docs)
    return list(enumerate(docs))


def test_components_are_exact(spark):
    docs = cases()
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id int, text string, component_id string").repartition(3)
    for n, (num, den) in ((3, (9, 10)), (5, (8, 10))):
        want = brute(docs, n, num, den)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df, n, (num, den)).collect()}
        assert got == want
        assert len({c for _, c in want.values()}) < 0.8 * len(docs)


def test_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 5)
    docs = cases()[:60]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df, 3, (9, 10)).collect()} == brute(docs, 3, 9, 10)


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (9, "A b c d"), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in jaccard.near_duplicates(df).collect())
    assert got == [(-1, 0, -1), (-1, 1, -1), (4, 1, 4), (4, 1, 4), (9, 1, 4)]
    assert jaccard.near_duplicates(df.limit(0)).count() == 0


def test_links_in_dense_groups_of_all_sizes(spark, monkeypatch):
    """Chains of versions, a template with copies some of which are linked and some not, and a passage that many others hold."""
    monkeypatch.setattr(jaccard, "TILE", 12)
    r, docs = random.Random(2), []
    for base, size in enumerate((30, 128)):
        words = [f"b{base}w{i}" for i in range(size)]
        for i in range(8):
            docs.append([*words[i * size // 40 :], *(f"b{base}n{k}" for k in range(i * size // 60))])
        for i in range(14):
            copy = list(words)
            for k in r.sample(range(size), r.randint(0, size // 6)):
                copy[k] = f"b{base}c{i}x{k}"
            docs.append(copy)
    passage = [f"p{i}" for i in range(60)]
    docs += [[*passage, *(f"q{i}o{k}" for k in range(r.randint(3, 25)))] for i in range(18)]
    docs = list(enumerate(" ".join(d) for d in docs))
    df = spark.createDataFrame(docs, "doc_id int, text string").repartition(4)
    for n, num, den in ((2, 8, 10),):
        want = brute(docs, n, num, den)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df, n, (num, den)).collect()} == want
        assert 5 < len({c for _, c in want.values()}) < len(docs) - 10


def test_linked_sets_share_a_block():
    r = np.random.default_rng(4)
    for num, den in ((9, 10), (8, 10), (5, 10)):
        bands = jaccard.Bands(num, den)
        for _ in range(600):
            a = int(r.integers(1, 500))
            b = int(r.integers(a, a * den // num + 1))
            both = -(-num * (a + b) // (num + den))
            s = r.integers(0, 2**64, a + b - both, dtype=np.uint64)
            x, y = np.sort(s[:a]), np.sort(s[a - both :])
            for level in (0, 1):
                keys, of = jaccard.block_keys([x, y], bands, level)
                assert a + b == 2 * both or set(keys[of == 0].tolist()) & set(keys[of == 1].tolist()), (a, b, both)


def test_unlinked_sets_seldom_share_a_block():
    r = np.random.default_rng(4)
    for num, den in ((9, 10), (8, 10)):
        sets = [np.sort(r.integers(0, 2**64, int(r.integers(60, 600)), dtype=np.uint64)) for _ in range(300)]
        keys, of = jaccard.block_keys(sets, jaccard.Bands(num, den))
        assert len(keys) < 0.35 * sum(map(len, sets))
        assert len(np.unique(keys)) == len(keys)


def test_memberships_of_near_copies_stay_packed(spark, monkeypatch):
    """Of groups that overlap, a set has one row in its cluster and DENSE rows by which it meets others, however many groups it is in."""
    monkeypatch.setattr(jaccard, "TILE", 10)
    names = [i.to_bytes(1, "big") * jaccard.SID for i in range(1, 200)]
    rows = []
    for g in range(30):  # two clusters of 15 groups each, whose parts hold the first member too
        own = [x for i, x in enumerate(names) if i % 2 == g % 2 and (i // 2 + g) % 15]
        rows += [(g, p, b"".join(own[:1] * (p > 0) + own[p * 10 : p * 10 + 10])) for p in range(-(-len(own) // 10))]
    others = [i.to_bytes(1, "big") * jaccard.SID for i in range(200, 220)]  # a passage that two sets of different clusters hold too
    rows += [(99, 0, b"".join([*names[:2], *others[:8]])), (99, 1, b"".join([names[0], *others[8:]]))]
    cluster, meet, dense = jaccard.clusters(spark.createDataFrame(rows, "gid long, part int, members binary").repartition(3))
    of = {}
    for r in cluster.collect():
        of.setdefault(r["gid"], []).append(bytes(r["sid"]))
    assert sorted(map(sorted, of.values())) == [sorted(names[::2]), sorted(names[1::2])]
    assert sorted(r["gid"] for r in dense.collect()) == list(range(30))
    assert meet.count() == jaccard.DENSE * len(names) and max(r["count"] for r in meet.groupBy("gid", "part").count().collect()) <= 3 * jaccard.TILE


def test_groups_inside_a_cluster_are_dropped(spark, monkeypatch):
    """Groups of up to TILE near copies: pairs of what is left, and of the clusters, are all pairs of all groups; rows don't grow with groups."""
    monkeypatch.setattr(jaccard, "TILE", 16)
    r, names = random.Random(3), [i.to_bytes(1, "big") * jaccard.SID for i in range(1, 61)]
    whole = [sorted(r.sample(names[:40], r.randint(4, 16))) for _ in range(200)]  # of one family, each set in about 50 of them
    whole += [sorted([names[k], *names[40 + 2 * k : 42 + 2 * k]]) for k in range(10)]  # a member that meets strangers too
    rows = [(i, -1, b"".join(g)) for i, g in enumerate(whole)]
    rows += [(1000, p, b"".join(([names[0]] if p else []) + names[p * 16 : p * 16 + 16])) for p in range(4)]  # a large group, not inside
    rest, cluster = jaccard.collapsed(spark.createDataFrame(rows, "gid long, part int, members binary").repartition(3))
    kept, of, met = {}, {}, {}
    for x in rest.collect():
        kept.setdefault(x["gid"], []).append(x["part"])
    for x in cluster.collect():
        of.setdefault(x["gid"], set()).add(bytes(x["sid"]))
    assert sorted(kept) == [*range(200, 210), 1000] and sorted(kept[1000]) == [0, 1, 2, 3]
    assert [sorted(c) for c in of.values()] == [names[:40]]
    assert sum(map(len, whole)) > 40 * len(names[:40])
    for x in jaccard.meeting(cluster).collect():
        met.setdefault(x["part"], set()).add(bytes(x["sid"]))
    assert sum(map(len, met.values())) == jaccard.DENSE * 40 and set().union(*met.values()) == of.popitem()[1]
