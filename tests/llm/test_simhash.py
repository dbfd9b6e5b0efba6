"""SimHash components against brute force."""

import re

import numpy as np
import xxhash

from sparkloom.llm import queries, simhash
from sparkloom.llm.common import documents

SF = "/root/testdata/sf0.01"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    values = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def plain_components(rows, radius=4):
    """{row index: smallest id} by comparing everything with everything."""
    fps = np.array([f for _, f in rows], np.uint64)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius) + i + 1:
            parent[find(int(j))] = find(i)
    low = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            low[find(i)] = min(low.get(find(i), key), key)
    return [low.get(find(i)) for i in range(len(rows))]


def check(df):
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in df.collect()]
    want = [(k, f"{f:016x}", c) for (k, f), c in zip(rows, plain_components(rows), strict=True)]
    order = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=order) == sorted(want, key=order)


def test_whole_table(spark):
    check(documents(spark, SF))


def test_odd_rows(spark):
    texts = [None, "", " \n", "A b", "a b", "x " * 30_000, "one two three four", "ONE two\tthree four", "é É", "é é"]
    rows = [(i, t, "n") for i, t in enumerate(texts)] + [(3, "A b", "n"), (None, "a b", "n"), (None, None, "n"), (None, "alone here", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    check(df)
    check(df.limit(0))


def test_links_of_clusters(spark):
    """Dense balls, chains and strangers, found as by brute force."""
    rng = np.random.default_rng(5)
    fps = set(rng.integers(0, 1 << 63, 400).tolist())
    for centre in rng.integers(0, 1 << 63, 3).tolist():
        walker = centre
        for _ in range(300):
            flips = rng.choice(63, rng.integers(1, 5), replace=False)
            fps.add(centre ^ sum(1 << int(b) for b in flips))
            walker ^= 1 << int(rng.integers(0, 63)) | 1 << int(rng.integers(0, 63))
            fps.add(walker)
    nodes = sorted(fps)
    want = plain_components([(f, f) for f in nodes])
    groups = lambda names: sorted(sorted(g) for g in names.values())
    for agree in (None, 2, 3):
        got = simhash.components(simhash.links(spark.createDataFrame([(f,) for f in nodes], "fp long"), 4, agree)).collect()
        root = {r["node"]: r["root"] for r in got}
        mine, theirs = {}, {}
        for f, w in zip(nodes, want, strict=True):
            mine.setdefault(root.get(f, f), []).append(f)
            theirs.setdefault(w, []).append(f)
        assert groups(mine) == groups(theirs)


def test_shards_stay_small():
    """More fingerprints, more blocks that agree: about SHARD or fewer of spread ones share a shard."""
    assert [simhash.agreeing(n, 4) for n in (0, 10**6, 10**9, 10**10, 10**11)] == [1, 1, 2, 2, 3]


def test_tree_matches_brute_force():
    rng = np.random.default_rng(1)
    for spread in (6, 12, 64):
        fps = np.unique(rng.integers(0, 1 << 63, 1, np.uint64) ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, spread, (1500, 5), np.uint64), axis=1))
        a, b = simhash._Tree(fps, 2).links()
        assert (np.bitwise_count(fps[a] ^ fps[b]) <= 64).all()
        label = simhash._labels(len(fps), a, b)
        want = plain_components([(i, int(f)) for i, f in enumerate(fps)], 2)
        assert label.tolist() == want


def test_registered():
    assert "op10_simhash_near_dedup" in queries.QUERIES
