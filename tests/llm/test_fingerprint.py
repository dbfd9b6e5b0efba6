"""Edit fingerprints: walks against a step-by-step walk, neighbours against brute force."""

import hashlib
import random

import numpy as np

from sparkloom.llm import fingerprint as fp
from sparkloom.llm.common import documents

SF = "/root/testdata/sf0.01"


def plain_walk(codes):
    """Characters that a walk sees, one step at a time."""
    dwell = fp._DWELL.reshape(fp.CLASSES, fp.PERIOD)
    seen, step = [], 0
    for c in codes.tolist():
        k = int(fp._mix(np.array([c]))[0] >> np.uint64(58))
        while True:
            seen.append(c)
            moves = dwell[k, step % fp.PERIOD] == 1
            step += 1
            if moves:
                break
    return seen


def test_walks_match_steps():
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdé 中🎉", k=n)) for n in (0, 1, 2, 7, 300, 2000, 2000)] + ["a" * 500]
    codes = [fp._codes(t) for t in texts]
    for c, times in zip(codes, fp.walks(codes, [0] * len(codes)), strict=True):
        seen = [x for x, n in zip(c.tolist(), np.diff(times).tolist(), strict=True) for _ in range(n)]
        assert seen == plain_walk(c)


def test_likeness_follows_edits():
    rng = random.Random(9)
    base = "".join(rng.choices("abcdefgh ", k=4000))
    few = list(base)
    for _ in range(2):
        few.insert(rng.randrange(len(few)), "x")
    other = "".join(rng.choices("abcdefgh ", k=4000))
    a, b, c = fp.fingerprint_texts([base, "".join(few), other])
    assert fp.likeness(a, a) == 1.0
    assert fp.likeness(a, b) > 0.5 > 0.2 > fp.likeness(a, c)
    assert set(fp.bands(a)) & set(fp.bands(b))
    assert fp.fingerprint_texts([""]) == fp.fingerprint_texts(["", "a"])[:1]
    assert fp.likeness(*fp.fingerprint_texts(["", "abc"])) < 0.6


def check(df):
    rows = [(r["doc_id"], r["text"] or "") for r in df.collect()]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for (key, text), (_, later) in zip(rows, rows[1:] + rows[:1], strict=True):
        c = len(text) // 3
        edited = text[: len(text) - c] + later[:c]
        a, e, b = fp.fingerprint_texts([text, edited, later])
        want.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, e, fp.likeness(a, e), fp.likeness(a, b), len(set(fp.bands(a)) & set(fp.bands(e)))))
    got = [tuple(r) for r in fp.edited_neighbours(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


def test_whole_table(spark):
    got = check(documents(spark, SF))
    assert np.mean([r[5] > r[6] for r in got]) > 0.9


def test_odd_rows(spark):
    rows = [(5, "abc def " * 40, 1), (3, None, 1), (3, None, 1), (3, "tie", 1), (9, "", 1), (None, "no id", 1), (None, None, 1), (-4, "x" * 30_000, 1), (7, "ab", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key long")
    check(df)
    check(df.filter("doc_id = 5"))
    assert fp.edited_neighbours(df.limit(0)).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(2)
    base = "".join(rng.choices("abcdefghij ", k=3000))
    near = base[:2900] + "".join(rng.choices("abcdefghij ", k=100))
    rows = [(4, base), (2, near), (9, base), (7, "".join(rng.choices("abcdefghij ", k=3000))), (1, None), (8, ""), (None, base)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in fp.near_duplicates(df).collect()}
    assert got == {4: 2, 2: 2, 9: 2, 7: 7, 1: 1, 8: 1, None: 2}
    assert fp.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_recall(spark):
    """Pairs at likeness 0.8 and more, by comparing all: 0.9 or more of them are linked, and no others are."""
    rng = random.Random(9)
    texts = []
    for i in range(150):
        size = rng.choice([60, 200, 900, 2500])
        base = "".join(rng.choices("abcdefghijklmnop ", k=size))
        keep = size - int(size * rng.uniform(0.0, 0.25))
        texts += [base, base[:keep] + "".join(rng.choices("abcdefghijklmnop ", k=size - keep))]
    prints = fp.fingerprint_texts(texts)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if fp.likeness(prints[i], prints[j]) >= 0.8]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in fp.near_duplicates(df).collect()}
    found = sum(got[i] == got[j] for i, j in pairs)
    assert len(pairs) > 50 and found >= 0.9 * len(pairs)
    exact = list(range(len(texts)))
    for i, j in sorted(pairs):  # plain labels: the smallest number reachable
        low, high = sorted((exact[i], exact[j]))
        exact = [low if x == high else x for x in exact]
    assert all(exact[i] == exact[got[i]] for i in got)
