"""Tree and scores against a plain recursive context tree, and held-out accuracy."""

import math
import re
import zlib
from collections import Counter

import pytest

from sparkloom.llm import lm, queries

SF = "/root/testdata/sf0.01"


class PlainTree:
    """Nodes as a dictionary, mixed by recursion."""

    def __init__(self, texts, depth):
        self.depth, self.n = depth, Counter()
        for t in texts:
            for context, byte in self.steps(t):
                for b in range(8):
                    for d in range(depth + 1):
                        self.n[d, context[depth - d :], (1 << b) + (byte >> (8 - b)), byte >> (7 - b) & 1] += 1
        self.nodes = {k[:3] for k in self.n}
        self.children = {}
        for d, c, p in self.nodes:
            if d:
                self.children.setdefault((d - 1, c[1:], p), []).append((d, c, p))
        self.memo = {}

    def steps(self, text):
        data = b"\0" * self.depth + text + b"\0"
        return [(data[i - self.depth : i], data[i]) for i in range(self.depth, len(data))]

    def evidence(self, k):
        a, b = self.n[(*k, 0)], self.n[(*k, 1)]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def mixed(self, k):
        if k not in self.memo:
            e = self.evidence(k)
            if k[0] < self.depth:
                below = sum(self.mixed(c) for c in self.children[k])
                high = max(e, below)
                e = math.log(0.5) + high + math.log(math.exp(e - high) + math.exp(below - high))
            self.memo[k] = e
        return self.memo[k]

    def p1(self, context, prefix, d=0):
        k = (d, context[self.depth - d :], prefix)
        if k not in self.nodes:
            return None
        own = (self.n[(*k, 1)] + 0.5) / (self.n[(*k, 0)] + self.n[(*k, 1)] + 1)
        below = self.p1(context, prefix, d + 1) if d < self.depth else None
        if below is None:
            return own
        stop = math.exp(math.log(0.5) + self.evidence(k) - self.mixed(k))
        return stop * own + (1 - stop) * below

    def score(self, text):
        total = 0.0
        for context, byte in self.steps(text):
            for b in range(8):
                p = self.p1(context, (1 << b) + (byte >> (8 - b)))
                p = 0.5 if p is None else p
                total += math.log10(p if byte >> (7 - b) & 1 else 1 - p)
        return total


def plain(rows, depth):
    low = [(k, re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode()) for k, t in rows]
    apart = [k is not None and zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in low]
    tokens = [[*t.split(), b""] for _, t in low]
    counts = Counter(w for ws, out in zip(tokens, apart, strict=True) if not out for w in ws)
    n, v = sum(counts.values()), len(counts)
    tree = PlainTree([t for (_, t), out in zip(low, apart, strict=True) if not out], depth) if depth else None
    for (key, text), out, ws in zip(low, apart, tokens, strict=True):
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        yield key, out, len(ws), sum(w in counts for w in ws), n, base, tree.score(text) if tree else None


def compare(df, depth):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    order = lambda r: (str(r[0]), r[2], round(r[5], 4))
    got = sorted([tuple(r) for r in lm.score(df, depth or lm.DEPTH).collect()], key=order)
    want = sorted(plain(rows, depth), key=order)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        if depth:
            assert g[6] == pytest.approx(w[6], rel=1e-4, abs=1e-3)
    return got


def test_tree_matches_plain_tree(spark):
    texts = ["the cat sat on the mat", "The dog sat", "", None, "été à la mer\n", "zzz zzz", "x" * 400, "the cat", "a\0b", "mat mat mat cat"]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts * 2)] + [(None, "no id", "n"), (3, "again", "n")], "doc_id long, text string, word string")
    compare(df, 3)
    assert lm.score(df.limit(0)).count() == 0
    alone = spark.createDataFrame([(k, "a b") for k in range(40) if zlib.crc32(str(k).encode()) % 7 == 2][:2], "doc_id long, text string")
    compare(alone, 2)


def test_base_scores_and_held_out_accuracy(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = compare(df, 0)
    apart = [r for r in got if r[1]]
    # On texts it never saw the tree needs about 2.2 bits a byte; beyond 30 MB of texts it beats the unigram too.
    assert sum(r[7] for r in apart) / len(apart) < 2.4
    assert sum(r[6] for r in apart) > 1.05 * sum(r[5] for r in apart)
    assert "op4_context_tree_scores" in queries.QUERIES


def test_probabilities_add_up(spark):
    import numpy as np

    df = spark.createDataFrame([("hello world",), ("hello there",), ("",)], "text string")
    model = lm.table(lm.tree(lm.context_counts(df, 2), 2), 2)
    for context in (b"\0\0", b"he", b"zz", b"lo"):
        codes = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        assert (10 ** model.log10(codes)).sum() == pytest.approx(1.0, rel=1e-6)


@pytest.mark.parametrize("hot", [None, 0, 3000])
def test_scores_use_every_node(spark, monkeypatch, hot):
    """Hundreds of thousands of nodes, more than a table with slots keeps; with few codes that travel, the others are joined."""
    if hot is not None:
        monkeypatch.setattr(lm, "HOT_CODES", hot)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "substr(text, 1, 1500) as text").limit(80)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = {r["doc_id"]: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for r in plain(rows, lm.DEPTH):
        assert got[r[0]]["score"] == pytest.approx(r[6], rel=1e-7, abs=1e-7)
        assert got[r[0]]["held_out"] == (zlib.crc32(str(r[0]).encode()) % 7 == 2)


def test_scores_do_not_depend_on_the_batch(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i % 3} of some words") for i in range(12)], "doc_id long, text string").coalesce(1)
    want = sorted((r["doc_id"], round(r["score"], 9)) for r in lm.score(docs, 2).collect())
    monkeypatch.setattr(lm, "SCORE_BYTES", 1)
    assert sorted((r["doc_id"], round(r["score"], 9)) for r in lm.score(docs, 2).collect()) == want


@pytest.mark.parametrize("near, rows", [(1, 1), (2, 1 << 17), (5, 100)])
def test_tree_does_not_depend_on_the_groups(spark, monkeypatch, near, rows):
    monkeypatch.setattr(lm, "NEAR", near)
    monkeypatch.setattr(lm, "GROUP_ROWS", rows)
    texts = ["the cat sat on the mat", "The dog sat", "", "\u00e9t\u00e9 \u00e0 la mer", "x" * 400, "x" * 9000, "a\0b"]
    compare(spark.createDataFrame(list(enumerate(texts * 2)), "doc_id long, text string"), lm.DEPTH)


def test_only_short_contexts_are_written_down(spark, monkeypatch):
    """The nodes of all lengths took eight times the codes' rows, and more disk than a small input has."""
    written = Counter()

    def counted(df, label):
        out = materialize(df, label)
        written[label] += out.count()
        return out

    materialize = lm.materialize
    monkeypatch.setattr(lm, "materialize", counted)
    lm.score(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).count()
    assert written["lm-contexts"] == written["lm-codes"] > 0
    assert written["ctw-nodes"] < 2 * written["lm-contexts"]


def test_evidence_of_large_counts():
    import numpy as np

    n0, n1 = np.array([0, 5, 4096, 4097, 10**6]), np.array([0, 0, 3, 5000, 7])
    want = [math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for a, b in zip(n0.tolist(), n1.tolist(), strict=True)]
    assert lm._evidences(n0, n1) == pytest.approx(want, abs=1e-7)
