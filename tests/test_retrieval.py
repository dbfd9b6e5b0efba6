import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.similarity import best_stretch
from sparkloom.operators import retrieval
from sparkloom.operators.retrieval import Field

WORDS = "red blue ring bolt gear small hot storm dragon widget Ünïcode 검색 of the and".split()


def some(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    questions = [(i, some(rng, rng.randrange(1, 6)) + "?") for i in range(25)] + [(90, ""), (91, None), (92, "!!"), (93, "red ring")]
    docs = [(i, rng.choice("abc"), some(rng, 2), [some(rng, 1) for _ in range(rng.randrange(3))], some(rng, 25), f"g{rng.randrange(3)}") for i in range(60)]
    docs += [(100, "a", None, None, None, "g0"), (101, "b", "", ["", None], "", None), (102, "d", "red ring", [], "red ring", "g0"), (103, "a", "red ring", [], None, "g0")]
    return questions, docs


def brute(questions, docs, least):
    out = {}
    for q, question in questions:
        for i, _, name, extra, content, _ in docs:
            if question is None:
                continue
            scores = [best_stretch(name, question) if name else 0, *[0.9 * best_stretch(x, question) for x in extra or [] if x], 0.5 * best_stretch(question, content) if content else 0]
            if max(scores) >= least:
                out[q, i] = max(scores)
    return out


FIELDS = [Field("name", "name"), Field("extra", "list", 0.9), Field("content", "content", 0.5)]


def frames(spark, corpus):
    return spark.createDataFrame(corpus[0], "qid long, question string"), spark.createDataFrame(corpus[1], "id long, kind string, name string, extra array<string>, content string, g string")


@pytest.mark.parametrize("least", [0.25, 0.45, 0.8])
def test_scores_are_those_of_all_pairs(spark, corpus, least):
    questions, docs = frames(spark, corpus)
    got = {(r["qid"], r["id"]): r["relevance"] for r in retrieval.relevance_pairs(questions, docs, "qid", "question", "id", FIELDS, least).collect()}
    want = brute(*corpus, least)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert len(want) > 50


def test_candidates_are_few_and_bounded(spark):
    rng = random.Random(1)
    names = spark.createDataFrame([("".join(rng.choice("abcdefghij") for _ in range(8)),) for _ in range(400)], "text string")
    pairs = retrieval.trigram_pairs(names, names, 0.7)
    assert 400 <= pairs.count() < 2000
    assert "CartesianProduct" not in pairs._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="least"):
        retrieval.trigram_pairs(names, names, 0.0)


def test_thresholds_caps_and_quotas(spark, corpus):
    questions, docs = frames(spark, corpus)
    got = retrieval.retrieve(questions, docs, "qid", "question", "id", "kind", FIELDS, {"a": 2, "b": 3}, 0.3, {"a": 0.6}, "g", 1).collect()
    scores, kinds = brute(*corpus, 0.3), {d[0]: (d[1], d[5]) for d in corpus[1]}
    want = set()
    for q in {k[0] for k in scores}:
        for kind, quota, least in (("a", 2, 0.6), ("b", 3, 0.3)):
            ranked = sorted((i for (p, i), s in scores.items() if p == q and kinds[i][0] == kind and s >= least), key=lambda i: (-round(scores[q, i], 9), i))
            first = [i for n, i in enumerate(ranked) if kinds[i][1] not in {kinds[j][1] for j in ranked[:n]}]
            want |= {(q, i, rank) for rank, i in enumerate(first[:quota], 1)}
    assert {(r["qid"], r["id"], r["rank"]) for r in got} == want
    none = retrieval.retrieve(questions, docs.limit(0), "qid", "question", "id", "kind", FIELDS, {"a": 2}, 0.3, order=[F.col("id").desc()])
    assert none.count() == 0


def test_only_the_first_documents_of_a_value_are_paired(spark, monkeypatch):
    questions = spark.createDataFrame([(i, ["red ring?", "blue bolt?"][i % 2]) for i in range(40)], "qid long, question string")
    rows = [(i, "ab"[i % 2], ["red ring", "blue bolt", "red bolt"][i % 3], [["red"], ["ring", "blue"], ["red", "red", None]][i % 5 % 3], f"g{i // 2 % 3}", i % 7) for i in range(300)]
    docs = spark.createDataFrame(rows, "id long, kind string, name string, extra array<string>, g string, late int")
    paired = []
    pairs = retrieval.relevance_pairs
    monkeypatch.setattr(retrieval, "relevance_pairs", lambda *a: paired.append(pairs(*a)) or paired[-1])
    for group, cap in (("g", 2), (None, None)):
        got = retrieval.retrieve(questions, docs, "qid", "question", "id", "kind", FIELDS[:2], {"a": 3, "b": 4}, 0.3, {"a": 0.5}, group, cap, [F.col("late").desc()])
        want = set()
        for q, asked in enumerate(["red ring?", "blue bolt?"] * 20):
            for kind, quota, least in (("a", 3, 0.5), ("b", 4, 0.3)):
                scored = [(-late, -max([best_stretch(name, asked), *[0.9 * best_stretch(x, asked) for x in extra if x]]), i, g) for i, k, name, extra, g, late in rows if k == kind]
                ranked = sorted(x for x in scored if -x[1] >= least)
                kept = [x for n, x in enumerate(ranked) if cap is None or sum(y[3] == x[3] for y in ranked[:n]) < cap]
                want |= {(q, x[2], rank) for rank, x in enumerate(kept[:quota], 1)}
        assert {(r["qid"], r["id"], r["rank"]) for r in got.collect()} == want
        assert got.count() == len(want)
        # Two questions, six values, two kinds; not 40 questions with hundreds of documents each.
        assert paired[-1].count() <= 2 * 6 * 2 * (3 * cap if cap else 4)
