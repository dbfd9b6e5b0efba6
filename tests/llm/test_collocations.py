import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, f long"


def brute(docs, least=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        good = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in good.items():
            if any(len(q) == 3 and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in good.items() if len(p) == 2):
                continue
            score, _, left, right = min((10**6 * a * a // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out, key=str)


ODD = [("Big Data, big data! big data sets\tbig data sets", "en")] * 12 + [(None, "en"), ("", None), (" . , ", "de"), ("a a a a a a a a a a a a a a", None), ("x\x0by z\x00w", "und")]
ODD += [("ñu ÑU ñu " * 20, "a\nb\t"), ("left right " * 30_000, "hot"), ("one two three. " * 11 + "one two. " * 15 + "two three; " * 30, "en")]


def run(spark, docs, **more):
    df = spark.createDataFrame([(i, *r, "clash", 1) for i, r in enumerate(docs)], SCHEMA)
    return sorted(map(tuple, collocations.mine(df, **more).collect()), key=str)


@pytest.mark.parametrize("shard", [collocations.SHARD_BYTES, 60])
def test_odd_rows_match_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(collocations, "SHARD_BYTES", shard)
    assert run(spark, ODD) == brute(ODD)
    assert run(spark, ODD, top=2) == brute(ODD, top=2)


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, None)]) == []


def test_score_is_exact_beyond_64_bits(spark):
    cases = [(10**15, 10**15 + 7, 10**15 + 1), (3 * 10**12, 10**13 + 1, 9 * 10**12), (10, 10, 10), (2**50, 2**51 - 1, 2**50)]
    got = spark.createDataFrame(cases, "a long, l long, r long").select("a", "l", "r", collocations.score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert all(r["s"] == 10**6 * r["a"] ** 2 // (r["l"] * r["r"]) for r in got)


def test_automaton_states_are_endpos_classes():
    rng = np.random.default_rng(3)
    for size in (1, 2, 5, 60):
        tokens = rng.integers(0, 4, size)
        follows = rng.random(size) < 0.8
        follows[0] = False
        automaton = collocations.Automaton(np.unique(tokens, return_inverse=True)[1], follows, 3)
        ends = defaultdict(set)
        for i in range(size):
            for k in (1, 2, 3):
                if i - k + 1 >= 0 and all(follows[j] for j in range(i - k + 2, i + 1)):
                    ends[tuple(tokens[i - k + 1 : i + 1])].add(i)
        for k in (1, 2, 3):
            at, counts = automaton.substrings(k)
            assert {tuple(tokens[e - k + 1 : e + 1]): c for e, c in zip(at, counts, strict=True)} == {p: len(e) for p, e in ends.items() if len(p) == k}
        assert len(automaton.length) == 1 + len({frozenset(e) for e in ends.values()})
        for s in range(1, len(automaton.length)):
            longest = tuple(tokens[automaton.end[s] - automaton.length[s] + 1 : automaton.end[s] + 1])
            suffix = longest[len(longest) - automaton.length[automaton.link[s]] :] if automaton.length[automaton.link[s]] else ()
            assert ends[longest] < ends[suffix] if suffix else automaton.link[s] == 0
            assert len(ends[longest]) == automaton.endpos[s]


def test_top_per_group_over_many_buckets(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).cast("string").alias("g"), "id")
    got = collocations.top_per_group(df, "g", [F.desc("id")], 5).collect()
    for g, ids in (("true", [4998 - 3 * i for i in range(5)]), ("false", [4999, 4997, 4996, 4994, 4993])):
        assert [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["g"] == g] == ids


def test_words_are_cut_within_their_texts():
    from sparkloom.llm.byte_words import cut, runs, separators

    texts = pa.array(["ab", "cd e", None, "", " F ", "g"])
    found = cut(texts.slice(1), separators((0x20, 0x20)))
    assert found.words.to_pylist() == ["cd", "e", "f", "g"]
    assert found.documents().tolist() == [0, 0, 3, 4] and found.per_document().tolist() == [2, 0, 0, 1, 1]
    assert list(runs(texts, 3)) == [(0, 1), (1, 2), (2, 5), (5, 6)]


def test_a_task_reads_part_of_a_shuffle_partition(spark):
    docs = spark.createDataFrame([("en", "a b c. " * 20)], "lang string, text string")
    counts = collocations.phrase_counts(docs, 3, 10)
    assert counts.rdd.getNumPartitions() == collocations.BLOCKS * int(spark.conf.get("spark.sql.shuffle.partitions")) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {r["phrase"]: r["f"] for r in counts.collect() if r["words"]} == {"a": 20, "b": 20, "c": 20, "a b": 20, "b c": 20, "a b c": 20}
