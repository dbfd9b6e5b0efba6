"""Every stage of the pipeline against brute force on its own input."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from sparkloom.llm import mixing, queries
from tests.llm.test_mixing import plain_budgets
from tests.llm.test_quality import plain
from tests.llm.test_simhash_copies import plain_groups

SF = "/root/testdata/sf0.001"


def judged(rows):
    """Rows that the rules keep, hosts judged against a prior fitted by moments."""
    checks = []
    for r in rows:
        words, chars, symbols, lines, repeats = plain(r["text"])
        base = words < 50 or 100 * repeats > 50 * words
        checks.append((base, base or 100 * symbols > 10 * chars or 100 * lines > 30 * words))
    docs, fails = Counter(r["source"] for r in rows), Counter(r["source"] for r, (_, f) in zip(rows, checks, strict=True) if f)
    n = sum(docs.values())
    p = sum(fails.values()) / n
    v = (sum(fails[h] ** 2 / docs[h] for h in docs) - n * p * p - (len(docs) - 1) * p * (1 - p)) / (n - sum(x * x for x in docs.values()) / n)
    m = max(0, p * (1 - p) / v - 1) if v > 0 else None
    rate = {h: p if m is None else (fails[h] + p * m) / (docs[h] + m) for h in docs}
    bad = {h for h, r in rate.items() if r * (1 - p) > 2 * p * (1 - r) + 1e-9}
    watched = {h for h, r in rate.items() if r > p + 1e-9}
    return [r for r, (base, failed) in zip(rows, checks, strict=True) if not base and r["source"] not in bad and not (failed and r["source"] in watched)]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.collect()
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(kept.collect()) == sorted(judged(first))
    one = stages["near_dedup"](spark, docs, SF)
    assert one.columns == docs.columns
    rows = sorted(first, key=lambda r: r["doc_id"])
    parts = plain_groups([r["text"] for r in rows])
    assert sorted(one.collect()) == [r for i, r in enumerate(rows) if parts[i] == i]
    safe = stages["pii_surrogates"](spark, docs, SF)
    assert safe.columns == docs.columns and safe.count() == len(first)
    mixed = stages["source_mixing"](spark, docs, SF)
    assert mixed.columns == docs.columns
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    domain = lambda s: dict(mixing.DOMAINS).get(s, "other")
    have, got, longest = Counter(), Counter(), defaultdict(int)
    for r in first:
        k = domain(r["source"]), r["lang"], r["source"]
        have[k] += size(r)
        longest[k] = max(longest[k], size(r))
    for r in mixed.collect():
        got[domain(r["source"]), r["lang"], r["source"]] += size(r)
    for k, b in plain_budgets(list(have.items()), mixing.Mix()).items():
        assert b - longest[k] - 1 <= got[k] <= b + 1


def test_run_packs_what_the_stages_keep(spark):
    byte = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, SF).collect()
        docs = spark.createDataFrame(rows, docs.schema)
    want = Counter()
    for r in rows:
        ids = [*byte.encode(r["text"], add_special_tokens=False).ids, 2]
        cut = (len(ids) - 1) % 1024 + 1
        for i, at in enumerate([0, *range(cut, len(ids), 1024)]):
            part = np.array(ids[at : cut if i == 0 else at + 1024], "<u4")
            want[r["doc_id"], i, at, len(part), zlib.crc32(part.tobytes())] += 1
    got, used = Counter(), defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        got[tuple(r)[:5]] += 1
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for parts in used.values():
        assert sum(n for _, n in parts) <= 1024
        assert sorted(o for o, _ in parts) == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))]
