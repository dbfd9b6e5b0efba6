"""Counts, packing and the token store against the libraries and brute force."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm import bpe_count, packing, queries, token_store, tokens
from sparkloom.llm.common import documents
from sparkloom.llm.tokens import byte_level, word_level

SF = "/root/testdata/sf0.01"
BYTE, WORD = (queries.vocabulary(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = [
    None, "", " ", "\n\n  \t", "a<|endoftext|> b<|endoftext|>", "  x \n\n y  z\t", "ΣΑΣ İ ﬁ é don't 'S <|startoftext|>x 123", "　中文 テスト 🎉🎉 \x1cq",
    "a \n\nb   c", "ß Straße ÄÖÜ ÿ×÷", "x" * 20_000, "ab " * 5_000, "we'll they're I'd it's'm", "¼ ² µ ª",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "k") for i, t in enumerate(ODD)] + [(3, ODD[3], "k"), (None, "null key", "k"), (None, None, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, length string")


@pytest.fixture(scope="module")
def texts(spark):
    return [r["text"] for r in documents(spark, SF).limit(400).collect()] + ODD


def test_words_are_named_by_bytes_and_encoded_once():
    for word in (" a", "a", " ", "  ", "\t", " é", "ß", "\x7f", " a b", "don't", " \x00"):
        assert tokens._named(word) == "".join(chr(b) if b not in tokens._BYTE_NAMES else tokens._BYTE_NAMES[b] for b in word.encode())
    asked = []
    known = tokens._Words(lambda w: asked.append(w) or w.encode())
    long = "x" * (tokens.CACHE_CHARS + 1)
    assert [known[w] for w in ("a", "b", "a", long, long)] == [b"a", b"b", b"a", long.encode(), long.encode()]
    assert asked == ["a", "b", long, long] and list(known) == ["a", "b"]


def test_encoders_match_library(texts):
    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    for t in texts:
        want = byte.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(byte_level(BYTE).encode(t), "<u2").tolist() == want
        assert bpe_count.counter(BYTE, queries.BYTE_PATTERN).count(t) == len(want)
        assert np.frombuffer(word_level(WORD).encode(t), "<u2").tolist() == word.encode(t or "", add_special_tokens=False).ids


def test_counts(spark, odd):
    got = bpe_count.count_tokens(odd, BYTE, queries.BYTE_PATTERN).collect()
    assert len(got) == odd.count()
    one = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert (one[0]["n_bytes"], one[0]["n_tokens"], one[0]["over_limit"]) == (0, 0, False)
    assert one[10]["n_bytes"] == 20_000 and one[10]["over_limit"]
    assert bpe_count.count_tokens(odd.limit(0), BYTE, queries.BYTE_PATTERN).count() == 0


def check_packing(rows, ids_of):
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    for key, ids in ids_of.items():
        at = 0
        for i, r in enumerate(sorted(by_doc[key], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (i, at)
            assert r["length"] == 1024 or i == 0
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    return len(by_sequence)


def test_pack_whole_table(spark):
    byte = Tokenizer.from_file(BYTE)
    ids = {r["doc_id"]: byte.encode(r["text"] or "", add_special_tokens=False).ids + [2] for r in documents(spark, SF).collect()}
    sequences = check_packing(queries.QUERIES["op8_best_fit_packing"](spark, SF).collect(), ids)
    assert sequences <= -(-sum(map(len, ids.values())) // 1024) * 1.01 + 1


def test_pack_odd_rows(spark, odd):
    once = odd.filter("doc_id is not null").dropDuplicates(["doc_id"])
    byte = Tokenizer.from_file(BYTE)
    ids = {i: byte.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(ODD)}
    cut = lambda df: packing.pieces(df, BYTE)
    check_packing(packing.pack(cut(once)).collect(), ids)
    assert packing.pack(cut(odd)).count() == cut(odd).count()
    assert packing.pack(cut(odd.limit(0))).count() == 0


def test_very_long_runs(spark):
    byte = Tokenizer.from_file(BYTE)
    for run in (" " * 1_000_000 + "x", "a" * 5_000_000, "=" * 1_000_000, " " * 5_000_000):
        got = np.frombuffer(byte_level(BYTE).encode(run), "<u2").tolist()
        assert got == byte.encode(run, add_special_tokens=False).ids
    rows = packing.pack(packing.pieces(spark.createDataFrame([(1, " " * 1_000_000 + "x")], "doc_id long, text string"), BYTE)).collect()
    assert sum(r["length"] for r in rows) == 1_000_001  # the last space and x are one token


def plain_best_fit(counts, capacity):
    gaps, sequences = [0] * (capacity + 1), 0
    for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        gap = next((g for g in range(length, capacity + 1) if gaps[g]), None)
        if gap is None:
            sequences, gap = sequences + 1, capacity
        else:
            gaps[gap] -= 1
        gaps[gap - length] += 1
    return sequences


def test_best_fit_against_one_piece_at_a_time():
    rng = np.random.default_rng(8)
    for _ in range(300):
        counts = {int(k): int(v) for k, v in zip(rng.integers(1, 65, 20), rng.integers(1, 30, 20), strict=True)}
        left = np.array([counts.get(i, 0) for i in range(65)])
        patterns = packing.best_fit(left)
        used = defaultdict(int)
        for lengths, times in patterns:
            assert sum(lengths) <= 64 and times > 0
            for x in lengths:
                used[x] += times
        assert dict(used) == counts and not left.any()
        assert sum(times for _, times in patterns) == plain_best_fit(counts, 64)
        assert sum(times for _, times in packing.plan(counts, 64)) <= plain_best_fit(counts, 64)


def test_plan_uses_every_piece():
    rng = np.random.default_rng(3)
    for _ in range(40):
        counts = {int(k): int(v) for k, v in zip(rng.integers(1, 65, 20), rng.integers(1, 9, 20), strict=True)}
        used, sequences = defaultdict(int), 0
        for lengths, times in packing.plan(counts, 64):
            assert sum(lengths) <= 64 and times > 0
            sequences += times
            for x in lengths:
                used[x] += times
        assert dict(used) == counts
        assert sequences <= plain_best_fit(counts, 64)
    assert packing.plan({}, 64) == []


def test_exact_fills_go_by_parts():
    taken = lambda counts: packing.exact_fills(np.array([counts.get(i, 0) for i in range(65)]))
    assert taken({64: 2, 40: 3, 24: 2, 20: 1, 4: 1}) == [((64,), 2), ((40, 24), 2), ((40, 20, 4), 1)]
    assert taken({30: 1, 20: 1, 10: 1, 4: 1}) == [((30, 20, 10, 4), 1)]
    assert taken({32: 3, 16: 2}) == [((32, 32), 1), ((32, 16, 16), 1)]
    assert taken({50: 1, 20: 1}) == []


def test_store_round_trip(spark, odd, tmp_path):
    word = Tokenizer.from_file(WORD)
    for name, df in (("a", odd), ("b", documents(spark, SF)), ("c", odd.limit(0))):
        path = f"file://{tmp_path}/{name}"
        token_store.write_store(df, path, WORD)
        want, at = [], 0
        rows = [(r["doc_id"], np.array(word.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4")) for r in df.collect()]
        for key, ids in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1].astype("<u2").tobytes())):
            want.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        got = [tuple(r) for r in token_store.with_starts(token_store.read_store(spark, path)).collect()]
        assert sorted(got, key=lambda r: r[1]) == want
    few = token_store.read_store(spark, f"file://{tmp_path}/b", keys=[5, 17], keep_ids=True).collect()
    assert sorted(r["doc_id"] for r in few) == [5, 17]
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in few)


def test_store_rejects_another_dictionary(spark, odd, tmp_path):
    path = f"file://{tmp_path}/d"
    token_store.write_store(odd, path, WORD)
    blocks = spark.read.parquet(f"{path}/blocks").withColumn("dictionary_sha256", F.lit("x"))
    blocks.write.parquet(f"{path}-2/blocks")
    spark.read.parquet(f"{path}/dictionary").write.parquet(f"{path}-2/dictionary")
    with pytest.raises(Exception, match="another dictionary"):
        token_store.read_store(spark, f"{path}-2").collect()
