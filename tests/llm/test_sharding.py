"""K-d shards: whole groups, even bytes, gapless slots."""

import zlib
from collections import Counter, defaultdict

from sparkloom.llm import queries, sharding

SF = "/root/testdata/sf0.1"


def check(rows, texts, shards):
    slots, where, sizes = defaultdict(list), {}, Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        assert 0 <= r["shard"] < shards
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    for r in rows:
        if r["doc_id"] in texts:
            text = (texts[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(text) + 16, zlib.crc32(text))
            assert where.setdefault(text, r["shard"]) == r["shard"]
    return sizes


def test_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op6_kd_sharding"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    sizes = check(rows, texts, 40)
    mean = sum(sizes.values()) / 40
    assert len(sizes) == 40 and max(abs(s - mean) for s in sizes.values()) < 0.05 * mean


def test_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "en", "a"), (2, "", "en", "a"), (None, "x", None, "b"), (4, "y" * 50_000, "de", "a"), (5, "x", "fr", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as shard", "2 as size")
    got = sharding.shard(df, 40).collect()
    assert len(got) == len(rows)
    check(got, {1: None, 2: "", 4: "y" * 50_000, 5: "x"}, 40)
    by_text = {r["text_crc32"]: r["shard"] for r in got if r["size"] == 17}
    assert len(by_text) == 1
    assert sharding.shard(df.limit(0), 40).count() == 0
    assert {r["shard"] for r in sharding.shard(df.filter("doc_id = 4"), 40).collect()} <= set(range(40))
