from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import corpus, search
from sparkloom.sources import decode, snapshots


def test_replies_and_tables(spark):
    df = spark.createDataFrame([('{"result":{"content":[{"text":"{\\"a\\":1}"}]}}',), ("{}",)], "body string")
    assert [r[0] and r[0]["a"] for r in df.select(decode.unwrap_reply(F.col("body"), "a int")).collect()] == [1, None]
    bad = spark.createDataFrame([('{"error":{"message":"gone"}}',)], "body string")
    with pytest.raises(Exception, match="gone"):
        bad.select(decode.unwrap_reply(F.col("body"), "a int")).collect()
    t = spark.createDataFrame([(["x", "y"], [["1", "2"], ["3", None]]), (["x"], [])], "h array<string>, r array<array<string>>")
    assert [r[0] for r in t.select(decode.table_rows(F.col("h"), F.col("r"))).collect()] == [[{"x": "1", "y": "2"}, {"x": "3", "y": None}], []]
    with pytest.raises(Exception, match="differ in length"):
        spark.createDataFrame([(["x"], [["1", "2"]])], t.schema).select(decode.table_rows(F.col("h"), F.col("r"))).collect()


def test_entries_names_and_defaults(spark):
    df = spark.createDataFrame([([(1, "a"), (2, "b"), (2, "c")], {"de": "", "en": "N"}, "id")], "e array<struct<number:int,v:string>>, n map<string,string>, i string")
    row = df.select(decode.pick_entry(F.col("e"), "number", 2)["v"], decode.pick_entry(F.col("e"), "number", 9), decode.localized(F.col("n"), "en", F.col("i"))).first()
    assert tuple(row) == ("b", None, "N")
    when = datetime(2026, 1, 1)
    raw = spark.createDataFrame([("2026-08-07T01:02:03Z", 1.0, 4.0), ("soon", 1.0, 0.0)], "raw string, a double, b double")
    rows = raw.select(decode.timestamp_or(F.col("raw"), F.lit(when)), decode.share_or_zero(F.col("a"), F.col("b"))).collect()
    assert rows[1][0] == when and rows[0][0] != when and [r[1] for r in rows] == [0.25, 0.0]
    assert [(r["pos"], r["v"]) for r in decode.exploded(df, "e", ["i"]).collect()] == [(0, "a"), (1, "b"), (2, "c")]
    with pytest.raises(ValueError, match="at least 3"):
        decode.require_rows(raw, 3)


def test_versions_and_promotion(spark, tmp_path):
    path, log, runs = (str(tmp_path / x) for x in ("t", "log", "runs"))
    one, two = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,), (3,)], "a int")
    assert snapshots.current_version(spark, log) is None
    with pytest.raises(ValueError, match="has no version"):
        snapshots.promote(spark, log, "1.1", [path])
    snapshots.publish(one, path, "1.1")
    snapshots.publish(two, path, "1.10")
    for v in ("1.1", "1.10"):
        snapshots.promote(spark, log, v, [path])
    assert snapshots.current_version(spark, log) == "1.10"
    snapshots.publish(two.limit(0), path, "1.10")
    assert snapshots.read_version(spark, path, "1.10").count() == 0
    assert [tuple(r) for r in snapshots.read_version(spark, path, "1.1").collect()] == [(1, "1.1")]

    def fail():
        raise RuntimeError("no reply")

    done = []
    assert not snapshots.run_steps(spark, runs, "1.10", "1.11", [lambda: snapshots.publish(one, path, "1.11"), fail], lambda: done.append(1))
    assert snapshots.run_steps(spark, runs, "1.10", "1.11", [], lambda: done.append(2))
    assert done == [2] and snapshots.read_version(spark, path, "1.11").count() == 1
    assert sorted((r["status"], r["detail"]) for r in spark.read.parquet(runs).collect()) == [("failed", "no reply"), ("success", None)]
    assert not snapshots.on_change("1", "1", fail) and snapshots.on_change(None, "1", done.append)
    with pytest.raises(ValueError, match="version"):
        snapshots.publish(one, path, "../x")


def test_corpus_predicates(spark):
    df = spark.createDataFrame([("S_a", 1, "x", True), ("S_FakeUnit", 2, "x", False), ("S_b", 9, "", None), ("T_c", 3, None, True)], "i string, c int, d string, on boolean")
    kept = df.select(corpus.listed(F.col("i"), "S_", F.col("c"), 1, 5, ["fakeunit"]), corpus.described(F.col("i"), F.col("d")), corpus.with_notice(F.lit("t"), F.col("on"), "!")).collect()
    assert [tuple(r) for r in kept] == [(True, True, "t"), (False, True, "t!"), (False, False, "t"), (False, False, "t")]


def test_search_quotas_caps_and_names(spark):
    rows = [(i, "build" if i % 2 else "item", f"g{i % 3}", i / 10, "OP" if i == 2 else "C", i != 9, f"name{i}") for i in range(10)]
    df = spark.createDataFrame(rows, "id long, kind string, g string, relevance double, tier_rank string, is_active boolean, name string")
    order = search.search_order()
    assert [r["id"] for r in search.search(df, order, 3).collect()] == [2, 8, 7]
    assert [r["id"] for r in search.search(df, order, 9, "kind", ["item"], thresholds={"item": 0.5}).collect()] == [8, 6]
    balanced = search.balanced_search(df, order, "kind", 3, ["item", "build"]).collect()
    assert sorted(r["kind"] for r in balanced) == ["build", "item", "item"]
    capped = search.capped_search(df, order, "g", 1, 5).collect()
    assert len({r["g"] for r in capped}) == len(capped) == 3
    assert {r["id"] for r in search.named_only(df, "kind", "name", F.lit("zzz"), ["item"]).collect()} == {1, 3, 5, 7, 9}
