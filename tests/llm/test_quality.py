"""Host rates and verdicts, and odd rows."""

import re
from collections import Counter

from sparkloom.llm import quality, queries

FINE = " ".join(f"w{i}" for i in range(60))
NOISY = FINE + " #" * 60


def rates(spark, hosts):
    rows = [(h, i < f) for h, (n, f) in hosts.items() for i in range(n)]
    return {r["_host"]: r["host_fail_rate"] for r in quality.host_rates(spark.createDataFrame(rows, "_host string, _failed boolean")).collect()}


def test_one_bad_host_among_clean_ones(spark):
    got = rates(spark, {"bad": (100, 100)} | {f"good{i}": (100, 0) for i in range(9)})
    assert got.pop("bad") == 1.0 and set(got.values()) == {0.0}
    got = rates(spark, {"bad": (100, 100), "a": (100, 5), "b": (100, 5)})
    assert got == {"bad": 1.0, "a": 0.05, "b": 0.05}


def test_documents_of_a_bad_host_go(spark):
    fine = " ".join(f"w{i}" for i in range(60))
    rows = [(i, fine + " #" * 60 if h == 0 else fine, f"h{h}.org") for h in range(10) for i in range(100 * h, 100 * h + 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(r["doc_id"] for r in quality.keep_good(df).collect()) == list(range(100, 1000))


def test_hosts_alike_get_the_mean(spark):
    got = rates(spark, {f"h{i}": (10, 5) for i in range(6)})
    assert set(got.values()) == {0.5}
    got = rates(spark, {"a": (100, 10), "b": (100, 30)})
    assert 0.1 < got["a"] < 0.2 < got["b"] < 0.3


def planted(spark):
    """Nine ordinary hosts, one that fails often, one a little more than the rest."""
    share = {"bad.org": 70, "worse.org": 20} | {f"h{i}.org": 10 for i in range(9)}
    rows = [(200 * k + i, NOISY if i % 100 < bad else FINE, f"https://www.{host}/a{i}") for k, (host, bad) in enumerate(share.items()) for i in range(200)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_planted_hosts_decide(spark):
    rows = quality.judge(planted(spark)).collect()
    assert not any(r["base_failed"] for r in rows)
    verdict = {r["host"]: r["host_verdict"] for r in rows}
    assert verdict.pop("bad.org") == "bad" and verdict.pop("worse.org") == "watched" and set(verdict.values()) == {"good"}
    gone = Counter(r["host"] for r in rows if not r["kept"])
    assert gone == {"bad.org": 200, "worse.org": 40}


def test_stage_and_query_agree(spark):
    df = planted(spark)
    want = {r["doc_id"] for r in quality.judge(df).collect() if r["kept"]}
    assert {r["doc_id"] for r in quality.keep_good(df).collect()} == want
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    judged = queries.QUERIES["op2_quality_rules"](spark, "/root/testdata/sf0.1").collect()
    assert any(r["kept"] == r["base_failed"] for r in judged)
    assert sorted(r["doc_id"] for r in quality.keep_good(docs).collect()) == sorted(r["doc_id"] for r in judged if r["kept"])


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.sub(r"[^#*$%&|<>]", "", text or "")), len(lines) - len(set(lines)), len(covered)


def test_odd_rows(spark):
    texts = [None, "", " \n\t", "a b c a b c", "x " * 30_000, "\n".join(["same line"] * 40), "é\u00a0é ü" * 30, FINE, FINE, NOISY, "a" * 200_000]
    rows = [(i, t, "h.org" if i in (7, 8) else None, "s", "host", True, 1.0, "row", "v") for i, t in enumerate(texts)] + [(None, FINE, " ", "s", "host", True, 1.0, "row", "v")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, s string, _host string, _failed boolean, `a.b` double, row string, verdict string")
    got = quality.judge(df).collect()
    assert len(got) == len(rows)
    signal = {r["doc_id"]: tuple(r)[1:6] for r in got if r["doc_id"] is not None}
    assert signal == {i: plain(t) for i, t in enumerate(texts)}
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in df.collect() if r["doc_id"] in (7, 8, 9) or r["doc_id"] is None)
    assert quality.judge(df.limit(0)).count() == quality.keep_good(df.limit(0)).count() == 0
