"""Operators against values worked out by hand and against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import similarity, text
from sparkloom.operators import kpi, ranking, relational, scoring, search, tiering
from sparkloom.streaming.limits import fixed_window_limit


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_word_similarity_calibration(spark):
    ws = lambda a, b: one(spark, similarity.word_similarity(F.lit(a), F.lit(b)))
    assert ws("아리", "아리를 쓰는 조합 추천") == pytest.approx(2 / 3)
    assert ws("공허 건틀릿", "보석 건틀릿 효과는?") == pytest.approx(4 / 7)
    assert ws("red gear", "where is a red gear now") == 1.0 and ws("", "a") == 0.0 and ws("a", "?!") == 0.0
    assert one(spark, similarity.word_similarity(F.lit(None).cast("string"), F.lit("a"))) is None


def test_long_similarity_equals_short(spark):
    rng = random.Random(3)
    pairs = [("".join(rng.choices("ab c", k=rng.randint(0, 8))), "".join(rng.choices("abc d", k=rng.randint(0, 20)))) for _ in range(60)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity.word_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    for r in rows:
        assert similarity.best_stretch(r["a"], r["b"]) == pytest.approx(r["s"])


@pytest.mark.parametrize(
    ("scores", "tiers"),
    [
        ([1.5], ["A"]),
        ([3.0] * 5, ["OP"] * 5),
        ([2.221, 2.0, 0.953, 0.893, 0.442, 0.432, 0.402, 0.252, 0.234, 0.209], ["OP"] * 2 + ["S"] * 2 + ["A"] * 6),
        ([60.003, 59.003, 58.003, 57.003, 56.003, 55.003, 54.003, 54.002, 54.001, 54.0], ["OP", "S", "A", "B"] + ["C"] * 6),
    ],
)
def test_tiers(spark, scores, tiers):
    df = spark.createDataFrame(list(enumerate(scores)), "i int, s double")
    assert [r["tier"] for r in tiering.gap_tiers(df, "s", "i").orderBy("i").collect()] == tiers


def test_tiers_without_score(spark):
    got = tiering.gap_tiers(spark.createDataFrame([(0, None), (1, 2.0), (2, 0.2)], "i int, s double"), "s", "i").orderBy("i").collect()
    assert got[0]["tier"] == "C" and got[1]["tier"] != "C"
    assert tiering.gap_tiers(spark.createDataFrame([], "i int, s double"), "s", "i").count() == 0


def test_percentiles_and_mean(spark):
    df = spark.createDataFrame([(1000.0, False), (2000.0, False), (3000.0, True)], "v double, cold boolean")
    assert kpi.interp_percentiles(df, "v", {"p": 0.5}, ~F.col("cold")).first()["p"] == 1500.0
    assert kpi.interp_percentiles(df, "v", {"p": 0.95}).first()["p"] == pytest.approx(2900.0)
    runs = spark.createDataFrame([(30, "success"), (90, "success"), (999, "failed")], "m int, s string")
    assert tuple(kpi.filtered_mean(runs, F.col("m"), F.col("s") == "success").first()) == (60.0, 2)
    assert tuple(kpi.filtered_mean(runs, F.col("m"), F.col("s") == "none").first()) == (None, 0)


def test_funnel_counts_actions(spark):
    shown, acts = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,), (3,)], "k int")
    assert tuple(kpi.funnel(shown, acts, ["k"]).first()) == (2, 1, 50.0)
    assert tuple(kpi.funnel(shown.limit(0), acts, ["k"]).first()) == (0, 0, None)


def test_cohort(spark):
    now = dt.datetime(2026, 8, 3)
    days = lambda n: now - dt.timedelta(days=n)
    rows = [("a", "link", days(40)), ("a", "ask", days(35)), ("b", "link", days(100))]
    events = spark.createDataFrame(rows, "u string, e string, t timestamp_ntz")
    got = kpi.converted_within(events, "u", "t", F.col("e") == "link", F.col("e") == "ask", [720, 2160], F.lit(now).cast("timestamp_ntz"))
    assert {r["hours"]: (r["eligible"], r["percent"]) for r in got.collect()} == {720: (2, 50.0), 2160: (1, 0.0)}


def test_lookup_keeps_order_and_empty_arrays(spark):
    df = spark.createDataFrame([(1, ["b", "x", "a", "b"]), (2, []), (3, None)], "k int, l array<string>")
    dim = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, name string")
    get = lambda how: {r["k"]: r["n"] for r in relational.lookup_array(df, "l", dim, "id", "name", "n", ["k"], how).collect()}
    assert get("key") == {1: ["B", "x", "A", "B"], 2: [], 3: []}
    assert get("null")[1] == ["B", None, "A", "B"] and get("drop")[1] == ["B", "A", "B"]


def test_merge_and_deactivate(spark):
    base = spark.createDataFrame([(1, "a", 10, False), (2, "b", 20, True)], "k int, n string, id int, is_active boolean")
    new = spark.createDataFrame([(1, "A", 99, False), (3, "c", 30, True)], "k int, n string, id int, is_active boolean")
    got = relational.merge(base, new, ["k"], keep=["id"], override={"is_active": True})
    assert sorted(map(tuple, got.collect())) == [(1, "A", 10, True), (2, "b", 20, True), (3, "c", 30, True)]
    with pytest.raises(Exception, match="occurs twice"):
        relational.merge(base, new.union(new), ["k"]).collect()
    stale = relational.deactivate_missing(got, new, ["k"])
    assert {r["k"]: r["is_active"] for r in stale.collect()} == {1: True, 2: False, 3: True}


def test_quotas_and_caps(spark):
    assert ranking.split_quota(7, ["a", "b", "c"]) == {"a": 3, "b": 2, "c": 2}
    with pytest.raises(ValueError):
        ranking.top_n_per_group(spark.range(1), ["id"], [F.col("id")], 1)


def test_jaccard(spark):
    left = spark.createDataFrame([(1, c) for c in "abcde"], "l int, e string")
    right = spark.createDataFrame([(7, "a", 2), (7, "b", 2), (7, "c", 1), (7, "d", 1), (7, "e", 1), (8, "a", 2), (8, "z", 1)], "r int, e string, w int")
    got = scoring.best_match(scoring.weighted_jaccard(left, right, "l", "r", "e", "w"), "l", "r").first()
    assert (got["r"], got["similarity"], got["deviation"], got["bin"]) == (7, 1.0, 0.0, 0)


def test_last_by_key_with_null_order(spark):
    rows = spark.createDataFrame([(1, None, "x"), (1, 5, "y"), (1, 4, "z"), (2, None, "only"), (None, 1, None)], "k int, at int, v string")
    got = relational.last_by_key(rows, ["k"], F.col("at")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 5, "y"), (2, None, "only"), (None, 1, None)], key=str)


@pytest.mark.parametrize(("least", "at_once"), [(0.0, 40), (0.35, 40), (0.35, 1 << 20), (1.0, 40)])
def test_jaccard_with_a_hot_element(spark, least, at_once):
    rng = random.Random(11)
    pick = lambda: {"hot"} | set(rng.sample("abcdefghijklmnop", rng.randint(0, 6)))
    left = {i: pick() for i in range(60)}
    right = {i: {e: rng.randint(1, 3) for e in (pick() | ({f"own{i}"} if i % 4 == 0 else set()))} for i in range(40)}
    left[60], right[40] = {"lone"}, {"other": 2}
    want = {}
    for i, x in left.items():
        for j, y in right.items():
            both = x & y.keys()
            likeness = sum(y[e] for e in both) / (sum(y.values()) + len(x - both))
            if both and likeness >= least:
                want[i, j] = pytest.approx(likeness)
    lefts = spark.createDataFrame([(i, e) for i, x in left.items() for e in x] + [(61, None)], "l int, e string")
    rights = spark.createDataFrame([(j, e, w) for j, y in right.items() for e, w in y.items()] + [(41, None, 1)], "r int, e string, w int")
    got = scoring.weighted_jaccard(lefts, rights, "l", "r", "e", "w", least, at_once).collect()
    assert len(got) == len(want) and {(r["l"], r["r"]): r["similarity"] for r in got} == want
    assert scoring.weighted_jaccard(lefts.limit(0), rights, "l", "r", "e", "w", least, at_once).isEmpty()


def test_jaccard_deals_pairs_of_an_element(spark):
    left = spark.range(900).select(F.col("id").alias("l"), F.lit("hot").alias("e"))
    right = spark.range(50).select(F.col("id").alias("r"), F.lit("hot").alias("e"), F.lit(1).alias("w"))
    met = scoring._meeting(left, right, "l", "r", "e", 1000)
    assert met.distinct().count() == met.count() == 900 * 50
    alone = spark.range(900).select(F.col("id").alias("l"), F.concat(F.lit("own"), "id").alias("e"))
    rare = scoring._rare_part(left.union(alone.limit(50)), right.union(right.select("r", F.concat(F.lit("own"), "r").alias("e"), F.lit(9).alias("w"))), "r", "e", "w", 0.5)
    assert {r["e"] for r in rare.collect()} == {f"own{i}" for i in range(50)}


def test_rate_limit(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randint(0, 400))) for i in range(200)]
    got = fixed_window_limit(spark.createDataFrame(rows, "i int, k string, t timestamp"), "k", "t", "i", 10, 60).collect()
    for k in "ab":
        start, n = None, 0
        for i, _, t in sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0])):
            if start is None or t - start >= dt.timedelta(seconds=60):
                start, n = t, 0
            n += 1
            mine = next(r for r in got if r["i"] == i)
            assert (mine["seen"], mine["allowed"]) == (n, n <= 10)


def test_text_functions(spark):
    c = lambda s: F.lit(s)
    assert one(spark, text.clean_markup(c("  a<br>b<BR/>@x@<i>c</i>\n\n\n\nd\u3000"))) == "a\nb\n?c\n\nd"
    assert one(spark, text.fill_glossary(c("{{A}} {{B}}"), {"A": "one"})) == "one "
    assert one(spark, text.mask_rate(c("win rate is 55.5% now"), "win rate", "[hidden]")) == "[hidden] now"
    assert one(spark, text.warn_ungrounded(c("use 'x' and 'y'"), F.array(c("x")), "check")) == "use 'x' and 'y'\n\ncheck"
    assert one(spark, text.ids_in_order(c("/c/5 /c/3 /c/5"), r"/c/(\d+)")) == [5, 3]
    assert one(spark, text.host(c("HTTP://u@WWW.Ex.com:80/a"))) == "ex.com" and one(spark, text.allowed_host(c("http://a.ex.com"), ["ex.com"]))
    assert one(spark, text.follow_ups(c("\n- one\n2. two"))) == ["one"]
    assert one(spark, text.plain_number(F.lit(1234.565), 2)) == f"{1234.565:.2f}"
    assert [tuple(x) for x in one(spark, text.parse_sse(text.sse_frames(F.array(c("a\nb"), c("c")))))] == [("message", "a\nb"), ("message", "c"), ("done", "[DONE]")]
    assert one(spark, text.stat_lines(F.create_map(c("hp"), F.lit(10.0), c("as"), F.lit(0.255)), [("as", "Speed", "fraction"), ("hp", "Health", "flat")])) == "Speed 25.5%, Health 10"


@pytest.mark.parametrize(("tail", "common"), [(64, 64), (3, 2)])
def test_alike_sets_are_measured_where_they_meet(spark, monkeypatch, tail, common):
    monkeypatch.setattr(scoring, "TAIL", tail)
    monkeypatch.setattr(scoring, "COMMON", common)
    rng = random.Random(5)
    sets = {i: set(rng.sample(range(30), rng.randint(1, 12))) for i in range(120)}
    weight = lambda e: 1 + e % 3
    want = {}
    for i, x in sets.items():
        for j, y in sets.items():
            likeness = sum(map(weight, x & y)) / (sum(map(weight, y)) + len(x - y))
            if likeness >= 0.4:
                want[i, j] = pytest.approx(likeness)
    left = spark.createDataFrame([(i, e) for i, x in sets.items() for e in x], "l long, e long")
    right = left.select(F.col("l").alias("r"), "e", (1 + F.col("e") % 3).alias("w"))
    found = scoring.weighted_jaccard(left, right, "l", "r", "e", "w", 0.4)
    got = found.collect()
    assert len(got) == len(want) and {(r["l"], r["r"]): r["similarity"] for r in got} == want
    # Unless a tail is cut off, no pair is joined with its sets again.
    assert tail < 12 or "Join" not in found._jdf.queryExecution().toString()


def test_alike_rows_are_scored_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def slow(name):
        calls.add(1)
        return None if name is None else float(len(name))

    names = ["ring", None, "bolt", ""]
    docs = spark.createDataFrame([(i, names[i % 4], [names[i % 2]]) for i in range(400)], "id long, name string, lists array<string>")
    rows = search.scored(docs, ["name", "lists"], {"score": slow("name")})
    for _ in range(2):
        assert sorted((r["id"], r["score"]) for r in rows.collect()) == [(i, None if i % 4 == 1 else float(len(names[i % 4]))) for i in range(400)]
    assert calls.value == 4 and rows.columns == ["id", "name", "lists", "score"]
