import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text, wording
from sparkloom.operators import chat, kpi
from sparkloom.sources import decode, remote


def test_exchanges_pair_questions_with_replies(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "A"), (1, 3, "user", "b"), (1, 4, "user", "c"), (2, 0, "user", None)]
    got = chat.exchanges(spark.createDataFrame(rows, "s int, t int, role string, text string"), "s", "t", "role", "text", n=1).orderBy("s", "t").collect()
    assert [(r["question"], r["answer"], r["first_turn"], r["last_answer"]) for r in got] == [("a", "A", True, None), ("b", None, False, "A"), ("c", None, False, None), (None, None, True, None)]
    assert [[h["question"] for h in r["history"]] for r in got] == [[], ["a"], ["b"], []]


def test_branches_in_order(spark):
    no, yes = F.lit(False), F.lit(True)
    usual = {
        "meta": no, "foreign": no, "off_topic": no, "confirmed": no, "version": F.lit("1"), "asks_version": no, "topics": F.array(), "first_turn": no, "cached": F.lit(None).cast("string"),
        "intent": F.lit("items"), "last_ids": F.array(), "direct": {"web": "web_search"}, "follow_up": "items",
    }
    cases = {
        "search": {}, "refusal": {"off_topic": yes, "confirmed": yes, "version": F.lit(None).cast("string")}, "no_version": {"version": F.lit(None).cast("string"), "asks_version": yes},
        "version": {"asks_version": yes}, "multi_topic": {"topics": F.array(F.lit("a"), F.lit("b"))}, "cached": {"first_turn": yes, "cached": F.lit("x")}, "web_search": {"intent": F.lit("web")},
        "lookup": {"last_ids": F.array(F.lit(1))},
    }
    q = F.lit("question")
    found = spark.range(1).select(*[chat.answer_branch(q, **(usual | c)).alias(n) for n, c in cases.items()]).first().asDict()
    assert found == {n: n for n in cases}
    odd = spark.range(1).select(
        chat.answer_branch(q, **(usual | {"off_topic": yes, "confirmed": F.lit(None).cast("boolean")})), chat.answer_branch(q, **(usual | {"cached": F.lit("x")})),
        chat.answer_branch(F.lit(None).cast("string"), **usual), chat.chosen_intent(F.lit(None).cast("string"), F.lit("junk"), ["web"]), chat.cacheable(yes, no, F.array()), chat.cacheable(yes, no, F.array(F.lit(1))),
    )
    assert tuple(odd.first()) == ("search", "search", "clarify", "general", False, True)


def test_cache_and_prompt(spark):
    asked = spark.createDataFrame([("a",), ("b",), (None,)], "q string")
    cache = asked.filter("q = 'a'").select(text.cache_key(F.col("q"), F.lit("1")).alias("key"), F.lit("hit").alias("answer"))
    assert [r["cached"] for r in chat.with_cached(asked, "q", F.lit("1"), cache).orderBy("q").collect()] == [None, "hit", None]
    lines = chat.prompt([("x", F.array(F.lit("1"), F.lit("2"))), ("none", F.array().cast("array<string>")), ("null", F.lit(None).cast("array<string>"))], F.lit("q"))
    assert spark.range(1).select(lines).first()[0] == "[x]\n1\n2\n\nq"


def test_summary_keeps_each_struct(spark):
    a, b = spark.range(1).select(F.lit(1.5).alias("mean")), spark.range(1).select(F.lit(None).cast("long").alias("n"), F.lit("z").alias("name"))
    rows = kpi.summary(a=a, b=b).collect()
    assert len(rows) == 1 and rows[0].asDict(True) == {"a": {"mean": 1.5}, "b": {"n": None, "name": "z"}}


@pytest.fixture
def server():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            message = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            key = message.get("params", {}).get("arguments", {}).get("id")
            seen.append((message["method"], key, self.headers.get("Mcp-Session-Id")))
            fails = key == "broken" or (key == "late" and sum(k == "late" for _, k, _ in seen) < 3)
            self.send_response(503 if fails else 200)
            self.send_header("Mcp-Session-Id", "s1")
            self.end_headers()
            if not fails:
                self.wfile.write(json.dumps({"result": {"content": [{"text": json.dumps({"got": key})}]}}).encode())

        def log_message(self, *_):
            pass

    running = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{running.server_port}", seen
    running.shutdown()


def test_one_call_for_each_key(spark, server):
    url, seen = server
    keys = spark.createDataFrame([("a",), ("late",), (None,)], "id string").coalesce(1)
    bodies = remote.call_each(keys, "id", url, "tool", "id", backoff=0.01)
    got = bodies.select("id", decode.unwrap_reply(F.col("body"), "got string")["got"].alias("got")).collect()
    assert {(r["id"], r["got"]) for r in got} == {("a", "a"), ("late", "late"), (None, None)}
    assert [m for m, _, _ in seen][:2] == ["initialize", "notifications/initialized"] and sum(k == "late" for _, k, _ in seen) == 3
    assert {s for m, _, s in seen if m == "tools/call"} == {"s1"}
    assert remote.call_each(keys.filter("id = 'x'"), "id", url, "tool", "id").count() == 0
    with pytest.raises(Exception, match="request failed"):
        remote.call_each(keys.select(F.lit("broken").alias("id")), "id", url, "tool", "id", backoff=0.01).collect()
    with pytest.raises(ValueError, match="not an HTTP address"):
        remote.Session("file:///etc/hosts")


def test_wordings_by_hand(spark):
    no = F.array().cast("array<string>")
    members = F.array(F.struct(F.lit("A").alias("name"), F.lit(True).alias("is_carry")), F.struct(F.lit("B").alias("name"), F.lit(False).alias("is_carry")))
    got = spark.range(1).select(
        wording.comp(F.lit("N"), F.lit("S"), F.lit(4.125), F.lit(None).cast("double"), F.lit(0.0125), members, F.lit("fast"), F.lit(False), "!"), wording.champion(F.lit("N"), F.lit(3), no),
        wording.item(F.lit("N"), F.lit("d"), F.lit("")), wording.item(F.lit("N"), F.lit("d"), F.lit("s")), wording.percent(F.lit(0.0625)), wording.filled("{a}-{b}", a=F.lit(1), b=F.lit(None)),
    ).first()
    comp = f"N 조합(티어 S): 평균 등수 {4.125:.2f}, 승률 정보 없음, 픽률 {0.0125:.1%}. 구성: A(캐리), B. fast!"
    assert tuple(got) == (comp, "N(3코스트) 챔피언. 특성: 정보 없음.", "N: d", "N: d (스탯: s)", f"{0.0625:.1%}", None)


def test_follow_up_prompt_and_tiers(spark):
    from sparkloom.operators import search

    df = spark.createDataFrame([(["comp"],), (["item"],), ([],), (None,)], "k array<string>")
    got = [r[0] for r in df.select(chat.follow_up_prompt(F.lit("a"), F.col("k"), ["comp"], F.lit("!"))).collect()]
    assert got == ["a", "a!", "a!", "a!"]
    assert search.checked_tier("OP") == "OP" and search.checked_tier(None) is None
    with pytest.raises(ValueError, match="one of OP, S, A, B, C"):
        search.checked_tier("D")


def test_sections_of_prompts(spark):
    from sparkloom.functions import prompts

    one = lambda c: spark.range(1).select(c).first()[0]
    none = F.array().cast("array<string>")
    assert one(prompts.documents_section(F.lit("17.8"), F.array(F.lit("a"), F.lit(None), F.lit("b")))) == "[검색된 문서] (기준 패치: 17.8)\n- a\n- b"
    assert one(prompts.documents_section(F.lit("17.8"), none)).endswith("\n(검색된 문서 없음)")
    history = lambda *rows: F.array(*[F.struct(F.lit(q).alias("question"), F.lit(a).alias("answer")) for q, a in rows])
    assert one(prompts.history_section(history(("q", "a"), ("r", "b")))) == "[이전 대화]\nQ: q\nA: a\nQ: r\nA: b"
    assert one(prompts.history_section(F.filter(history(("q", "a")), lambda _: F.lit(False)))) is None
    assert one(prompts.facts_section(F.lit("1.2"))) == "[알려진 사실]\n현재 서비스에 반영된 기준 패치는 '1.2' 패치입니다."
    assert one(prompts.facts_section(F.lit(None).cast("string"), F.lit("x"))) is None
    web = F.array(F.struct(F.lit("T").alias("title"), F.lit("C").alias("content"), F.lit("https://a.ok.org/x").alias("url")))
    assert one(prompts.web_section(web, ["ok.org"])) == "[웹 검색 결과]\n- [공식/전문] T: C (출처: https://a.ok.org/x)"
    assert one(prompts.topics_section(F.array(F.lit("a"), F.lit("b")))) == "[요청된 주제]\na, b"
