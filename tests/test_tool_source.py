import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import tool_source

DECK = {
    "id": "d1", "name": {"en_US": "Fast"}, "stat": {"deck": {"avgPlacement": 4, "winRate": 0.21, "compsCount": 12}, "opScore": 7.5},
    "units": [{"key": "c1", "isCore": True, "items": ["i1"], "cell": {"x": 1, "y": 2}, "tier": 3}, {"key": "c2"}], "traits": [{"key": "t", "style": 2, "numUnits": 4}], "badge": [{"key": "level", "value": 8}],
}


def answer(tool, arguments):
    if tool == "x_list_meta_decks":
        return {"data": [DECK, {"id": "d2"}], "metadata": {"gameStatDateTime": "2026-08-07T00:00:00Z"}}
    if tool == "x_list_item_combinations":
        return {"set": 17, "version": "17.8", "data": [{"apiName": f"i-{arguments['lang']}", "composition": ["a", "b"], "effects": {"ad": 10}, "desc": None}]}
    if tool == "x_list_augments":
        return {"headers": ["apiName", "desc", "name", "tier", "imageUrl"], "rows": [["a1", "text", "One", "gold", None]]}
    if tool == "x_get_champion_item_build":
        return {"data": [{"itemNames": [arguments["champion_id"] + str(i)], "itemCount": i, "totalChampionCount": 9, "avgPlacement": 3.5} for i in range(2)]}
    return [{"characterId": "c-" + arguments["item_id"], "winRate": 1}]


@pytest.fixture
def server():
    seen = Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            message = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen[message["method"]] += 1
            key = str(message.get("params", {}).get("arguments"))
            if message["method"] == "tools/call" and "flaky" in key and seen.update([key]) is None and seen[key] < 3:
                return self.send_error(503)
            if message["method"] == "tools/call" and self.headers["Mcp-Session-Id"] != "s1":
                return self.send_error(400)
            body = {"jsonrpc": "2.0", "id": message.get("id"), "result": {}}
            if message["method"] == "tools/call":
                text = "no json" if "garbled" in key else json.dumps(answer(message["params"]["name"], message["params"]["arguments"]))
                body |= {"error": {"code": 1, "message": "unknown"}} if "wrong" in key else {"result": {"content": [{"type": "text", "text": text}]}}
            raw = json.dumps(body).encode()
            self.send_response(200)
            self.send_header("Mcp-Session-Id", "s1")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *_):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}/", seen
    http.shutdown()


def load(spark, server, relation, **options):
    tool_source.register(spark)
    reader = spark.read.format("tools").options(url=server[0], relation=relation, prefix="x_", backoff="0.01", **options)
    return reader.load()


def test_five_relations_with_their_schemas(spark, server):
    decks = {r["id"]: r for r in load(spark, server, "meta_decks").collect()}
    one = decks["d1"]
    assert (one["stat"]["deck"]["avgPlacement"], one["stat"]["deck"]["pickRate"], one["stat"]["opScore"], one["name"]) == (4.0, None, 7.5, {"en_US": "Fast"})
    assert one["units"][0]["cell"]["y"] == 2 and one["units"][1]["items"] is None and one["badge"][0]["value"] == "8" and one["observed"] == "2026-08-07T00:00:00Z"
    assert decks["d2"]["units"] is None
    items = load(spark, server, "item_combinations", keys='["ko_KR", "en_US"]')
    assert sorted((r["lang"], r["apiName"], r["set"], r["version"], r["effects"]["ad"]) for r in items.collect()) == [("en_US", "i-en_US", 17, "17.8", 10.0), ("ko_KR", "i-ko_KR", 17, "17.8", 10.0)]
    assert [tuple(r) for r in load(spark, server, "augments").collect()] == [("ko_KR", "a1", "One", "gold", "text", None)]
    builds = load(spark, server, "item_builds", keys=json.dumps([f"c{i}" for i in range(7)]), batch="3")
    assert builds.rdd.getNumPartitions() == 3
    assert {(r["champion_id"], r["itemNames"][0], r["itemCount"]) for r in builds.collect()} == {(f"c{i}", f"c{i}{n}", n) for i in range(7) for n in range(2)}
    assert [tuple(r)[:2] + (r["winRate"],) for r in load(spark, server, "champions_for_item", keys='["i9"]').collect()] == [("i9", "c-i9", 1.0)]


def test_retries_sessions_and_errors(spark, server):
    flaky = load(spark, server, "item_builds", keys='["flaky", "b", "c", "d"]', batch="2")
    assert flaky.agg(F.countDistinct("champion_id")).first()[0] == 4
    assert server[1]["initialize"] == 2 and server[1]["tools/call"] == 6
    for key, said in (("wrong", "unknown"), ("garbled", "can't be read"), ("flaky2", "request failed")):
        with pytest.raises(Exception, match=said):
            load(spark, server, "item_builds", keys=json.dumps([key]), retries="0").collect()
    assert load(spark, server, "item_builds", keys="[]").collect() == []
    for bad in ({"relation": "nothing"}, {"relation": "item_builds"}, {"relation": "item_builds", "keys": '"a"'}):
        with pytest.raises(Exception, match="must be|needs keys"):
            load(spark, server, bad.pop("relation"), **bad).collect()


def test_values_of_another_type_raise():
    from pyspark.sql.types import LongType, StructType

    with pytest.raises(ValueError, match="no bigint"):
        tool_source.fit("12", LongType())
    assert tool_source.fit({"n": 3.0}, StructType.fromDDL("n int, s string")) == (3, None)
