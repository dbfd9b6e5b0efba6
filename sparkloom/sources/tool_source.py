"""Relations of a JSON-RPC tool server as a Spark data source, format ``tools``.

    spark.dataSource.register(ToolSource)
    spark.read.format("tools").option("url", url).option("relation", "item_builds").option("keys", '["a", "b"]').load()

Keys are dealt out in batches, one task each; a task opens a session of its own, sends
failed requests again, and turns replies into rows of the relation's schema.

Options: ``url``; ``relation`` (one of RELATIONS); ``keys`` (JSON list of strings: the
calls to make; relations that take a language have one call unless told otherwise);
``batch`` (keys in a task, 50); ``prefix`` (of the tools' names); ``retries`` (2),
``backoff`` (1.0) and ``timeout`` (15.0) in seconds.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, LongType, MapType, StringType, StructType

from sparkloom.sources.remote import Session


@dataclass(frozen=True)
class Relation:
    """A tool, the argument that takes a key, default keys, rows of a reply, and their schema.

    ``rows`` gets the reply's payload and the key, and gives a dict for each row.
    """

    tool: str
    argument: str | None
    keys: tuple[str | None, ...]
    rows: Callable[[object, str | None], list[dict]]
    schema: str


def _data(payload, key, **more) -> list[dict]:
    return [{**entry, **more} for entry in payload.get("data", [])]


def _headed(payload, key) -> list[dict]:
    return [dict(zip(payload.get("headers", []), row, strict=True)) | {"lang": key} for row in payload.get("rows", [])]


#: The five relations; tools, arguments and fields are the server's (fixed values).
RELATIONS = {
    "meta_decks": Relation(
        "list_meta_decks", None, (None,), lambda p, k: _data(p, k, observed=(p.get("metadata") or {}).get("gameStatDateTime")),
        "id string, name map<string,string>, stat struct<deck:struct<avgPlacement:double,pickRate:double,winRate:double,top4Rate:double,compsCount:long>,opScore:double>, "
        "units array<struct<key:string,isCore:boolean,items:array<string>,cell:struct<x:int,y:int>,tier:int>>, traits array<struct<key:string,style:int,numUnits:int>>, "
        "badge array<struct<key:string,value:string>>, observed string",
    ),
    "item_combinations": Relation(
        "list_item_combinations", "lang", ("ko_KR",), lambda p, k: _data(p, k, lang=k, set=p.get("set"), version=p.get("version")),
        "lang string, set int, version string, apiName string, name string, category string, composition array<string>, effects map<string,double>, desc string",
    ),
    "augments": Relation("list_augments", "lang", ("ko_KR",), _headed, "lang string, apiName string, name string, tier string, desc string, imageUrl string"),
    "item_builds": Relation(
        "get_champion_item_build", "champion_id", (), lambda p, k: _data(p, k, champion_id=k),
        "champion_id string, itemNames array<string>, itemCount long, totalChampionCount long, avgPlacement double, winRate double",
    ),
    "champions_for_item": Relation(
        "list_champions_for_item", "item_id", (), lambda p, k: [{**entry, "item_id": k} for entry in p],
        "item_id string, characterId string, itemCount long, totalChampionCount long, avgPlacement double, winRate double",
    ),
}


def fit(value, kind: DataType):
    """A JSON value as a value of a Spark type; absent fields are null, other types raise."""
    if value is None:
        return None
    if isinstance(kind, StructType):
        return tuple(fit(value.get(f.name), f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return [fit(v, kind.elementType) for v in value]
    if isinstance(kind, MapType):
        return {k: fit(v, kind.valueType) for k, v in value.items()}
    if isinstance(kind, StringType):
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    if isinstance(kind, DoubleType) and isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    if isinstance(kind, BooleanType) and isinstance(value, bool) or isinstance(kind, (IntegerType, LongType)) and isinstance(value, int) and not isinstance(value, bool):
        return value
    if isinstance(kind, (IntegerType, LongType)) and isinstance(value, float) and value.is_integer():
        return int(value)
    raise ValueError(f"{value!r} is no {kind.simpleString()}")


def payload(body: str, tool: str, key: str | None):
    """What a reply's first text content holds; an error or another form raises with the tool and key."""
    reply = json.loads(body)
    if reply.get("error"):
        raise RuntimeError(f"{tool}({key}): {reply['error']}")
    try:
        return json.loads(reply["result"]["content"][0]["text"])
    except (KeyError, IndexError, TypeError, json.JSONDecodeError) as e:
        raise RuntimeError(f"{tool}({key}): the reply can't be read: {e!r}") from e


class KeyBatch(InputPartition):
    def __init__(self, keys: list[str | None]) -> None:
        super().__init__(None)
        self.keys = keys


class ToolReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.options, self.schema = options, schema
        self.relation = RELATIONS[options["relation"]]

    def partitions(self) -> list[InputPartition]:
        given = self.options.get("keys")
        keys = list(self.relation.keys) if given is None else json.loads(given)
        if given is None and not keys:
            raise ValueError(f"relation {self.options['relation']} needs keys")
        if not isinstance(keys, list) or any(k is not None and not isinstance(k, str) for k in keys):
            raise ValueError("keys must be a JSON list of strings")
        size = int(self.options.get("batch", 50))
        return [KeyBatch(keys[i : i + size]) for i in range(0, len(keys), size)] or [KeyBatch([])]

    def read(self, partition: KeyBatch) -> Iterator[tuple]:
        if not partition.keys:
            return
        o, r = self.options, self.relation
        session = Session(o["url"], int(o.get("retries", 2)), float(o.get("backoff", 1.0)), float(o.get("timeout", 15.0)))
        tool = o.get("prefix", "") + r.tool
        for key in partition.keys:
            found = payload(session.call(tool, {r.argument: key} if r.argument else {}), tool, key)
            for row in r.rows(found, key):
                yield fit(row, self.schema)


class ToolSource(DataSource):
    """Data source ``tools``; the schema follows from the relation."""

    @classmethod
    def name(cls) -> str:
        return "tools"

    def schema(self) -> str:
        if self.options.get("relation") not in RELATIONS:
            raise ValueError(f"relation must be one of {', '.join(RELATIONS)}")
        return RELATIONS[self.options["relation"]].schema

    def reader(self, schema: StructType) -> ToolReader:
        if "url" not in self.options:
            raise ValueError("url is missing")
        return ToolReader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ToolSource)
