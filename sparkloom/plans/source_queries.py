"""Queries of the sources, the version store and the search documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import wording
from sparkloom.operators import corpus
from sparkloom.plans.registry import query, table
from sparkloom.sources import decode, events, incremental, snapshots


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def reply_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers packed as tool replies and unwrapped."""
    payload = F.to_json(F.struct("c_custkey", "c_mktsegment", "c_acctbal"))
    content = F.struct(F.array(F.struct(payload.alias("text"))).alias("content"))
    body = F.to_json(F.struct(content.alias("result")))
    customers = table(spark, sf_dir, "customer").select(body.alias("body"))
    reply = decode.unwrap_reply(F.col("body"), "c_custkey long, c_mktsegment string, c_acctbal double")
    return customers.select(reply.alias("r")).select("r.*")


@query("SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation")
def headers_rows_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of headers and rows, one per nation, as columns."""
    nations = table(spark, sf_dir, "nation")
    rows = decode.table_rows(F.array(F.lit("id"), F.lit("name")), F.array(F.array(F.col("n_nationkey").cast("string"), F.col("n_name"))))
    cells = nations.select("n_nationkey", F.explode(rows).alias("r"))
    return cells.select("n_nationkey", F.col("r")["id"].alias("id"), F.col("r")["name"].alias("name"))


@query("SELECT o_orderkey, o_totalprice, '1.10' AS version FROM orders WHERE o_orderstatus <> 'O'")
def snapshot_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions published, the second promoted after a failed run; readers take it."""
    path = snapshots.shared_folder(spark, "orders")
    log, runs = f"{path}-promotions", f"{path}-runs"
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    closed = orders.filter("o_orderstatus <> 'O'").drop("o_orderstatus")

    def promote(version: str):
        return lambda: snapshots.promote(spark, log, version, [path])

    snapshots.run_steps(spark, runs, None, "1.9", [lambda: snapshots.publish(orders.drop("o_orderstatus"), path, "1.9")], promote("1.9"))
    snapshots.run_steps(spark, runs, "1.9", "1.10", [], promote("1.10"))  # not published yet: stays at 1.9
    snapshots.run_steps(spark, runs, "1.9", "1.10", [lambda: snapshots.publish(closed, path, "1.10")], promote("1.10"))
    return snapshots.read_version(spark, path, snapshots.current_version(spark, log))


@query("""
WITH best AS (
  SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem)
SELECT 'part' AS doc_type, 'part' AS source_table, CAST(p_partkey AS BIGINT) AS source_id,
       p_name || ' (' || p_brand || ')' || CASE WHEN p_size > 25 THEN ' [large]' ELSE '' END AS content_text, p_name AS name, p_size <= 25 AS is_active, NULL AS items FROM part
UNION ALL
SELECT 'customer', 'customer', c_custkey, c_name || ': ' || c_mktsegment, c_name, NULL, NULL FROM customer
WHERE starts_with(c_name, 'Customer') AND c_acctbal BETWEEN 0 AND 5000 AND NOT regexp_matches(lower(c_name), '13|77')
UNION ALL
SELECT 'line', 'lineitem', l_orderkey, coalesce(p_name, CAST(l_partkey AS VARCHAR)), NULL, NULL, coalesce(p_name, CAST(l_partkey AS VARCHAR))
FROM best LEFT JOIN part ON l_partkey = p_partkey WHERE rank <= 10
""")
def corpus_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a notice, listed customers, and the ten dearest lines of a part, as one corpus."""
    parts, customers = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    small = F.col("p_size") <= 25
    text = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", F.array("l_partkey").alias("items"))
    order = [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")]
    best = corpus.top_builds(lines, "l_partkey", order, 10, "items", parts, "p_partkey", "p_name", ["l_partkey", "rank"])  # a line number may occur twice in an order
    names = F.array_join("item_names", ", ")
    wanted = corpus.listed(F.col("c_name"), "Customer", F.col("c_acctbal"), 0, 5000, ["13", "77"])
    return corpus.corpus([
        corpus.branch(parts, "part", "part", "p_partkey", corpus.with_notice(text, small, " [large]"), name=F.col("p_name"), is_active=small),
        corpus.branch(customers.filter(wanted), "customer", "customer", "c_custkey", F.concat_ws(": ", "c_name", "c_mktsegment"), name=F.col("c_name")),
        corpus.branch(best, "line", "lineitem", "l_orderkey", names, items=names),
    ])


@query("""
WITH p AS (SELECT *, p_retailprice / 1000 AS place, CASE WHEN p_size % 2 = 1 THEN p_size / CAST(97 AS DOUBLE) END AS win, p_size / CAST(61 AS DOUBLE) AS play,
  CASE WHEN p_size > 10 THEN '' ELSE ' (old)' END AS notice, CASE WHEN p_size % 3 = 0 THEN '정보 없음' ELSE p_brand || ', ' || p_type END AS listing FROM part)
SELECT 'comp' AS doc_type, p_partkey AS source_id, p_name || ' 조합(티어 ' || p_size || '): 평균 등수 ' || printf('%.2f', place) || ', 승률 ' || coalesce(printf('%.1f%%', win * 100), '정보 없음')
  || ', 픽률 ' || printf('%.1f%%', play * 100) || '. 구성: ' || p_brand || CASE WHEN p_size > 25 THEN '(캐리)' ELSE '' END || ', ' || p_type || '. ' || p_type || notice AS content_text FROM p
UNION ALL SELECT 'playstyle', p_partkey, p_name || ' 조합 플레이 스타일: ' || p_type || notice FROM p
UNION ALL SELECT 'augment', p_partkey, p_name || '(' || p_brand || ' 등급) 증강체: ' || p_type FROM p
UNION ALL SELECT 'champion', p_partkey, p_name || '(' || p_size || '코스트) 챔피언. 특성: ' || listing || '.' FROM p
UNION ALL SELECT 'item', p_partkey, p_name || ': ' || p_type || CASE WHEN p_size % 5 = 0 THEN '' ELSE ' (스탯: ' || p_brand || ')' END FROM p
UNION ALL SELECT 'item_build', p_partkey, p_name || ' 아이템 빌드: ' || listing || '. 승률 ' || printf('%.1f%%', play * 100) || ', 픽률 ' || printf('%.1f%%', play * 100) || ', 평균 등수 ' || printf('%.2f', place) FROM p
""")
def document_wordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part worded as each of the six kinds of search document."""
    parts = table(spark, sf_dir, "part")
    name, size, kind, brand = (F.col(f"p_{c}") for c in ("name", "size", "type", "brand"))
    place, win, play, active = F.col("p_retailprice") / 1000, F.when(size % 2 == 1, size / F.lit(97.0)), size / F.lit(61.0), size > 10
    members = F.array(F.struct(brand.alias("name"), (size > 25).alias("is_carry")), F.struct(kind.alias("name"), F.lit(False).alias("is_carry")))
    some = F.when(size % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(brand, kind))
    worded = {
        "comp": wording.comp(name, size, place, win, play, members, kind, active, " (old)"), "playstyle": wording.playstyle(name, kind, active, " (old)"), "augment": wording.augment(name, brand, kind),
        "champion": wording.champion(name, size, some), "item": wording.item(name, kind, F.when(size % 5 == 0, F.lit("")).otherwise(brand)), "item_build": wording.item_build(name, some, play, play, place),
    }
    return corpus.corpus([corpus.branch(parts, k, "part", "p_partkey", text) for k, text in worded.items()]).drop("source_table")


@query("""
WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS source_id, CASE p_size % 3 WHEN 0 THEN 'comp' WHEN 1 THEN 'playstyle' ELSE 'item' END AS doc_type, p_name AS content, p_retailprice AS price FROM part)
SELECT doc_type, source_id, CASE WHEN doc_type <> 'item' AND source_id % 7 = 0 AND source_id % 11 <> 0 THEN content || ' (new)' ELSE content END AS content,
  price, doc_type = 'item' OR source_id % 11 <> 0 OR source_id % 13 = 0 AS is_active FROM p WHERE source_id % 13 <> 0 OR doc_type <> 'item' AND source_id % 11 <> 0
""")
def incremental_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of two kinds refreshed in place, new ones added and missing ones set inactive; the third kind stays."""
    kind = F.when(F.col("p_size") % 3 == 0, "comp").when(F.col("p_size") % 3 == 1, "playstyle").otherwise("item")
    docs = table(spark, sf_dir, "part").select(kind.alias("doc_type"), F.col("p_partkey").cast("long").alias("source_id"), F.col("p_name").alias("content"), F.col("p_retailprice").alias("price"), F.lit(True).alias("is_active"))
    path, keys = snapshots.shared_folder(spark, "refreshed"), ["doc_type", "source_id"]
    incremental.publish(docs.filter("source_id % 13 <> 0"), path, "1.1", keys)
    renamed = F.when(F.col("source_id") % 7 == 0, F.concat("content", F.lit(" (new)"))).otherwise(F.col("content"))
    upstream = docs.filter("source_id % 11 <> 0").withColumn("content", renamed)
    incremental.refresh(spark, path, "1.1", upstream, keys, "doc_type", ["comp", "playstyle"], {"is_active": F.lit(False)})
    return incremental.read(spark, path, "1.1", keys)


@query("""
SELECT CAST(user_id AS VARCHAR) AS session_id, event_type AS intent, [event_id] AS doc_ids, CAST(floor(value * 200) AS BIGINT) AS latency_ms, CAST(floor(value * 200) AS BIGINT) >= 10000 AS cold_start, ts AS created_at,
       CASE WHEN event_type = 'view' THEN 'views' ELSE 'rest' END AS source FROM events
""")
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended to a log by two sources; every batch comes twice."""
    path, kind = snapshots.shared_folder(spark, "chat-log"), F.col("event_type")
    given = table(spark, sf_dir, "events").select(
        "event_type", F.col("user_id").cast("string").alias("session_id"), kind.alias("intent"), F.array("event_id").alias("doc_ids"), F.floor(F.col("value") * 200).alias("latency_ms"), F.col("ts").alias("created_at")
    )
    for _ in range(2):
        for source, which in (("views", kind == "view"), ("rest", (kind != "view") | kind.isNull())):
            events.append_batch(events.log_rows(given.filter(which), events.CHAT_LOG, "created_at"), path, source, 0)
    return events.read_log(spark, path, events.CHAT_LOG).select("session_id", "intent", "doc_ids", "latency_ms", "cold_start", F.col("created_at").cast("timestamp_ntz").alias("created_at"), "source")
