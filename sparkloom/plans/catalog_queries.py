"""Queries of landed records, keyed writes, search by kinds, follow-ups and pair scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import similarity, text
from sparkloom.operators import chat, corpus, relational, scoring, search
from sparkloom.plans.registry import query, table
from sparkloom.plans.text_queries import QUERY_TEXT
from sparkloom.sources import decode

_DECK = "id string, name map<string,string>, seen string, units array<struct<number:int,key:string,core:boolean,cell:struct<x:int,y:double>,n:long,total:long>>"


@query("""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_suppkey, l_quantity) AS number FROM lineitem),
second AS (SELECT l_orderkey, l_partkey FROM l WHERE number = 2),
o AS (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 'Ko ' || o_orderkey WHEN 1 THEN o_orderpriority ELSE CAST(o_orderkey AS VARCHAR) END AS name FROM orders)
SELECT o_orderkey, name, CASE WHEN o_orderkey % 4 = 0 THEN TIMESTAMP '2000-01-01 00:00:00' ELSE CAST(o_orderdate AS TIMESTAMP) END AS seen, 'p' || second.l_partkey AS second_key,
  CAST(number AS INTEGER) AS number, 'p' || l.l_partkey AS key, CASE WHEN number % 3 = 0 THEN false ELSE l.l_linenumber % 2 = 1 END AS core, CAST(l.l_linenumber AS INTEGER) AS x, l_extendedprice AS y,
  CASE WHEN l.l_linenumber % 5 = 0 THEN 0.0 ELSE CAST(l.l_linenumber AS DOUBLE) / (l.l_linenumber % 5) END AS share
FROM o JOIN l ON l.l_orderkey = o_orderkey LEFT JOIN second ON second.l_orderkey = o_orderkey
""")
def landed_decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders landed as JSON records with nested lines, read back by field: names, times, entries, shares."""
    unit = F.struct("l_linenumber", "l_partkey", "l_extendedprice", "l_suppkey", "l_quantity")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(unit)).alias("lines"))
    key = F.col("o_orderkey")
    name = F.when(key % 3 == 0, F.create_map(F.lit("en"), F.lit(""), F.lit("ko"), F.concat(F.lit("Ko "), key.cast("string")))).when(key % 3 == 1, F.create_map(F.lit("ko"), F.lit(""), F.lit("en"), "o_orderpriority"))
    units = F.transform("lines", lambda u, i: F.struct(
        (i + 1).alias("number"), F.concat(F.lit("p"), u["l_partkey"].cast("string")).alias("key"), F.when((i + 1) % 3 != 0, u["l_linenumber"] % 2 == 1).alias("core"),
        F.struct(u["l_linenumber"].alias("x"), u["l_extendedprice"].alias("y")).alias("cell"), u["l_linenumber"].alias("n"), (u["l_linenumber"] % 5).alias("total"),
    ))
    seen = F.when(key % 4 == 0, F.lit("soon")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    landed = table(spark, sf_dir, "orders").join(lines, key == F.col("l_orderkey")).select("o_orderkey", F.to_json(F.struct(key.cast("string").alias("id"), name.alias("name"), seen.alias("seen"), units.alias("units"))).alias("body"))
    decks = landed.select("o_orderkey", F.from_json("body", _DECK).alias("d")).select("o_orderkey", "d.*")
    # The language asked for, or the first there is that is not empty, or the id.
    filled = F.map_filter(F.coalesce("name", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda _, v: v != "")
    found = decks.select(
        "o_orderkey", decode.localized(filled, "ko", F.col("id")).alias("name"), decode.timestamp_or(F.col("seen"), F.lit("2000-01-01 00:00:00").cast("timestamp")).cast("timestamp_ntz").alias("seen"),
        decode.pick_entry(F.col("units"), "number", 2)["key"].alias("second_key"), "units",
    )
    each = decode.exploded(decode.require_rows(found, 30), "units", ["o_orderkey", "name", "seen", "second_key"])
    return each.select("o_orderkey", "name", "seen", "second_key", "number", "key", F.coalesce("core", F.lit(False)).alias("core"), "cell.x", "cell.y", decode.share_or_zero(F.col("n").cast("double"), F.col("total")).alias("share"))


@query("""
WITH base AS (SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS content, [c_acctbal] AS vector, true AS is_active FROM customer WHERE c_custkey % 3 <> 0),
incoming AS (SELECT CAST(c_custkey AS BIGINT) AS id, c_name || '!' AS content FROM customer WHERE c_custkey % 2 = 0),
merged AS (
  SELECT coalesce(b.id, i.id) AS id, coalesce(i.content, b.content) AS content, CASE WHEN i.id IS NULL THEN b.vector WHEN b.id IS NULL THEN [-1.0::DOUBLE] END AS vector, coalesce(b.is_active, true) AND i.id IS NOT NULL AS is_active
  FROM base b FULL JOIN incoming i USING (id)),
more AS (SELECT CAST(s_suppkey AS BIGINT) AS id, s_name AS content, [s_acctbal] AS vector, true AS is_active FROM supplier)
SELECT * FROM merged UNION ALL SELECT * FROM more WHERE id NOT IN (SELECT id FROM merged)
""")
def keyed_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents upserted (a changed text loses its vector), those not incoming set inactive, suppliers added where their id is free."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("content"), F.array("c_acctbal").alias("vector"), F.lit(True).alias("is_active"))
    base = customers.filter("id % 3 <> 0")
    incoming = customers.filter("id % 2 = 0").withColumns({"content": F.concat("content", F.lit("!")), "vector": F.array(F.lit(-1.0))})
    merged = relational.merge(base, incoming, ["id"], override={"vector": None})
    marked = relational.deactivate_missing(merged, incoming, ["id"])
    more = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_name").alias("content"), F.array("s_acctbal").alias("vector"), F.lit(True).alias("is_active"))
    return relational.insert_absent(marked, more, ["id"])


_GRAMS = r"flatten(list_transform(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))"


@query(rf"""
WITH d AS (SELECT p_partkey AS id, ['champion', 'augment', 'item'][CAST(p_size % 3 AS INTEGER) + 1] AS kind, p_name AS name, [p_type, p_brand] AS lists, 'the ' || p_name || ' of ' || p_type || ' by ' || p_brand AS content, p_brand AS brand,
             CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN 'OP' WHEN 2 THEN 'B' WHEN 3 THEN 'X' ELSE 'S' END AS tier, CASE p_size % 4 WHEN 0 THEN false WHEN 1 THEN true END AS active FROM part),
q AS (SELECT 'which small blue widgit or hot gear?' AS q),
p AS (
  SELECT t, 'n' AS form, list_distinct({_GRAMS.format("t")}) AS a, {_GRAMS.format("q")} AS b FROM q, (SELECT DISTINCT name AS t FROM d UNION SELECT DISTINCT unnest(lists) FROM d)
  UNION ALL SELECT t, 'c', list_distinct({_GRAMS.format("q")}), {_GRAMS.format("t")} FROM q, (SELECT DISTINCT content AS t FROM d)),
e AS (SELECT t, form, a, b, unnest(range(1, len(b) + 1)) AS i FROM p),
f AS (SELECT t, form, a, b, i, unnest(range(i, len(b) + 1)) AS j FROM e WHERE list_contains(a, b[i])),
x AS (SELECT t, form, len(a) AS na, len(list_distinct(b[i:j])) AS nb, len(list_intersect(a, list_distinct(b[i:j]))) AS k FROM f),
s AS (SELECT t, form, max(CAST(k AS DOUBLE) / (na + nb - k)) AS score FROM x GROUP BY t, form),
r AS (
  SELECT d.*, greatest(coalesce(n.score, 0), 0.9 * (SELECT coalesce(max(l.score), 0) FROM s l WHERE l.form = 'n' AND list_contains(d.lists, l.t)), 0.5 * coalesce(c.score, 0)) AS relevance, coalesce(n.score, 0) AS hit
  FROM d LEFT JOIN s n ON n.form = 'n' AND n.t = d.name LEFT JOIN s c ON c.form = 'c' AND c.t = d.content),
o AS (SELECT *, CASE WHEN NOT coalesce(active, true) THEN 1 ELSE 0 END AS o1, CASE WHEN hit >= 0.6 THEN 0 ELSE 1 END AS o2, CASE tier WHEN 'OP' THEN 0 WHEN 'S' THEN 1 WHEN 'A' THEN 2 WHEN 'B' THEN 3 WHEN 'C' THEN 4 ELSE 5 END AS o3 FROM r),
single AS (SELECT id FROM o WHERE kind = 'item' AND relevance >= 0.45 ORDER BY o1, o2, o3, relevance DESC, id LIMIT 7),
balanced AS (SELECT id, kind, row_number() OVER (PARTITION BY kind ORDER BY o1, o2, o3, relevance DESC, id) AS n FROM o),
capped AS (SELECT id, kind, relevance, row_number() OVER (PARTITION BY brand ORDER BY relevance DESC, id) AS n FROM o),
best AS (SELECT id FROM capped WHERE n <= 2 ORDER BY relevance DESC, id LIMIT 15),
thresholds AS (SELECT id FROM o WHERE kind = 'champion' OR relevance >= 0.45),
letters AS (SELECT id, kind, list_distinct(list_filter(string_split(lower(name), ''), lambda y: trim(y) <> '')) AS l, list_distinct(list_filter(string_split(lower(q), ''), lambda y: trim(y) <> '')) AS m FROM d, q)
SELECT 'single' AS mode, id FROM single
UNION ALL SELECT 'balanced', id FROM balanced WHERE n <= CASE kind WHEN 'champion' THEN 20 WHEN 'augment' THEN 3 ELSE 2 END
UNION ALL SELECT 'capped', id FROM best
UNION ALL SELECT 'thresholds', id FROM thresholds
UNION ALL SELECT 'named', id FROM letters WHERE kind = 'champion' OR len(list_intersect(l, m)) / CAST(len(l) AS DOUBLE) >= 0.8
""")
def search_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as documents of three kinds: one kind, balanced, capped by brand, by thresholds, and by name."""
    size = F.col("p_size")
    kind = F.when(size % 3 == 0, "champion").when(size % 3 == 1, "augment").otherwise("item")
    tier = F.when(size % 5 == 1, "OP").when(size % 5 == 2, "B").when(size % 5 == 3, "X").when(size % 5 == 4, "S")
    content = F.concat(F.lit("the "), "p_name", F.lit(" of "), "p_type", F.lit(" by "), "p_brand")
    docs = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), kind.alias("kind"), F.col("p_name").alias("name"), F.array("p_type", "p_brand").alias("lists"), content.alias("content"), F.col("p_brand").alias("brand"),
        tier.alias("tier_rank"), F.when(size % 4 == 0, F.lit(False)).when(size % 4 == 1, F.lit(True)).alias("is_active"),
    )
    scores = {"relevance": similarity.relevance(QUERY_TEXT, ["name"], ["lists"], "content"), "hit": similarity.word_similarity(F.col("name"), F.lit(QUERY_TEXT))}
    scored = search.scored(docs, ["name", "lists", "content"], scores)
    order, plain = search.search_order(name_score="hit"), [F.col("relevance").desc(), F.col("id")]
    least = {"augment": 0.45, "item": 0.45}
    modes = {
        "single": search.search(scored, order, 7, "kind", ["item"], thresholds=least),
        "balanced": search.balanced_search(scored, order, "kind", 5, ["augment", "item", "champion"], {"champion": 20}),
        "capped": search.capped_search(scored, plain, "brand", 2, 15),
        "thresholds": similarity.with_thresholds(scored, "kind", "relevance", least),
        "named": search.named_only(docs, "kind", "name", F.lit(QUERY_TEXT), ["item", "augment"], 0.8),
    }
    return corpus.corpus([rows.select(F.lit(mode).alias("mode"), "id") for mode, rows in modes.items()])


@query(r"""
SELECT conv_id, turn, regexp_replace(regexp_replace(split_part(replace('- ' || left(text, 20), chr(13), ''), chr(10), 1), '[\s\x0B\x{85}\pZ]+$', ''), '^[-*•\d.)\s]+', '') AS first_question,
  'ask' || CASE WHEN turn % 4 = 0 THEN '' ELSE ' no reasons' END AS instruction,
  CASE WHEN turn % 2 = 0 THEN 'Speed ' || regexp_replace(printf('%.1f', (turn + 0.25) * 100), '\.0$', '') || '%, ' ELSE '' END || 'Health ' || regexp_replace(printf('%.1f', turn * 1.5), '\.0$', '') AS stats FROM conversations
""")
def follow_up_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First follow-up question of raw replies, the rule against reasons by kinds found, and stats in order."""
    turn, start = F.col("turn"), F.substring("text", 1, 20)
    raw = F.concat(F.lit("  \n- "), start, F.lit("\n2. "), "role", F.lit("\n"), "text")
    kinds = F.when(turn % 4 == 0, F.array(F.lit("item"), F.lit("comp"))).when(turn % 4 == 1, F.array(F.lit("item"))).when(turn % 4 == 2, F.array().cast("array<string>"))
    stats = F.create_map(F.lit("hp"), turn * 1.5, F.lit("as"), F.when(turn % 2 == 0, turn + 0.25), F.lit("odd"), F.lit(1.0))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.get(text.follow_ups(raw), F.lit(0)).alias("first_question"), chat.follow_up_prompt(F.lit("ask"), kinds, ["comp", "playstyle"], F.lit(" no reasons")).alias("instruction"),
        text.stat_lines(stats, [("as", "Speed", "fraction"), ("hp", "Health", "flat")]).alias("stats"),
    )


@query("""
WITH c AS (SELECT o_custkey AS k, o_orderpriority AS e, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders GROUP BY ALL),
p AS (SELECT c_custkey AS a, c_custkey + 1 AS b FROM customer),
m AS (SELECT a, b, sum(least(x.n, y.n)) AS common FROM p JOIN c x ON x.k = a JOIN c y ON y.k = b AND y.e = x.e GROUP BY a, b),
s AS (SELECT k AS a, sum(f) / CAST(sum(n) AS DOUBLE) AS concentration FROM c GROUP BY k)
SELECT a, b, CAST(coalesce(common, 0) AS BIGINT) AS common, concentration FROM p LEFT JOIN m USING (a, b) LEFT JOIN s USING (a)
""")
def neighbour_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's and the next one's order priorities in common, and the share of orders that are filled."""
    orders = table(spark, sf_dir, "orders")
    pairs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"))
    of = lambda name: orders.select(F.col("o_custkey").alias(name), "o_orderpriority")
    shares = scoring.concentration(orders.withColumnRenamed("o_custkey", "a"), ["a"], F.col("o_orderstatus") == "F")
    return scoring.multiset_overlaps(pairs, of("a"), of("b"), "a", "b", "o_orderpriority").join(shares, "a", "left")
