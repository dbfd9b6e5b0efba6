"""Queries of the relational operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import ranking, relational, scoring, search
from sparkloom.plans.registry import query, table


@query("""
SELECT l_partkey, p_name, l_orderkey, l_linenumber, l_extendedprice, rank FROM (
  SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice,
         CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS INTEGER) AS rank
  FROM lineitem) JOIN part ON l_partkey = p_partkey
WHERE rank <= 10
""")
def top_n_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    order = [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")]
    top = ranking.top_n_per_group(lines, ["l_partkey"], order, 10)
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return top.join(parts, top.l_partkey == parts.p_partkey).select("l_partkey", "p_name", "l_orderkey", "l_linenumber", "l_extendedprice", "rank")


@query("""
SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders
WHERE o_orderstatus = (SELECT arg_max(o_orderstatus, (o_orderdate, o_orderkey)) FROM orders) AND o_orderpriority IN ('1-URGENT', '2-HIGH')
""")
def filter_project_default_param(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    newest = orders.agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("s")).first()["s"]
    return orders.filter((F.col("o_orderstatus") == newest) & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_totalprice", "o_orderstatus")


@query("SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS c_acctbal FROM customer")
def conditional_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal")).alias("c_acctbal"))


@query("""
SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders
ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 5 END, o_totalprice DESC, o_orderkey LIMIT 20
""")
def case_priority_sort_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("o_orderpriority")
    place = F.when(kind == "1-URGENT", 0).when(kind == "2-HIGH", 1).otherwise(5)
    return table(spark, sf_dir, "orders").orderBy(place, F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("""
WITH t AS (
  SELECT p_partkey, p_retailprice, ['OP', 'S', 'A', 'B', 'C', 'D', NULL][1 + p_partkey % 7] AS tier_rank,
         CASE WHEN p_partkey % 11 > 0 THEN p_partkey % 5 > 0 END AS is_active FROM part)
SELECT p_partkey, tier_rank, is_active, p_retailprice FROM t
ORDER BY CASE WHEN NOT is_active THEN 1 ELSE 0 END, CASE tier_rank WHEN 'OP' THEN 0 WHEN 'S' THEN 1 WHEN 'A' THEN 2 WHEN 'B' THEN 3 WHEN 'C' THEN 4 ELSE 5 END, p_retailprice DESC, p_partkey LIMIT 200
""")
def tier_order_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 parts that a search shows first: active, by tier, then by price."""
    tiers = F.array(*[F.lit(x) for x in ("OP", "S", "A", "B", "C", "D", None)])
    key = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", tiers[(key % 7).cast("int")].alias("tier_rank"), F.when(key % 11 > 0, key % 5 > 0).alias("is_active"), "p_retailprice"
    )
    return search.search(parts, search.search_order("p_retailprice", "p_partkey"), 200)


@query("""
SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0
""")
def inner_join_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").filter("c_acctbal > 0")
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("c_custkey", "n_name", "r_name")


@query("""
SELECT o_orderkey, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey), '') AS parts
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey
""")
def collect_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    found = relational.collect_children(orders, lines, ["o_orderkey"], ["l_linenumber"], "l_partkey", "parts")
    return found.select("o_orderkey", F.array_join(F.transform("parts", lambda x: x.cast("string")), ",").alias("parts"))


def _baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    return lines.select("l_orderkey", F.transform("l", lambda x: x["l_partkey"]).alias("keys"))


@query("""
SELECT l_orderkey, string_agg(coalesce(p_name, CAST(l_partkey AS VARCHAR)), '|' ORDER BY l_linenumber, l_partkey) AS names
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 25) ON p_partkey = l_partkey GROUP BY l_orderkey
""")
def array_lookup_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = table(spark, sf_dir, "part").filter("p_size <= 25")
    found = relational.lookup_array(_baskets(spark, sf_dir), "keys", dim, "p_partkey", "p_name", "names", ["l_orderkey"])
    return found.select("l_orderkey", F.array_join("names", "|").alias("names"))


@query("""
SELECT l_orderkey, coalesce(string_agg(p_name, '|' ORDER BY l_linenumber, l_partkey) FILTER (WHERE p_name IS NOT NULL), '') AS names
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 25) ON p_partkey = l_partkey GROUP BY l_orderkey
""")
def array_lookup_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = table(spark, sf_dir, "part").filter("p_size <= 25")
    found = relational.lookup_array(_baskets(spark, sf_dir), "keys", dim, "p_partkey", "p_name", "names", ["l_orderkey"], "drop")
    return found.select("l_orderkey", F.array_join("names", "|").alias("names"))


@query("""
SELECT e.doc_id, e.source, f.other_id, f.other_chars
FROM documents e JOIN (SELECT source, max(doc_id) AS other_id, arg_max(n_chars, doc_id) AS other_chars FROM documents WHERE lang = 'fr' GROUP BY source) f USING (source)
WHERE e.lang = 'en'
""")
def bilingual_join_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    other = docs.filter("lang = 'fr'").select("source", F.col("doc_id").alias("other_id"), F.col("n_chars").alias("other_chars"))
    return relational.localized_join(docs.filter("lang = 'en'").select("doc_id", "source"), other, ["source"], F.col("other_id")).select("doc_id", "source", "other_id", "other_chars")


@query("""
SELECT p_partkey, p_name FROM part
WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 90 DAY)
""")
def anti_join_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_shipdate")
    newest = lines.agg(F.max("l_shipdate").alias("m")).first()["m"]
    recent = lines.filter(F.col("l_shipdate") >= F.lit(newest).cast("timestamp_ntz") - F.expr("INTERVAL 90 DAYS"))
    return relational.missing_from(table(spark, sf_dir, "part").select("p_partkey", "p_name"), recent, ["p_partkey"])


@query("""
WITH e AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events)
SELECT event_id, day FROM e WHERE day IN (SELECT DISTINCT day FROM e ORDER BY day DESC LIMIT 2) OR day = '2024-01-03'
""")
def retention_keep_latest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return relational.retain_latest(events, "day", 2, ["2024-01-03"]).select("event_id", "day")


@query("""
SELECT p_partkey, p_brand, p_retailprice FROM (
  SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part)
WHERE r <= 2 ORDER BY p_retailprice DESC, p_partkey LIMIT 15
""")
def group_cap_then_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    return ranking.capped_top_k(parts, "p_brand", [F.desc("p_retailprice"), F.col("p_partkey")], 2, 15)


@query("""
SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS position
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 3
""")
def last_n_chronological(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.last_n_chronological(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", ["turn"], 3)


@query("""
SELECT event_id, event_type, CAST(CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS INTEGER) AS branch FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events WHERE event_type IN ('purchase', 'click', 'view'))
WHERE r <= CASE event_type WHEN 'view' THEN 6 ELSE 7 END
""")
def quota_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    quotas = ranking.split_quota(20, ["purchase", "click", "view"])
    return ranking.quota_union(events, "event_type", [F.desc("value"), F.col("event_id")], quotas).select("event_id", "event_type", "branch")


@query("""
WITH n AS (
  SELECT o_orderkey, o_custkey, o_totalprice * 2 AS o_totalprice, 'N' AS o_orderstatus FROM orders WHERE o_orderstatus = 'O'
  UNION ALL SELECT o_orderkey + 100000000, o_custkey, o_totalprice, 'N' FROM orders WHERE o_orderstatus = 'P')
SELECT coalesce(b.o_orderkey, n.o_orderkey) AS o_orderkey, coalesce(b.o_custkey, n.o_custkey) AS o_custkey, coalesce(n.o_totalprice, b.o_totalprice) AS o_totalprice,
       CASE WHEN b.o_orderkey IS NOT NULL AND n.o_orderkey IS NOT NULL THEN 'R' ELSE coalesce(n.o_orderstatus, b.o_orderstatus) END AS o_orderstatus
FROM orders b FULL JOIN n ON b.o_orderkey = n.o_orderkey
""")
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    changed = base.filter("o_orderstatus = 'O'").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    fresh = base.filter("o_orderstatus = 'P'").withColumn("o_orderkey", F.col("o_orderkey") + 100_000_000)
    incoming = changed.unionByName(fresh).withColumn("o_orderstatus", F.lit("N"))
    return relational.merge(base, incoming, ["o_orderkey"], keep=["o_custkey"], override={"o_orderstatus": "R"})


@query("""
SELECT l_returnflag, count(*) AS n, sum(q) AS quantity FROM (
  SELECT l_returnflag, l_quantity AS q FROM lineitem WHERE l_returnflag <> 'R'
  UNION ALL SELECT l_returnflag, l_quantity + 1 FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25) GROUP BY l_returnflag
""")
def replace_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity")
    fresh = lines.filter("l_quantity > 25").withColumn("l_quantity", F.col("l_quantity") + 1)
    swapped = relational.replace_partition(lines, fresh, {"l_returnflag": "R"})
    return swapped.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("""
WITH l AS (SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey),
r AS (SELECT c_nationkey, p_brand, 1 + count(*) % 2 AS w FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
s AS (SELECT l_suppkey, c_nationkey, count(*) AS k, sum(w) AS sw FROM l JOIN r USING (p_brand) GROUP BY ALL),
j AS (SELECT l_suppkey, c_nationkey, sw / (rw + ln - k) AS similarity FROM s JOIN (SELECT l_suppkey, count(*) AS ln FROM l GROUP BY ALL) USING (l_suppkey) JOIN (SELECT c_nationkey, sum(w) AS rw FROM r GROUP BY ALL) USING (c_nationkey)),
b AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY similarity DESC, c_nationkey) AS o FROM j)
SELECT l_suppkey, c_nationkey, similarity, 1 - similarity AS deviation, CAST((1 - similarity >= 0.3) AS INTEGER) + CAST((1 - similarity >= 0.6) AS INTEGER) AS bin FROM b WHERE o = 1
""")
def weighted_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    brands = lines.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    bought = brands.join(orders, "l_orderkey").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    right = bought.groupBy("c_nationkey", "p_brand").agg((1 + F.count(F.lit(1)) % 2).alias("w"))
    pairs = scoring.weighted_jaccard(brands.select("l_suppkey", "p_brand").distinct(), right, "l_suppkey", "c_nationkey", "p_brand", "w")
    return scoring.best_match(pairs, "l_suppkey", "c_nationkey")


@query("""
WITH b AS (SELECT DISTINCT l_orderkey, l_partkey, 1 + l_partkey % 2 AS w FROM lineitem),
z AS (SELECT l_orderkey, count(*) AS n, sum(w) AS whole FROM b GROUP BY ALL),
s AS (SELECT x.l_orderkey, y.l_orderkey AS like_orderkey, count(*) AS k, sum(y.w) AS sw FROM b x JOIN b y USING (l_partkey) GROUP BY ALL),
j AS (SELECT s.l_orderkey, like_orderkey, sw / (r.whole + l.n - k) AS similarity FROM s JOIN z l USING (l_orderkey) JOIN z r ON r.l_orderkey = like_orderkey)
SELECT * FROM j WHERE similarity >= 0.3 AND l_orderkey <> like_orderkey
""")
def alike_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose parts are alike by 0.3 or more, parts weighing what the second order says."""
    left = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").repartition("l_orderkey").distinct()
    right = left.select(F.col("l_orderkey").alias("like_orderkey"), "l_partkey", (1 + F.col("l_partkey") % 2).alias("w"))
    return scoring.weighted_jaccard(left, right, "l_orderkey", "like_orderkey", "l_partkey", "w", least=0.3).filter("l_orderkey <> like_orderkey")


@query("""
WITH f AS (SELECT p_brand, p_name, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1),
n AS (SELECT p_brand, CASE length(p_brand) % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN '가' || p_name ELSE p_name END AS name FROM f)
SELECT p_brand, name, CAST(row_number() OVER (ORDER BY name COLLATE ko, p_brand) AS INTEGER) AS place FROM n
""")
def collated_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each brand the dearest part, placed by name in Korean collation."""
    parts = table(spark, sf_dir, "part").select("p_brand", "p_name", "p_partkey", "p_retailprice")
    first = relational.keep_first(parts, ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")])
    size = F.length("p_brand") % 3
    name = F.when(size == 0, F.upper("p_name")).when(size == 1, F.concat(F.lit("가"), "p_name")).otherwise(F.col("p_name"))
    return relational.placed(first.select("p_brand", name.alias("name")), [F.collate("name", "ko"), F.col("p_brand")], "place")
