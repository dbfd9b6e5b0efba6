"""Indicator queries over ``events`` and its kin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import kpi, tiering
from sparkloom.plans.registry import query, table
from sparkloom.streaming.limits import fixed_window_limit


@query("""
SELECT avg(value) FILTER (WHERE event_type = 'purchase') / 60.0 AS mean, count(*) FILTER (WHERE event_type = 'purchase' AND value IS NOT NULL) AS n FROM events
""")
def filtered_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.filtered_mean(table(spark, sf_dir, "events"), F.col("value"), F.col("event_type") == "purchase", 1 / 60)


@query("""
SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, count(value) AS n FROM events GROUP BY event_type
""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.interp_percentiles(table(spark, sf_dir, "events"), "value", {"p50": 0.5, "p95": 0.95}, by=["event_type"])


@query("""
SELECT quantile_cont(value, 0.5) FILTER (WHERE event_type <> 'error') AS warm_p50, quantile_cont(value, 0.95) AS p95,
       avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) * 100 AS cold_percent, count(value) AS n FROM events
""")
def warm_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, warm = table(spark, sf_dir, "events"), F.col("event_type") != "error"
    cold = kpi.filtered_mean(events, (~warm).cast("double"), scale=100)
    row = kpi.summary(warm=kpi.interp_percentiles(events, "value", {"p50": 0.5}, warm), all=kpi.interp_percentiles(events, "value", {"p95": 0.95}), cold=cold)
    return row.select(F.col("warm.p50").alias("warm_p50"), F.col("all.p95").alias("p95"), F.col("cold.mean").alias("cold_percent"), F.col("all.n").alias("n"))


_FUNNEL = """
WITH e AS (SELECT user_id FROM events WHERE event_type = 'view' AND value > 40),
c AS (SELECT (SELECT count(*) FROM e) AS exposed, (SELECT count(*) FROM events WHERE event_type = 'click' AND user_id IN (SELECT user_id FROM e)) AS acted)
SELECT exposed, acted, CASE WHEN exposed > 0 THEN acted * 100.0 / exposed END AS percent FROM c
"""


@query(_FUNNEL)
def semi_join_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    shown = events.filter((F.col("event_type") == "view") & (F.col("value") > 40))
    return kpi.funnel(shown, events.filter(F.col("event_type") == "click"), ["user_id"])


_COHORT = """
WITH f AS (SELECT user_id, min(ts) AS first_ts FROM events WHERE event_type = 'signup' GROUP BY user_id),
n AS (SELECT f.user_id, first_ts, min(ts - first_ts) AS late FROM f LEFT JOIN events e ON e.user_id = f.user_id AND event_type = 'purchase' AND ts >= first_ts GROUP BY ALL),
w AS (SELECT *, unnest([6, 24]) AS hours FROM n)
SELECT CAST(hours AS INTEGER) AS hours, count(*) AS eligible, CAST(sum(CASE WHEN late <= to_hours(hours) THEN 1 ELSE 0 END) AS BIGINT) AS converted,
       avg(CASE WHEN late <= to_hours(hours) THEN 1.0 ELSE 0.0 END) * 100 AS percent
FROM w WHERE TIMESTAMP '2024-01-31 00:00:00' - first_ts >= to_hours(hours) GROUP BY hours
"""


@query(_COHORT)
def interval_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    now = F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")
    return kpi.converted_within(table(spark, sf_dir, "events"), "user_id", "ts", kind == "signup", kind == "purchase", [6, 24], now)


@query("""
SELECT avg(value) FILTER (WHERE event_type = 'purchase') AS mean_purchase, avg(value) * 100 AS mean_percent,
       quantile_cont(value, 0.95) AS p95, CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS views,
       CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS clicks, count(DISTINCT user_id) AS users FROM events
""")
def kpi_summary_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, kind = table(spark, sf_dir, "events"), F.col("event_type")
    counts = events.agg(
        F.avg(F.when(kind == "purchase", F.col("value"))).alias("mean_purchase"), (F.avg("value") * 100).alias("mean_percent"),
        F.count(F.when(kind == "view", 1)).alias("views"), F.count(F.when(kind == "click", 1)).alias("clicks"), F.countDistinct("user_id").alias("users"),
    )
    return kpi.summary(counts=counts, latency=kpi.interp_percentiles(events, "value", {"p95": 0.95})).select("counts.*", "latency.p95")


@query("""
WITH b AS (SELECT p_brand, round(sum(l_extendedprice), 2) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand),
n AS (SELECT *, CASE WHEN max(revenue) OVER () = min(revenue) OVER () THEN 0.0 ELSE (revenue - min(revenue) OVER ()) / (max(revenue) OVER () - min(revenue) OVER ()) * 100 END AS s FROM b),
g AS (SELECT *, lag(s) OVER (ORDER BY s DESC, p_brand) - s AS gap FROM n),
w AS (SELECT *, CASE WHEN gap > avg(gap) OVER () * 1.3 THEN 1 ELSE 0 END AS wide FROM g),
l AS (SELECT *, least(4, sum(wide) OVER (ORDER BY s DESC, p_brand ROWS UNBOUNDED PRECEDING)) AS level FROM w)
SELECT p_brand, revenue, ['OP', 'S', 'A', 'B', 'C'][CAST(level AS INTEGER) + 1] AS tier FROM l
""")
def gap_tiering(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    by_part = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_extendedprice").alias("revenue"))
    brands = by_part.join(parts.select("p_partkey", "p_brand"), "p_partkey").groupBy("p_brand").agg(F.round(F.sum("revenue"), 2).alias("revenue"))
    return tiering.gap_tiers(brands, "revenue", "p_brand")


@query("""
WITH n AS (SELECT p_partkey, p_size, p_retailprice, (p_retailprice - min(p_retailprice) OVER w) / nullif(max(p_retailprice) OVER w - min(p_retailprice) OVER w, 0) * 100 AS s, count(*) OVER w AS n
           FROM part WHERE p_size <> 7 WINDOW w AS (PARTITION BY p_size > 45)),
g AS (SELECT *, lag(s) OVER (PARTITION BY p_size > 45 ORDER BY s DESC, p_partkey) - s AS gap FROM n),
w AS (SELECT *, CASE WHEN gap > 100.0 / (n - 1) * 6 THEN 1 ELSE 0 END AS wide FROM g),
l AS (SELECT *, least(4, sum(wide) OVER (PARTITION BY p_size > 45 ORDER BY s DESC, p_partkey ROWS UNBOUNDED PRECEDING)) AS level FROM w)
SELECT p_partkey, ['OP', 'S', 'A', 'B', 'C'][CAST(level AS INTEGER) + 1] AS tier FROM l UNION ALL SELECT p_partkey, 'C' FROM part WHERE p_size = 7
""")
def part_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts by price within two groups, one of nearly all rows; parts of one size have no score."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") != 7, F.col("p_retailprice")).alias("score"), (F.col("p_size") > 45).alias("large"))
    return tiering.gap_tiers(parts, "score", "p_partkey", ["large"], factor=6.0).select("p_partkey", "tier")


@query("""
WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
w AS (
  SELECT event_id, user_id, ts, r, ts AS start, 1 AS n FROM e WHERE r = 1
  UNION ALL
  SELECT e.event_id, e.user_id, e.ts, e.r, CASE WHEN e.ts - w.start >= INTERVAL 24 HOURS THEN e.ts ELSE w.start END,
         CASE WHEN e.ts - w.start >= INTERVAL 24 HOURS THEN 1 ELSE w.n + 1 END
  FROM w JOIN e ON e.user_id = w.user_id AND e.r = w.r + 1)
SELECT event_id, user_id, CAST(n AS BIGINT) AS seen, n <= 2 AS allowed FROM w
""")
def rate_limit_fixed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    limited = fixed_window_limit(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 2, 86_400)
    return limited.select("event_id", "user_id", "seen", "allowed")


@query("""
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) >= 5
""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))
    return typed.filter(F.col("k") >= 5)


@query(f"""
WITH u AS ({_COHORT}), e AS (SELECT * FROM events), shown AS (SELECT user_id FROM e WHERE event_type = 'view' AND value > 40),
c AS (SELECT (SELECT count(*) FROM shown) AS exposed, count(*) AS acted FROM e WHERE event_type = 'click' AND user_id IN (SELECT user_id FROM shown))
SELECT avg(value) FILTER (WHERE event_type = 'purchase') / 60 AS freshness_mean, count(value) FILTER (WHERE event_type = 'purchase') AS freshness_n,
       avg(CASE WHEN value > 10 THEN 1.0 WHEN value IS NOT NULL THEN 0.0 END) * 100 AS grounding_mean, count(value) AS grounding_n,
       (SELECT exposed FROM c) AS exposed, (SELECT acted FROM c) AS acted, (SELECT 100.0 * acted / nullif(exposed, 0) FROM c) AS conversion_percent,
       (SELECT percent FROM u WHERE hours = 6) AS early_percent, (SELECT percent FROM u WHERE hours = 24) AS late_percent, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM e
""")
def kpi_five_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, kind, value = table(spark, sf_dir, "events"), F.col("event_type"), F.col("value")
    cohort = kpi.converted_within(events, "user_id", "ts", kind == "signup", kind == "purchase", [6, 24], F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'"))
    all_five = kpi.summary(
        freshness=kpi.filtered_mean(events, value, kind == "purchase", 1 / 60), grounding=kpi.filtered_mean(events, (value > 10).cast("double"), scale=100),
        conversion=kpi.funnel(events.filter((kind == "view") & (value > 40)), events.filter(kind == "click"), ["user_id"]),
        usage=cohort.agg(*[F.max(F.when(F.col("hours") == h, F.col("percent"))).alias(n) for h, n in ((6, "early"), (24, "late"))]),
        latency=kpi.interp_percentiles(events, "value", {"p50": 0.5, "p95": 0.95}),
    )
    names = {"freshness.mean": "freshness_mean", "freshness.n": "freshness_n", "grounding.mean": "grounding_mean", "grounding.n": "grounding_n", "conversion.exposed": "exposed", "conversion.acted": "acted"}
    names |= {"conversion.percent": "conversion_percent", "usage.early": "early_percent", "usage.late": "late_percent", "latency.p50": "p50", "latency.p95": "p95"}
    return all_five.select(*[F.col(c).alias(n) for c, n in names.items()])
