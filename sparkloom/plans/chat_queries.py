"""Queries of message rules, answer checks, retrieval by intent and id maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import prompts, text
from sparkloom.operators import chat, ranking, relational
from sparkloom.plans.registry import query, table
from sparkloom.plans.text_queries import TOPICS


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


@query(r"SELECT conv_id, turn, '<message>' || chr(10) || text || chr(10) || '</message>' AS wrapped FROM conversations WHERE role = 'user'")
def wrap_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).filter("role = 'user'").select("conv_id", "turn", text.wrapped(F.col("text"), "<message>", "</message>").alias("wrapped"))


@query("SELECT conv_id, turn, NOT coalesce(regexp_matches(text, 'the|der|los|des'), false) AS off_topic FROM conversations")
def off_topic_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select("conv_id", "turn", text.off_topic(F.col("text"), "the|der|los|des").alias("off_topic"))


@query(r"""
WITH r AS (SELECT *, trim(regexp_replace(p_name, '[?!？！ ]+$', '')) AS rest FROM (SELECT p_partkey, p_name || CASE WHEN p_partkey % 2 = 0 THEN '?! ' ELSE '' END AS p_name FROM part))
SELECT p_partkey, CASE WHEN NOT contains(p_name, 'ring') OR contains(p_name, 'red') THEN false ELSE contains(p_name, 'small') OR regexp_matches(rest, '^(?:(hot|blue) ring)$') END AS asks FROM r
""")
def version_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, F.lit("?! ")).otherwise(F.lit("")))
    return table(spark, sf_dir, "part").select("p_partkey", text.asks_version(name, "ring", ["red"], ["small"], "(hot|blue) ring").alias("asks"))


@query(r"""
SELECT conv_id, turn, CASE WHEN contains(text, 'que') OR contains(text, 'und') THEN trim(regexp_replace(regexp_replace(text, '\b[A-Z]\w*\b', '', 'g'), '[ \t]+', ' ', 'g'), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') ELSE text END AS answer
FROM conversations WHERE role = 'assistant' AND regexp_matches(text, '^[\x00-\x7F]*$')
""")
def no_information_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = _messages(spark, sf_dir).filter("role = 'assistant'").filter(F.col("text").rlike(r"\A[\x00-\x7F]*\z"))
    return plain.select("conv_id", "turn", text.without_citations(F.col("text"), ["que", "und"], r"\b[A-Z]\w*\b").alias("answer"))


@query(r"""
WITH a AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'see ' || url || '. ' WHEN 1 THEN '(''' || url || '''); ' WHEN 2 THEN 'at "' || url || '"! ' ELSE '' END || CASE WHEN page_id % 5 = 0 THEN '[source]' ELSE '[source](x)' END AS answer,
             CASE WHEN page_id % 3 = 0 THEN 'https://none.example' ELSE url END AS known FROM pages)
SELECT page_id, answer || CASE WHEN page_id % 5 = 0 OR len(list_filter(list_transform(regexp_extract_all(answer, 'https?://[^\s)\]]+'), lambda u: rtrim(u, '.,;:!?)]''"')), lambda u: u <> known)) > 0
  THEN chr(10) || chr(10) || 'unverified' ELSE '' END AS checked FROM a
""")
def web_citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs bare, in quotes and brackets, or missing, behind labels with and without a link."""
    at, url = F.col("page_id") % 4, F.col("url")
    label = F.when(F.col("page_id") % 5 == 0, F.lit("[source]")).otherwise(F.lit("[source](x)"))
    shown = F.when(at == 0, F.concat(F.lit("see "), url, F.lit(". "))).when(at == 1, F.concat(F.lit("('"), url, F.lit("'); "))).when(at == 2, F.concat(F.lit('at "'), url, F.lit('"! '))).otherwise(F.lit(""))
    known = F.array(F.when(F.col("page_id") % 3 == 0, F.lit("https://none.example")).otherwise(url))
    return table(spark, sf_dir, "pages").select("page_id", text.warn_unknown_sources(F.concat(shown, label), known, "unverified", r"\[source\](?!\()").alias("checked"))


@query("""
WITH l AS (SELECT conv_id, turn, role, text, lag(CASE WHEN role = 'assistant' THEN text END) OVER (PARTITION BY conv_id ORDER BY turn) AS last FROM conversations)
SELECT conv_id, turn, CASE WHEN last <> '' THEN last || chr(10) || text ELSE text END AS search_text FROM l WHERE role = 'user'
""")
def search_query_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.lag(F.when(F.col("role") == "assistant", F.col("text"))).over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = _messages(spark, sf_dir).withColumn("last", last).filter("role = 'user'")
    return rows.select("conv_id", "turn", text.search_text(F.col("text"), F.col("last")).alias("search_text"))


@query("""
WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), e AS (SELECT p_partkey, w, unnest(range(1, len(w) + 1)) AS i FROM w)
SELECT p_partkey, CAST(i - 1 AS INTEGER) AS place, w[i] || CASE WHEN i < len(w) THEN ' ' ELSE '' END AS word FROM e
""")
def emit_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(text.emitted_words(F.col("p_name"))).alias("place", "word"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ing') ORDER BY p_name, p_partkey LIMIT 20")
def substring_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "part").filter(F.lower("p_name").contains("ing"))
    return found.select("p_partkey", "p_name").orderBy("p_name", "p_partkey").limit(20)


@query(r"""
WITH a AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '(see : [REF]) f() [ ] ' WHEN 1 THEN '[REF]' ELSE '(see: ) ' END || p_name || '''s rate is ' || CASE p_size % 4 WHEN 0 THEN 'about 5% or ' WHEN 1 THEN '%' ELSE '' END || p_size || CASE WHEN p_size % 5 = 0 THEN ' %' ELSE '.5%' END || ' ''' || p_brand || '''  ' AS t FROM part),
b AS (SELECT p_partkey, CASE WHEN contains(t, '[REF]') THEN rtrim(regexp_replace(replace(t, '[REF]', ''), '\(\s*see\s*:\s*\)', '', 'g')) ELSE t END AS t FROM a),
c AS (SELECT p_partkey, replace(regexp_replace(t, 'rate[^%\n]{0,10}\d+(?:\.\d+)?%', 'a rate', 'g'), 'widget', 'thing') AS t FROM b)
SELECT p_partkey, CASE WHEN len(list_filter(regexp_extract_all(t, '''([^''\n]+)''', 1), lambda x: x NOT IN ('Brand#1', 'Brand#2'))) > 0 THEN t || chr(10) || chr(10) || 'unknown' ELSE t END AS answer FROM c
""")
def postprocess_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with markers in and out of citations, and percentages near to and far from their subject."""
    key, size = F.col("p_partkey"), F.col("p_size")
    start = F.when(key % 3 == 0, F.lit("(see : [REF]) f() [ ] ")).when(key % 3 == 1, F.lit("[REF]")).otherwise(F.lit("(see: ) "))
    before = F.when(size % 4 == 0, F.lit("about 5% or ")).when(size % 4 == 1, F.lit("%")).otherwise(F.lit(""))
    answer = F.concat(start, "p_name", F.lit("'s rate is "), before, size.cast("string"), F.when(size % 5 == 0, F.lit(" %")).otherwise(F.lit(".5%")), F.lit(" '"), "p_brand", F.lit("'  "))
    known = F.array(F.lit("Brand#1"), F.lit("Brand#2"))
    done = text.postprocessed(answer, ["[REF]"], r"\(\s*see\s*:\s*\)", "rate", "a rate", ["widget"], "thing", known, "unknown")
    return table(spark, sf_dir, "part").select("p_partkey", done.alias("answer"))


@query("""
WITH p AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN [p_name, p_type] WHEN p_size > 10 THEN [p_name] ELSE [] END AS c,
  CASE WHEN p_size % 3 = 0 THEN 'true' WHEN p_size % 3 = 1 THEN 'false' END AS fast, CASE WHEN p_size % 2 = 0 THEN p_brand END AS brand FROM part),
x AS (SELECT p_partkey, list_filter([CASE WHEN len(c) > 0 THEN array_to_string(c, '/') END, CASE WHEN fast = 'true' THEN 'Fast' END, CASE WHEN brand IS NOT NULL THEN 'By ' || brand END], lambda v: v IS NOT NULL) AS v FROM p)
SELECT p_partkey, CASE WHEN len(v) > 0 THEN array_to_string(v, ' · ') ELSE 'any' END AS playstyle FROM x
""")
def playstyle_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    carries = F.when(size > 25, F.array("p_name", "p_type")).when(size > 10, F.array("p_name")).otherwise(F.array().cast("array<string>"))
    fast = F.when(size % 3 == 0, F.lit("true")).when(size % 3 == 1, F.lit("false"))
    badges = F.create_map(F.lit("fast"), fast, F.lit("brand"), F.when(size % 2 == 0, F.col("p_brand")))
    return table(spark, sf_dir, "part").select("p_partkey", text.playstyle(carries, badges, [("fast", "Fast"), ("brand", "By")], "any").alias("playstyle"))


@query(r"""
SELECT p_partkey, CASE WHEN p_name LIKE '%ring%' THEN 'jewels' WHEN p_name LIKE '%bolt%' THEN 'hardware' END AS topic,
  'https://cdn.example/' || replace(lower(p_type || '/' || p_name || '.TEX'), '.tex', '.png') AS asset,
  CASE p_brand WHEN 'Brand#1' THEN 'First' WHEN 'Brand#2' THEN 'Second' ELSE regexp_replace(p_brand, 'brand#', '', 'i') END AS brand,
  len(list_filter(regexp_extract_all(p_name, '[a-z]+'), lambda t: NOT list_contains(regexp_extract_all('small red blue ring bolt', '[a-z]+'), t))) = 0 AS grounded FROM part
""")
def name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for x in ("Brand#1", "First", "Brand#2", "Second")])
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.first_topic(F.col("p_name"), [("jewels", "ring"), ("hardware", "bolt")]).alias("topic"),
        text.asset_url(F.concat("p_type", F.lit("/"), "p_name", F.lit(".TEX")), "https://cdn.example/").alias("asset"),
        text.name_or_fallback(F.col("p_brand"), names, "brand#").alias("brand"),
        text.tokens_subset(F.col("p_name"), F.lit("small red blue ring bolt"), "[a-z]+").alias("grounded"),
    )


#: Kinds of events that each intent looks at, for the query below.
INTENT_KINDS = (("buy", "purchase"), ("buy", "click"), ("look", "view"), ("look", "click"), ("fix", "error"))


@query("""
WITH k(intent, event_type) AS (VALUES ('buy', 'purchase'), ('buy', 'click'), ('look', 'view'), ('look', 'click'), ('fix', 'error')),
u AS (SELECT c_custkey AS user_id, CASE c_custkey % 3 WHEN 0 THEN 'buy' WHEN 1 THEN 'look' ELSE 'fix' END AS intent FROM customer)
SELECT event_id, user_id, intent FROM events JOIN u USING (user_id) JOIN k USING (intent, event_type)
""")
def intent_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.createDataFrame(INTENT_KINDS, "intent string, event_type string")
    intent = F.when(F.col("c_custkey") % 3 == 0, F.lit("buy")).when(F.col("c_custkey") % 3 == 1, F.lit("look")).otherwise(F.lit("fix"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), intent.alias("intent"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type").join(users, "user_id").join(kinds, ["intent", "event_type"]).select("event_id", "user_id", "intent")


@query("""
WITH i AS (SELECT unnest([3, 1, 4, 1, 5, 9, 999999]) AS user_id, generate_subscripts([3, 1, 4, 1, 5, 9, 999999], 1) AS place),
f AS (SELECT user_id, min(place) AS place FROM i GROUP BY user_id),
e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events WHERE event_type = 'purchase')
SELECT e.event_id, e.user_id, CAST(place AS INTEGER) AS place, CAST(r AS INTEGER) AS rank FROM e JOIN f USING (user_id) WHERE r <= 2
""")
def structured_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each id asked for, in the order asked, the two best rows."""
    asked = spark.createDataFrame([(x, i + 1) for i, x in enumerate((3, 1, 4, 1, 5, 9, 999999))], "user_id long, place int")
    first = asked.groupBy("user_id").agg(F.min("place").alias("place"))
    bought = table(spark, sf_dir, "events").filter("event_type = 'purchase'").join(first, "user_id")
    return ranking.top_n_per_group(bought, ["user_id"], [F.desc("value"), F.col("event_id")], 2).select("event_id", "user_id", "place", "rank")


@query("""
WITH base AS (SELECT p_brand AS version, p_partkey AS item, p_retailprice AS price, p_partkey + 1000 AS id FROM part WHERE p_partkey % 3 <> 0),
incoming AS (SELECT p_brand AS version, p_partkey AS item, p_retailprice + 1 AS price FROM part WHERE p_partkey % 2 = 0),
m AS (SELECT i.*, b.id FROM incoming i LEFT JOIN base b USING (version, item))
SELECT * FROM base WHERE (version, item) NOT IN (SELECT (version, item) FROM incoming)
UNION ALL SELECT * FROM m WHERE id IS NOT NULL
UNION ALL SELECT version, item, price, (SELECT max(id) FROM base) + row_number() OVER (ORDER BY version, item) AS id FROM m WHERE id IS NULL
""")
def id_map_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("version"), F.col("p_partkey").alias("item"), F.col("p_retailprice").alias("price"))
    base = rows.filter("item % 3 <> 0").withColumn("id", F.col("item") + 1000)
    return relational.upsert_with_ids(base, rows.filter("item % 2 = 0").withColumn("price", F.col("price") + 1), "version", "item", "id")


@query("SELECT l_orderkey, l_linenumber, CAST(p_partkey + 1000 AS BIGINT) AS id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_partkey % 3 <> 0")
def bridge_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "part").filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_partkey") + 1000).alias("id"))
    return relational.resolve_ids(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ids, ["l_partkey"], "id").drop("l_partkey")


@query("""
WITH a AS (SELECT c_custkey, list(DISTINCT o_orderpriority) FILTER (o_orderkey IS NOT NULL) AS p FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY c_custkey)
SELECT c_custkey, CAST(len(p) AS INTEGER) AS n FROM a WHERE len(p) > 0
""")
def nonempty_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    dear = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set("o_orderpriority").alias("p"))
    return relational.with_elements(table(spark, sf_dir, "customer").select("c_custkey").join(dear, "c_custkey", "left"), "p").select("c_custkey", F.size("p").alias("n"))


@query("SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part")
def array_distinct_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.distinct_elements(table(spark, sf_dir, "part").select(F.split("p_name", " ", -1).alias("w")), "w", "word")


@query("SELECT array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM (SELECT event_type FROM events ORDER BY value DESC, event_id LIMIT 25)")
def result_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = table(spark, sf_dir, "events").orderBy(F.desc("value"), "event_id").limit(25)
    return best.agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds"))


@query("SELECT DISTINCT p_name AS name FROM part UNION SELECT s_name FROM supplier UNION SELECT c_name FROM customer")
def known_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    return relational.union_of_names((t("part"), "p_name"), (t("supplier"), "s_name"), (t("customer"), "c_name"))


@query("SELECT event_id FROM events WHERE ts + INTERVAL 36 HOUR > TIMESTAMP '2024-01-20 00:00:00' AND strftime(ts, '%Y') = '2024'")
def cache_lifetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    alive = relational.unexpired(table(spark, sf_dir, "events"), "ts", F.lit("2024-01-20 00:00:00").cast("timestamp"), F.expr("INTERVAL 36 HOURS"))
    return relational.invalidate(alive.withColumn("version", F.date_format("ts", "yyyy")), "version", F.lit("2024")).select("event_id")


@query("""
WITH v AS (SELECT event_id, '1.' || CAST(day(ts) AS VARCHAR) AS version, day(ts) AS age FROM events)
SELECT event_id, version FROM v WHERE version IN (SELECT version FROM v GROUP BY version ORDER BY max(age) DESC LIMIT 3) OR version = '1.2'
""")
def retention_by_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions such as 1.9 and 1.10 kept by age, not by text."""
    events = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("1."), F.dayofmonth("ts").cast("string")).alias("version"), F.dayofmonth("ts").alias("age"))
    return relational.retain_latest(events, "version", 3, ["1.2"], ordinal="age").select("event_id", "version")


_EXCHANGES = """
WITH m AS (SELECT *, CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w END AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
x AS (SELECT conv_id, turn, text AS q, answer, row_number() OVER w = 1 AS first_turn, lag(answer) OVER w AS last_answer,
        list(concat_ws(' -> ', text, answer)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS history
      FROM m WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
"""


def _exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.exchanges(_messages(spark, sf_dir), "conv_id", "turn", "role", "text")


@query(_EXCHANGES + r"""
cache AS (SELECT q AS cq, min(answer) AS cached FROM x WHERE first_turn AND length(answer) < 1000 GROUP BY q),
y AS (SELECT *, nullif(length(q) % 17, 0) AS version, CAST(regexp_matches(q, 'price|cost|euro') AS INTEGER) + CAST(regexp_matches(q, 'when|heur|time') AS INTEGER) + CAST(regexp_matches(q, 'where|land|vill') AS INTEGER) AS n
      FROM x LEFT JOIN cache ON q = cq),
z AS (SELECT *, coalesce(CASE WHEN n = 1 AND NOT regexp_matches(q, 'why|pourquoi') THEN CASE WHEN regexp_matches(q, 'price|cost|euro') THEN 'price' WHEN regexp_matches(q, 'when|heur|time') THEN 'time' ELSE 'place' END END,
        CASE WHEN contains(q, 'ç') THEN 'web' WHEN contains(q, 'ä') THEN 'builds' WHEN contains(q, 'ö') THEN NULL END, 'general') AS intent FROM y)
SELECT conv_id, turn, CASE WHEN coalesce(trim(q), '') = '' THEN 'clarify' WHEN regexp_matches(q, '^(Who|Qui|Wer)') THEN 'meta' WHEN contains(q, 'ß') THEN 'language_notice'
  WHEN NOT regexp_matches(q, 'the|der|les|des') AND answer IS NOT NULL AND length(q) < 60 THEN 'refusal' WHEN version IS NULL THEN 'no_version'
  WHEN contains(q, 'le') AND NOT contains(q, 'ment') AND (contains(q, 'que') OR regexp_matches(trim(regexp_replace(q, '[?!？！ ]+$', '')), '^(?:le version)$')) THEN 'version'
  WHEN n >= 2 THEN 'multi_topic' WHEN first_turn AND cached IS NOT NULL THEN 'cached' WHEN intent = 'web' THEN 'web_search' WHEN intent = 'price' THEN 'model_only'
  WHEN intent = 'builds' AND NOT first_turn AND contains(last_answer, 'ung') THEN 'lookup' ELSE 'search' END AS branch,
  coalesce(first_turn AND length(answer) >= 300 AND n > 0, false) AS to_cache FROM z
""")
def answer_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, q, version = _exchanges(spark, sf_dir), F.col("question"), F.lit("16.1")
    known = asked.filter(F.col("first_turn") & (F.length("answer") < 1000))
    cache = known.groupBy(text.cache_key(q, version).alias("key")).agg(F.min("answer").alias("answer"))
    found = text.all_topics(q, TOPICS)
    told = F.when(q.contains("ç"), F.lit("web")).when(q.contains("ä"), F.lit("builds")).when(q.contains("ö"), F.lit("nonsense"))
    branch = chat.answer_branch(
        q, meta=q.rlike("^(Who|Qui|Wer)"), foreign=q.contains("ß"), off_topic=text.off_topic(q, "the|der|les|des"), confirmed=F.when(F.col("answer").isNotNull(), F.length(q) < 60),
        version=F.nullif(F.length(q) % 17, F.lit(0)), asks_version=text.asks_version(q, "le", ["ment"], ["que"], "le version"), topics=found, first_turn=F.col("first_turn"), cached=F.col("cached"),
        intent=chat.chosen_intent(text.single_topic(q, TOPICS, "why|pourquoi"), told, ["web", "builds"]), last_ids=F.regexp_extract_all("last_answer", F.lit("(ung)")),
        direct={"web": "web_search", "price": "model_only"}, follow_up="builds",
    )
    to_cache = chat.cacheable(F.col("first_turn"), F.length("answer") < 300, found)
    return chat.with_cached(asked, "question", version, cache).select("conv_id", "turn", branch.alias("branch"), to_cache.alias("to_cache"))


@query(_EXCHANGES + r"""
y AS (SELECT *, list_filter([CASE WHEN regexp_matches(q, 'price|cost|euro') THEN 'price' END, CASE WHEN regexp_matches(q, 'when|heur|time') THEN 'time' END, CASE WHEN regexp_matches(q, 'where|land|vill') THEN 'place' END], lambda v: v IS NOT NULL) AS topics FROM x)
SELECT conv_id, turn, CASE WHEN len(history) > 0 THEN '[earlier]' || chr(10) || array_to_string(history, chr(10)) || chr(10) || chr(10) ELSE '' END
  || CASE WHEN len(topics) > 0 THEN '[topics]' || chr(10) || array_to_string(topics, chr(10)) || chr(10) || chr(10) ELSE '' END || q AS prompt FROM y
""")
def prompt_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    earlier = F.transform("history", lambda x: F.concat_ws(" -> ", x["question"], x["answer"]))
    sections = [("earlier", earlier), ("topics", text.all_topics(F.col("question"), TOPICS))]
    return _exchanges(spark, sf_dir).select("conv_id", "turn", chat.prompt(sections, F.col("question")).alias("prompt"))


@query(_EXCHANGES.replace("list(concat_ws(' -> ', text, answer))", "list('Q: ' || text || chr(10) || 'A: ' || coalesce(answer, ''))") + r"""
y AS (SELECT conv_id, turn, '<m>' || chr(10) || q || chr(10) || '</m>' AS m, ['search', 'web_search', 'model_only', 'multi_topic', 'refusal'][CAST(length(q) % 5 AS INTEGER) + 1] AS branch, CASE WHEN conv_id % 7 = 0 THEN NULL ELSE '17.' || turn END AS version, string_split(q, ' ')[:2] AS w,
        CASE WHEN len(history) > 0 THEN '[이전 대화]' || chr(10) || array_to_string(history, chr(10)) || chr(10) || chr(10) ELSE '' END AS h, conv_id % 3 AS n,
        'https://' || CASE turn % 4 WHEN 0 THEN 'www.trusted.example' ELSE 'other.example' END || '/' || turn AS url FROM x)
SELECT conv_id, turn, CASE branch
  WHEN 'search' THEN coalesce('[검색된 문서] (기준 패치: ' || version || ')' || chr(10), '') || CASE WHEN n = 0 THEN '(검색된 문서 없음)' ELSE '- ' || array_to_string(w, chr(10) || '- ') END || chr(10) || chr(10) || h || m
  WHEN 'web_search' THEN coalesce('[알려진 사실]' || chr(10) || '현재 서비스에 반영된 기준 패치는 ''' || version || ''' 패치입니다.' || chr(10) || '오늘 날짜는 2026-08-12입니다.' || chr(10) || chr(10), '')
    || '[웹 검색 결과]' || chr(10) || CASE WHEN n = 0 THEN '(검색된 결과 없음)' ELSE '- ' || CASE WHEN url LIKE '%trusted%' THEN '[공식/전문]' ELSE '[커뮤니티/미검증]' END || ' t' || turn || ': ' || w[1] || ' (출처: ' || url || ')' END || chr(10) || chr(10) || h || m
  WHEN 'model_only' THEN h || m WHEN 'multi_topic' THEN '[요청된 주제]' || chr(10) || array_to_string(w, ', ') || chr(10) || chr(10) || m END AS sent FROM y
""")
def message_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the model is sent for each question, by branch, with documents, web results, topics and earlier exchanges."""
    asked, q, turn = _exchanges(spark, sf_dir), F.col("question"), F.col("turn")
    some, words = F.col("conv_id") % 3, F.slice(F.split(q, " ", -1), 1, 2)
    branch = F.element_at(F.array(*[F.lit(b) for b in ("search", "web_search", "model_only", "multi_topic", "refusal")]), (F.length(q) % 5 + 1).cast("int"))
    url = F.concat(F.lit("https://"), F.when(turn % 4 == 0, F.lit("www.trusted.example")).otherwise(F.lit("other.example")), F.lit("/"), turn.cast("string"))
    result = F.struct(F.concat(F.lit("t"), turn.cast("string")).alias("title"), F.get(words, F.lit(0)).alias("content"), url.alias("url"))
    results = F.filter(F.array(result), lambda _: some != 0)
    version = F.when(F.col("conv_id") % 7 != 0, F.concat(F.lit("17."), turn.cast("string")))
    sent = prompts.message_turn(branch, text.wrapped(q, "<m>", "</m>"), version, F.filter(words, lambda _: some != 0), results, F.col("history"), words, ["trusted.example"], F.lit("2026-08-12"))
    return asked.select("conv_id", "turn", sent.alias("sent"))
