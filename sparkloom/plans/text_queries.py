"""Queries of the text functions and of trigram search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import similarity, text
from sparkloom.operators import links, retrieval, search
from sparkloom.plans.registry import query, table

QUERY_TEXT = "which small blue widgit or hot gear?"


@query("SELECT doc_id, regexp_matches(text, '[0-9]{3}|https?://') AS exposed FROM documents")
def regex_exposure_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike("[0-9]{3}|https?://").alias("exposed"))


@query(r"""
WITH h AS (SELECT page_id, html || CASE page_id % 3 WHEN 0 THEN ' if 3 < 5 and 7 > 2, <3 hearts> <-' WHEN 1 THEN chr(10) || '@dmg@<rules>x</rules>' ELSE '' END AS html FROM pages)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<br\s*/?>', chr(10), 'gi'), '@[^@]*@', '?', 'g'), '</?[a-zA-Z][^<>]*>', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'),
  '^[\s\x0B\x{85}\pZ]+|[\s\x0B\x{85}\pZ]+$', '', 'g') AS clean FROM h
""")
def clean_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, some with comparisons and arrows that are no tags."""
    at = F.col("page_id") % 3
    more = F.when(at == 0, F.lit(" if 3 < 5 and 7 > 2, <3 hearts> <-")).when(at == 1, F.lit("\n@dmg@<rules>x</rules>")).otherwise(F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", text.clean_markup(F.concat("html", more)).alias("clean"))


@query(r"""
WITH a AS (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '[\s\x0B\x{85}\pZ]+', ' ', 'g'), '^ | $', '', 'g') AS t FROM conversations WHERE role = 'user'),
b AS (SELECT conv_id, turn, CASE WHEN contains(t, 'und der') THEN t ELSE replace(t, 'und', 'und der') END AS t FROM a),
c AS (SELECT conv_id, turn, CASE WHEN contains(t, 'the best') THEN t ELSE replace(t, 'the', 'the best') END AS t FROM b)
SELECT conv_id, turn, substr(t, 1, 500) AS normal FROM c
""")
def normalize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return asked.select("conv_id", "turn", text.normalize_query(F.col("text"), {"und": "und der", "the": "the best"}).alias("normal"))


TOPICS = [("price", "price|cost|euro"), ("time", "when|heur|time"), ("place", "where|land|vill")]


@query("""
WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations),
n AS (SELECT *, CAST(regexp_matches(t, 'price|cost|euro') AS INTEGER) + CAST(regexp_matches(t, 'when|heur|time') AS INTEGER) + CAST(regexp_matches(t, 'where|land|vill') AS INTEGER) AS n FROM t)
SELECT conv_id, turn, CASE WHEN trim(t) = '' THEN 'clarify' WHEN regexp_matches(t, '^(Who|Qui|Wer)') THEN 'meta' WHEN n >= 2 THEN 'multi_topic'
  WHEN len(regexp_extract_all(t, '[A-Za-z]+')) < 3 THEN 'too_short' WHEN n = 1 AND NOT regexp_matches(t, 'why|pourquoi') THEN
    CASE WHEN regexp_matches(t, 'price|cost|euro') THEN 'price' WHEN regexp_matches(t, 'when|heur|time') THEN 'time' ELSE 'place' END ELSE 'general' END AS route FROM n
""")
def route_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce(F.col("text"), F.lit(""))
    single = text.single_topic(t, TOPICS, "why|pourquoi")
    steps = [("meta", t.rlike("^(Who|Qui|Wer)")), ("multi_topic", F.size(text.all_topics(t, TOPICS)) >= 2), ("too_short", ~text.foreign(t))]
    steps += [(label, single == label) for label, _ in TOPICS]
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.route(t, steps, "general").alias("route"))


@query("""
WITH t AS (SELECT conv_id, turn, list_sort(list_distinct(list_filter(regexp_extract_all(text, '[A-Z][a-z]+'), lambda x: x NOT IN ('La', 'Le', 'De', 'The', 'And', 'Und', 'Die')))) AS u FROM conversations)
SELECT conv_id, turn, array_to_string(u, '|') AS unknown, len(u) = 0 AS grounded FROM t
""")
def grounding_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.array(*[F.lit(x) for x in ("La", "Le", "De", "The", "And", "Und", "Die")])
    unknown = F.sort_array(text.ungrounded(F.col("text"), known, "([A-Z][a-z]+)"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(unknown, "|").alias("unknown"), (F.size(unknown) == 0).alias("grounded"))


@query("""
WITH t AS (SELECT page_id, regexp_extract_all(url, '[0-9]+') AS l FROM pages)
SELECT page_id, array_to_string(list_transform(list_filter(l, lambda x, i: list_position(l, x) = i), lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS ids FROM t
""")
def extract_ids_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = text.ids_in_order(F.col("url"), "([0-9]+)")
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"))


@query(r"""
WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '^www\.', '') AS host FROM pages)
SELECT page_id, host, host IN ('example.com', 'example.org') OR host LIKE '%.example.com' OR host LIKE '%.example.org' AS allowed FROM h
""")
def host_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.host(url).alias("host"), text.allowed_host(url, ["example.com", "example.org"]).alias("allowed"))


@query("SELECT conv_id, turn, sha256(concat_ws('|', text, CAST(turn AS VARCHAR))) AS cache_key FROM conversations")
def sha_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.cache_key(F.col("text"), F.col("turn").cast("string")).alias("cache_key"))


def _scored_names(spark: SparkSession, sf_dir: str, score) -> DataFrame:
    """Parts with a score of their name (column ``name`` in ``score``); each distinct name is scored once.

    The name to score is an aggregate, so that no filter on the score moves below the grouping.
    """
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return parts.join(parts.groupBy("p_name").agg(F.any_value("p_name").alias("name")).select("p_name", score.alias("score")), "p_name")


@query("""
WITH q AS (SELECT list_distinct(list_filter(string_split(lower('which small blue widgit or hot gear?'), ''), lambda x: trim(x) <> '')) AS q),
n AS (SELECT p_partkey, list_distinct(list_filter(string_split(lower(p_name), ''), lambda x: trim(x) <> '')) AS l FROM part)
SELECT p_partkey, CASE WHEN len(l) > 0 THEN CAST(len(list_intersect(l, q)) AS DOUBLE) / len(l) ELSE 0.0 END AS overlap FROM n, q
""")
def char_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored_names(spark, sf_dir, similarity.char_overlap(F.col("name"), F.lit(QUERY_TEXT)))
    return scored.select("p_partkey", F.col("score").alias("overlap"))


@query(r"""
WITH g AS (SELECT p_name, flatten(list_transform(regexp_extract_all(lower(p_name), '[\p{L}\p{N}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))) AS b FROM (SELECT DISTINCT p_name FROM part)),
q AS (SELECT flatten(list_transform(regexp_extract_all('which small blue widgit or hot gear?', '[\p{L}\p{N}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))) AS b),
e AS (SELECT p_name, list_distinct(g.b) AS a, q.b AS b, unnest(range(1, len(q.b) + 1)) AS i FROM g, q),
f AS (SELECT p_name, a, b, i, unnest(range(i, len(b) + 1)) AS j FROM e),
x AS (SELECT p_name, len(a) AS na, len(list_distinct(b[i:j])) AS nb, len(list_intersect(a, list_distinct(b[i:j]))) AS k FROM f),
s AS (SELECT p_name, max(CAST(k AS DOUBLE) / (na + nb - k)) AS score FROM x GROUP BY p_name)
SELECT p_partkey, p_name, score FROM part JOIN s USING (p_name) WHERE score >= 0.4 ORDER BY score DESC, p_partkey LIMIT 15
""")
def trigram_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only names that share enough of their rarest trigrams with the question are scored."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    asked = spark.createDataFrame([(QUERY_TEXT,)], "text string")
    pairs = retrieval.trigram_pairs(parts.select(F.col("p_name").alias("text")), asked, 0.4)
    scores = pairs.select(F.col("short").alias("p_name"), similarity.word_similarity(F.col("short"), F.col("long")).alias("score"))
    return search.search(parts.join(scores.filter("score >= 0.4"), "p_name"), [F.desc("score"), F.col("p_partkey")], 15).select("p_partkey", "p_name", "score")


@query(r"""
WITH w AS (SELECT conv_id, turn, text, regexp_extract(text, '^(\pL+)', 1) AS a, regexp_extract(text, '(\pL+)\PL*$', 1) AS b FROM conversations),
n AS (
  SELECT conv_id, a AS name, turn, 0 AS slot, CASE WHEN turn % 3 = 0 THEN '/decks?id=' || turn WHEN turn % 3 = 1 THEN '/builds?hero=' || turn ELSE '/extras' END AS url FROM w WHERE turn % 4 <> 3
  UNION ALL SELECT conv_id, b, turn, 1, '/builds?hero=' || length(b) FROM w WHERE turn % 4 <> 3 AND turn % 3 = 1),
t AS (SELECT conv_id, map_from_entries(list((name, url))) AS m FROM (SELECT conv_id, name, arg_min(url, (turn, slot)) AS url FROM n WHERE name <> '' GROUP BY conv_id, name) GROUP BY conv_id),
x AS (SELECT w.conv_id, turn, m, '''' || a || ''' or ''' || b || ''': ' || text || chr(10) || '-  ' || b || ' : more' || chr(10) || '- ''' || a || ''': and' || chr(10) || '- none: ' || a AS t FROM w LEFT JOIN t USING (conv_id)),
q AS (SELECT conv_id, turn, m, regexp_split_to_array(t, '''[^'']+''') AS p, regexp_extract_all(t, '''([^'']+)''', 1) AS g FROM x),
r AS (SELECT conv_id, turn, m, p[1] || array_to_string(list_transform(g, lambda n, i: coalesce('[' || n || '](' || m[n] || ')', '''' || n || '''') || p[i + 1]), '') AS t FROM q),
l AS (SELECT conv_id, turn, m, regexp_split_to_array(t, '(?m)^-\s+[^:\n]+?:') AS p, regexp_extract_all(t, '(?m)^-\s+([^:\n]+?):', 1) AS g, regexp_extract_all(t, '(?m)^-\s+([^:\n]+?):') AS h FROM r)
SELECT conv_id, turn, p[1] || array_to_string(list_transform(g, lambda n, i: coalesce(CASE WHEN n LIKE '[%' THEN NULL ELSE '- [' || trim(n) || '](' || m[trim(n)] || '):' END, h[i]) || p[i + 1]), '') AS linked FROM l
""")
def insert_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that quote and list names, linked by the documents found for their conversation."""
    first, last = F.regexp_extract("text", r"^(\p{L}+)", 1), F.regexp_extract("text", r"(\p{L}+)\P{L}*$", 1)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", first.alias("a"), last.alias("b"))
    kind = F.when(F.col("turn") % 3 == 0, F.lit("deck")).when(F.col("turn") % 3 == 1, F.lit("build")).otherwise(F.lit("extra"))
    docs = turns.filter("turn % 4 <> 3").withColumns({"kind": kind, "source": F.when(kind == "deck", F.lit("decks"))})
    url = links.page_url(F.col("source"), F.col("kind"), F.col("turn"), {"decks": "/decks?id={}"}, {"build": "/builds?hero={}", "extra": "/extras"})
    hero = F.when(F.col("kind") == "build", links.page_url(F.col("source"), F.col("kind"), F.length("b"), {}, {"build": "/builds?hero={}"}))
    answer = F.concat(F.lit("'"), "a", F.lit("' or '"), "b", F.lit("': "), "text", F.lit("\n-  "), "b", F.lit(" : more\n- '"), "a", F.lit("': and\n- none: "), "a")
    linked = links.with_links(turns.withColumn("t", answer), docs, ["conv_id"], ["turn"], [(F.col("a"), url), (F.col("b"), hero)], "t", "linked")
    return linked.select("conv_id", "turn", "linked")


@query("""
SELECT p_partkey, p_name || ' (' || p_brand || ', size ' || p_size || ') costs ' || printf('%.2f', p_retailprice) AS content FROM part
""")
def doc_text_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = text.plain_number(F.col("p_retailprice"), 2)
    content = F.concat(F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(", size "), F.col("p_size").cast("string"), F.lit(") costs "), price)
    return table(spark, sf_dir, "part").select("p_partkey", content.alias("content"))


@query(r"""
WITH q AS (SELECT p_partkey AS qid, 'is a ' || p_name || ' of ' || p_type || ' any good?' AS question FROM part WHERE p_partkey % 20 = 0),
d AS (SELECT p_partkey AS id, ['a', 'b', 'c'][CAST(p_size % 3 AS INTEGER) + 1] AS kind, p_name AS name, [p_type, p_brand] AS extra, p_brand AS brand FROM part),
texts AS (SELECT DISTINCT name AS t FROM d UNION SELECT DISTINCT unnest(extra) FROM d),
tg AS (SELECT t, list_distinct(flatten(list_transform(regexp_extract_all(lower(t), '[\p{L}\p{N}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS a FROM texts),
qg AS (SELECT question, flatten(list_transform(regexp_extract_all(lower(question), '[\p{L}\p{N}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))) AS b FROM (SELECT DISTINCT question FROM q)),
e AS (SELECT question, t, a, b, unnest(range(1, len(b) + 1)) AS i FROM qg, tg),
f AS (SELECT question, t, a, b, i, unnest(range(i, len(b) + 1)) AS j FROM e WHERE list_contains(a, b[i])),
s AS (SELECT question, t, max(CAST(k AS DOUBLE) / (na + nb - k)) AS score FROM (SELECT question, t, len(a) AS na, len(list_distinct(b[i:j])) AS nb, len(list_intersect(a, list_distinct(b[i:j]))) AS k FROM f) GROUP BY question, t),
v AS (SELECT id, kind, brand, name AS t, 1.0::DOUBLE AS weight FROM d UNION ALL SELECT id, kind, brand, unnest(extra), 0.9::DOUBLE FROM d),
r AS (SELECT qid, id, kind, brand, max(score * weight) AS relevance FROM q JOIN s USING (question) JOIN v USING (t) GROUP BY ALL),
k AS (SELECT * FROM r WHERE relevance >= CASE kind WHEN 'a' THEN 0.6 ELSE 0.4 END),
c AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY qid, kind, brand ORDER BY relevance DESC, id) <= 2),
o AS (SELECT qid, id, kind, relevance, row_number() OVER (PARTITION BY qid, kind ORDER BY relevance DESC, id) AS rank FROM c)
SELECT qid, id, kind, relevance, CAST(rank AS INTEGER) AS rank FROM o WHERE rank <= CASE kind WHEN 'a' THEN 3 WHEN 'b' THEN 5 ELSE 1 END
""")
def retrieve_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions by every twentieth part against all parts: names and lists, thresholds, caps by brand, quotas by kind."""
    parts = table(spark, sf_dir, "part")
    asked = F.concat(F.lit("is a "), "p_name", F.lit(" of "), "p_type", F.lit(" any good?"))
    questions = parts.filter("p_partkey % 20 = 0").select(F.col("p_partkey").alias("qid"), asked.alias("question"))
    kind = F.when(F.col("p_size") % 3 == 0, "a").when(F.col("p_size") % 3 == 1, "b").otherwise("c")
    docs = parts.select(F.col("p_partkey").alias("id"), kind.alias("kind"), F.col("p_name").alias("name"), F.array("p_type", "p_brand").alias("extra"), F.col("p_brand").alias("brand"))
    fields = [retrieval.Field("name", "name"), retrieval.Field("extra", "list", 0.9)]
    found = retrieval.retrieve(questions, docs, "qid", "question", "id", "kind", fields, {"a": 3, "b": 5, "c": 1}, 0.4, {"a": 0.6}, "brand", 2)
    return found.select("qid", "id", "kind", "relevance", "rank")


@query("""
WITH w AS (SELECT p_partkey, string_split(p_name || chr(10) || p_type, ' ') AS w, CASE p_size % 3 WHEN 0 THEN [] WHEN 1 THEN ['"' || p_brand || '"?'] ELSE ['why ' || p_name, 'é?'] END AS f FROM part)
SELECT p_partkey, array_to_string(list_transform(w, lambda x, i: 'data: ' || replace(x, chr(10), '\\n') || CASE WHEN i < len(w) THEN ' ' ELSE '' END || chr(10) || chr(10)), '')
  || CASE WHEN len(f) > 0 THEN 'event: followups' || chr(10) || 'data: ' || CAST(to_json(f) AS VARCHAR) || chr(10) || chr(10) ELSE '' END || 'event: done' || chr(10) || 'data: [DONE]' || chr(10) || chr(10) AS body FROM w
""")
def sse_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event streams of names word by word, some with follow-up questions."""
    size = F.col("p_size") % 3
    asked = F.when(size == 0, F.array().cast("array<string>")).when(size == 1, F.array(F.concat(F.lit('"'), "p_brand", F.lit('"?')))).otherwise(F.array(F.concat(F.lit("why "), "p_name"), F.lit("é?")))
    words = text.emitted_words(F.concat("p_name", F.lit("\n"), "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", text.sse_frames(words, asked).alias("body"))
