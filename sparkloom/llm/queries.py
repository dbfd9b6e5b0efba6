"""Registered queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe_count, collocations, fingerprint, lm, mixing, packing, pii, positional, quality, sharding, simhash, token_store, trie
from sparkloom.llm.common import documents, scratch_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Where the public vocabularies are installed; see its README.
TOKENIZERS = "/opt/tokenizers"
#: How the byte-level vocabulary cuts words (fixed value).
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary(name: str) -> str:
    """Path of an installed vocabulary file."""
    try:
        import public_tokenizers
    except ImportError:
        return f"{TOKENIZERS}/{name}"
    return public_tokenizers.path(name)


def query(sql: str | None = None):
    """Register a function under its own name, with its DuckDB SQL if there is one."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, row_number() OVER () AS r,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT r, i, [w[i], w[i + 1], w[i + 2]] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
repeated AS (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM repeated GROUP BY r),
lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
s AS (
  SELECT doc_id, lower(trim(source)) AS host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN lines USING (r) LEFT JOIN covered USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
f AS (SELECT *, base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_words AS failed FROM b),
h AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(failed AS INTEGER)) AS DOUBLE) AS f FROM f WHERE host IS NOT NULL GROUP BY host),
m AS (SELECT sum(n) AS nn, sum(f) / sum(n) AS p, sum(n * n) AS n2, sum(f * f / n) AS ff, count(*) AS k FROM h),
v AS (SELECT *, p * (1 - p) AS c, (ff - nn * p * p - (k - 1) * p * (1 - p)) / nullif(nn - n2 / nn, 0) AS v FROM m),
prior AS (SELECT p, CASE WHEN v > 0 THEN greatest(c / v - 1, 0) END AS m FROM v),
rates AS (SELECT host, p, CASE WHEN m IS NULL THEN p ELSE (f + p * m) / (n + m) END AS rate FROM h, prior),
verdicts AS (SELECT host, rate, CASE WHEN rate * (1 - p) > 2 * p * (1 - rate) + 1e-9 THEN 'bad' WHEN rate > p + 1e-9 THEN 'watched' ELSE 'good' END AS verdict FROM rates)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(verdict = 'good' OR (verdict = 'watched' AND NOT failed), true) AS kept,
       host, round(rate, 6) AS host_fail_rate, verdict AS host_verdict
FROM f LEFT JOIN verdicts USING (host)
""")
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).withColumn("host_fail_rate", F.round("host_fail_rate", 6))


@query()
def op7_bpe_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.count_tokens(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), BYTE_PATTERN)


@query()
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json")))


@query()
def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-store")
    token_store.write_store(documents(spark, sf_dir), path, vocabulary("word_bpe_49k.json"))
    return token_store.with_starts(token_store.read_store(spark, path))


@query()
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@query()
def op5_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_neighbours(documents(spark, sf_dir))


@query()
def op6_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(documents(spark, sf_dir), 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query()
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(documents(spark, sf_dir))


@query()
def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(documents(spark, sf_dir), pii.session_key(spark), counted="n_replaced")


@query()
def op4_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


@query(r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(len(w), 10) AS k, list_slice(w, i, i + least(len(w), 10) - 1) AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM windows),
grams AS (SELECT r, i, k, list_slice(w, i, i + k - 1) AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
found AS (SELECT r, i, k, item FROM grams JOIN windows USING (k, g)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS p FROM found) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM found) GROUP BY r),
p AS (SELECT r, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM d),
counts AS (SELECT w, count(*) AS n FROM p GROUP BY w),
terms AS (SELECT item, w, row_number() OVER (PARTITION BY item ORDER BY n, w) AS k FROM (SELECT DISTINCT item, unnest(w) AS w FROM b) JOIN counts USING (w)),
rare AS (SELECT item, w, k FROM terms WHERE k <= 4 AND item IN (SELECT item FROM terms WHERE k = 4)),
near AS (
  SELECT r, count(DISTINCT item) AS n_near FROM (
    SELECT a.r, t.item, a.i FROM rare t JOIN p a USING (w) JOIN rare o ON o.item = t.item AND o.k > 1 JOIN p q ON q.r = a.r AND q.w = o.w AND q.i BETWEEN a.i - 20 AND a.i + 20
    WHERE t.k = 1 GROUP BY a.r, t.item, a.i HAVING count(DISTINCT o.k) = 3) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r) LEFT JOIN near USING (r)
""")
def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional.decontaminate(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), scratch_path(spark, "positional-index"))


@query(r"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, max(place) AS n FROM turns GROUP BY conv_id),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT))), lambda h, b: xor(t[(xor(h, b) & 255) + 1], h >> 8)), 4294967295) % 9 AS h
  FROM own, tab),
s AS (SELECT c.*, least(h, coalesce(o.n, 0)) AS taken FROM c LEFT JOIN own o ON o.conv_id = c.base),
r AS (
  SELECT s.conv_id, place AS depth, role, text FROM s JOIN turns t ON t.conv_id = s.base AND t.place <= s.h
  UNION ALL SELECT s.conv_id, taken + place - h, role, text FROM s JOIN turns t ON t.conv_id = s.conv_id AND t.place > s.h),
whole AS (SELECT s.conv_id, coalesce(w, []) AS w FROM s LEFT JOIN (SELECT conv_id, list(sha256(concat(octet_length(encode(role)), ' ', role, text)) ORDER BY depth) AS w FROM r GROUP BY conv_id) USING (conv_id)),
m AS (SELECT conv_id, d, w[:d] AS node, len(w) AS size FROM (SELECT conv_id, w, unnest(range(0, len(w) + 1)) AS d FROM whole)),
n AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CASE WHEN size = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM m GROUP BY node, d),
b AS (SELECT node, d, n.conv_id, n_convs, ends_sha256, coalesce(octet_length(encode(text)), 0) AS bytes FROM n LEFT JOIN r ON r.conv_id = n.conv_id AND r.depth = d),
k AS (SELECT node[:d - 1] AS node, d - 1 AS d, count(*) AS n_children FROM b WHERE d > 0 GROUP BY ALL),
e AS (SELECT b.*, coalesce(n_children, 0) AS n_children FROM b LEFT JOIN k USING (node, d)),
below AS (SELECT node[:up] AS node, up AS d, sum(CAST(n_children = 0 AS INTEGER)) AS n_leaves, sum((n_convs - 1) * bytes) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM e) GROUP BY ALL)
SELECT e.conv_id, CAST(e.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, e.n_convs, e.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, e.ends_sha256
FROM e JOIN below USING (node, d) LEFT JOIN e p ON e.d > 0 AND p.d = e.d - 1 AND p.node = e.node[:e.d - 1]
""")
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


@query(r"""
WITH pieces AS (
  SELECT row_number() OVER () AS r, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
p AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces)),
total AS (SELECT lang, count(*) AS n FROM p GROUP BY lang),
one AS (SELECT lang, w1, count(*) AS f FROM p GROUP BY ALL),
two AS (SELECT lang, w1, w2, count(*) AS f FROM p WHERE w2 IS NOT NULL GROUP BY ALL),
three AS (SELECT lang, w1, w2, w3, count(*) AS f FROM p WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
longer AS (SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM three UNION ALL SELECT lang, w2, w3, f FROM three) GROUP BY ALL),
cuts AS (
  SELECT t.lang, concat_ws(' ', t.w1, t.w2) AS phrase, t.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM two t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1 JOIN one y ON y.lang = t.lang AND y.w1 = t.w2 LEFT JOIN longer g ON g.lang = t.lang AND g.w1 = t.w1 AND g.w2 = t.w2
  WHERE t.f >= 10 AND NOT coalesce(100 * g.f >= 50 * t.f, false)
  UNION ALL SELECT t.lang, concat_ws(' ', t.w1, t.w2, t.w3), t.f, 1, x.f, y.f FROM three t JOIN one x ON x.lang = t.lang AND x.w1 = t.w1 JOIN two y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL SELECT t.lang, concat_ws(' ', t.w1, t.w2, t.w3), t.f, 2, x.f, y.f FROM three t JOIN two x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN one y ON y.lang = t.lang AND y.w1 = t.w3),
scored AS (SELECT *, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
""")
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(documents(spark, sf_dir))
