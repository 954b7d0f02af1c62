"""The registered training-data queries ``opN_<name>`` and ``pipeline``, with oracle SQL where SQL can say it.

Each query is thin: it reads the whole intended table, applies one operator and derives the digest columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from commentlab.llm import alignment, fixity, hard_negatives, line_dedup, mixing, ngram_join, packing, pii, quality, sharding, token_counts, topk, url_filter
from commentlab.sources.tables import table

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return deco


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", spread_by=False)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages", spread_by=False)


URL_SQL = r"""
WITH RECURSIVE rules(verdict, rh, rp) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
tags AS (
  SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM pages),
targets AS (
  SELECT url, replace(CASE
    WHEN regexp_matches(tag, '(?i)\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
    WHEN regexp_matches(tag, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1)
    END, '&amp;', '&') AS t FROM tags),
links AS (
  SELECT url, CASE WHEN t LIKE '%://%' THEN t
    WHEN t LIKE '//%' THEN regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || t
    WHEN t LIKE '/%' THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || t
    WHEN length(regexp_extract(url, '(?s)^(.*?://[^?#]*/)', 1)) > length(regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1))
      THEN regexp_extract(url, '(?s)^(.*?://[^?#]*/)', 1) || t
    ELSE regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || '/' || t END AS target
  FROM targets WHERE t <> ''),
urls AS (SELECT url FROM pages UNION SELECT target FROM links),
parts AS (
  SELECT url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
         regexp_replace(regexp_replace(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1),
           '(?:^|&)(?:utm_[a-z]+|ref|gclid|fbclid)=[^&]*', '', 'g'), '^&', '') AS rest
  FROM urls),
nodes AS (
  SELECT url, coalesce(host, '') AS host, coalesce(path, '') AS path,
         CASE WHEN host <> '' THEN host || path || CASE WHEN rest <> '' THEN '?' || rest ELSE '' END END AS node FROM parts),
fits AS (
  SELECT n.url, r.rh || r.rp AS rule, r.verdict, row_number() OVER (PARTITION BY n.url ORDER BY length(r.rh || r.rp) DESC, r.verdict, r.rh) AS k
  FROM nodes n JOIN rules r ON (n.host = r.rh OR n.host LIKE '%.' || r.rh) AND starts_with(n.path, r.rp) WHERE n.host <> ''),
edges AS (
  SELECT a.node AS a, b.node AS b FROM links l JOIN nodes a ON a.url = l.url JOIN nodes b ON b.url = l.target
  WHERE a.node IS NOT NULL AND b.node IS NOT NULL AND a.node <> b.node),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (
  SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.other),
decided AS (
  SELECT r.node, bool_or(f.verdict = 'block') AS blocks, bool_or(f.verdict = 'allow') AS allows
  FROM reach r JOIN nodes n ON n.node = r.other JOIN fits f ON f.url = n.url AND f.k = 1 GROUP BY r.node)
SELECT p.page_id, coalesce(n.host, '') AS host, coalesce(n.path, '') AS path, f.rule,
       coalesce(f.verdict, CASE WHEN d.blocks AND NOT coalesce(d.allows, FALSE) THEN 'block' END, 'allow') AS verdict
FROM pages p LEFT JOIN nodes n ON n.url = p.url LEFT JOIN fits f ON f.url = p.url AND f.k = 1
LEFT JOIN decided d ON d.node = n.node
"""


@query("op1_redirect_equivalence", URL_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_pages(spark, sf_dir), url_filter.rules_table(spark))


TOPK_SQL = """
WITH usable AS (
  SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: CAST(floor(256.0::DOUBLE * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.rn, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND c.rn <> q.rn)
SELECT query_id, CAST(row_number() OVER (PARTITION BY rn ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY rn ORDER BY score DESC, vec_id) <= 5
"""


@query("op3_nra_top_k", TOPK_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings", spread_by=False))
    return topk.top_k(vectors, F.col("id") % 50 == 0)


FIXITY_SQL = r"""
WITH bodies AS (
  SELECT page_id, url, coalesce(html, '') AS html,
         coalesce(CASE WHEN page_id % 97 = 13 THEN substr(html, 1, length(html) - 1) || chr(0) ELSE html END, '') AS copy FROM pages),
stored AS (
  SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
           || chr(13) || chr(10) || 'Content-Length: ' AS head, chr(13) || chr(10) || chr(13) || chr(10) AS gap, html, copy FROM bodies),
records AS (
  SELECT page_id, page_id // 1000 AS archive, head || strlen(html) || gap || html || gap AS a, head || strlen(copy) || gap || copy || gap AS b FROM stored),
laid AS (
  SELECT page_id, archive, a, b, CAST(coalesce(sum(strlen(a)) OVER (PARTITION BY archive ORDER BY page_id, sha256(a) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
  FROM records)
SELECT archive, pos AS "offset", page_id AS record_id, CASE WHEN page_id % 193 = 7 THEN 'missing' ELSE 'changed' END AS kind,
       CAST(strlen(a) AS BIGINT) AS length_a, CASE WHEN page_id % 193 <> 7 THEN CAST(strlen(b) AS BIGINT) ELSE 0 END AS length_b,
       sha256(a) AS digest_a, CASE WHEN page_id % 193 <> 7 THEN sha256(b) END AS digest_b
FROM laid WHERE page_id % 193 = 7 OR a <> b
"""


@query("op4_merkle_fixity", FIXITY_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixity.audit(*fixity.damaged_pair(_pages(spark, sf_dir)))


@query("op2_round_robin_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_docs(spark, sf_dir), with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")


@query("op5_divergence_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_docs(spark, sf_dir))


@query("op6_multi_order_join")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_components(_docs(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


@query("op7_jump_shards")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(_docs(spark, sf_dir))
    return placed.select(
        F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


@query("op8_skip_chain_crf")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(_docs(spark, sf_dir))

    def joined(spans):
        parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(parts, ",")

    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(k) for k in pii.KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('20240:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM sources),
capped AS (
  SELECT *, source_size * 3 AS cap, CAST(source_size * 3 AS DOUBLE) / CAST(weight AS DOUBLE) AS ratio FROM weighed),
levels AS (
  SELECT *, CAST((SELECT sum(source_size) FROM sources)
         - coalesce(sum(cap) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / CAST(sum(weight) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lvl
  FROM capped),
hold AS (SELECT lvl FROM levels WHERE lvl <= ratio ORDER BY ratio, lvl LIMIT 1),
targets AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), (SELECT lvl FROM hold) * CAST(weight AS DOUBLE)) AS target
  FROM levels),
scanned AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized),
wholes AS (
  SELECT s.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole
  FROM scanned s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(size * (whole + CASE WHEN 2 * before + size < 2.0 * (target - whole * source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       source, CAST(whole + CASE WHEN 2 * before + size < 2.0 * (target - whole * source_size) THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM wholes
"""


@query("op9_mix_sources", MIX_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies"
    )


LINES_SQL = r"""
WITH all_lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS i
  FROM documents),
worded AS (
  SELECT doc_id, text, i, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS l FROM all_lines
  WHERE trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
win AS (
  SELECT doc_id, i AS first, lead(i, 2) OVER d AS last, l AS a, lead(l, 1) OVER d AS b, lead(l, 2) OVER d AS c
  FROM worded WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
ranked AS (
  SELECT doc_id, first, last, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, first) AS n
  FROM win WHERE c IS NOT NULL),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM ranked WHERE n > 1),
kept AS (
  SELECT a.doc_id, string_agg(a.line, chr(10) ORDER BY a.i) FILTER (WHERE g.i IS NULL) AS text,
         count(*) AS n_lines, count(g.i) AS n_removed
  FROM all_lines a LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.i = g.i GROUP BY a.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


@query("op10_line_windows", LINES_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_docs(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_removed")


@query("op11_end_index_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_docs(spark, sf_dir))


NEGATIVES_SQL = """
WITH usable AS (
  SELECT row_number() OVER () AS rn, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256.0::DOUBLE * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.rn, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM usable a JOIN usable c ON a.vec_id % 100 = 0 AND c.rn <> a.rn),
positives AS (
  SELECT rn, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY rn ORDER BY score DESC, vec_id) AS place
  FROM pairs WHERE same QUALIFY place <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.rn = p.rn AND NOT n.same AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
WINDOW best AS (PARTITION BY p.rn, p.place ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER best <= 5
"""


@query("op12_cover_tree_negatives", NEGATIVES_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.integer_rows(table(spark, sf_dir, "embeddings", spread_by=False), moved)
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)


@query("op13_heap_token_counts")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_docs(spark, sf_dir))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
