"""One query per training-data operator over the driver tables, with a SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scoreloom.llm.decontaminate import leaks
from scoreloom.llm.fingerprint import edit_fingerprints
from scoreloom.llm.jaccard import jaccard_components
from scoreloom.llm.lexical import rank_documents
from scoreloom.llm.mixing import mix_sources
from scoreloom.llm.negatives import hard_negatives
from scoreloom.llm.packing import pack_documents
from scoreloom.llm.passages import repeated_passages
from scoreloom.llm.secrets import scan_secrets
from scoreloom.llm.sharding import assign_shards
from scoreloom.llm.token_counts import count_tokens
from scoreloom.llm.toxicity import fit_model, toxicity_scores
from scoreloom.llm.urls import judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql.strip()
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op10_jaccard_join", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * p.c >= 90 * (na.n + nb.n - p.c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.b AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = d.doc_id
""")
def op10(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"), width=3, num=9, den=10)


@query("op9_secret_scan")
def op9(spark, sf_dir):
    return scan_secrets(table(spark, sf_dir, "documents"))


@query("op1_token_packing")
def op1(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))


@query("op2_extendible_shards", """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
b AS (SELECT l.range AS depth, h >> (60 - l.range) AS prefix, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs
  FROM d, range(0, 33) l GROUP BY ALL),
leaf AS (SELECT b.* FROM b LEFT JOIN b up ON up.depth = b.depth - 1 AND up.prefix = b.prefix >> 1
  WHERE b.shard_bytes <= 1048576 AND (b.depth = 0 OR up.shard_bytes > 1048576))
SELECT doc_id, bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth::INTEGER, '0') END AS shard, depth::INTEGER AS depth, shard_bytes, shard_docs
FROM d JOIN leaf ON d.h >> (60 - leaf.depth) = leaf.prefix
""")
def op2(spark, sf_dir):
    return assign_shards(table(spark, sf_dir, "documents"))


@query("op3_source_mix", r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
  [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS weight FROM d GROUP BY source),
q AS (SELECT source_size / weight AS ratio, sum(source_size) AS size, sum(weight) AS w FROM s GROUP BY 1),
f AS (SELECT ratio, ((SELECT sum(source_size) FROM s) * 150 / 100 - coalesce(sum(size) OVER before, 0) * 2)
    / ((SELECT sum(weight) FROM s) - coalesce(sum(w) OVER before, 0)) AS level
  FROM q WINDOW before AS (ORDER BY ratio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(level, ratio) AS level FROM f WHERE level <= ratio * 2),
t AS (SELECT source, source_size, CASE WHEN level IS NULL OR weight * level > source_size * 2 THEN source_size * 2.0::DOUBLE ELSE weight * level END AS target FROM s, l),
r AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
  row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, md5(coalesce(d.doc_id::VARCHAR, '-')), d.doc_id) - 1 AS place,
  CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS step,
  ('0x' || substr(md5('17:' || coalesce('s' || d.source, '-')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (floor(u + (place + 1) * step) - floor(u + place * step))::BIGINT AS copies FROM r)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM c
""")
def op3(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents"))


@query("op4_toxicity")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity_scores(docs, fit_model(docs, table(spark, sf_dir, "labels")))


@query("op5_url_filter")
def op5(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"))


@query("op6_decontamination", r"""
WITH t AS (SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
  UNION ALL SELECT 'i', item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') FROM benchmark),
s AS (SELECT kind, id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END) AS g FROM t),
m AS (SELECT id, count(*) AS item_shingles FROM s WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, any_value(item_shingles) AS item_shingles, count(*) AS shared, count(*) / any_value(item_shingles) AS containment
FROM s d JOIN s i ON d.g = i.g AND d.kind = 'd' AND i.kind = 'i' JOIN m ON m.id = i.id
GROUP BY d.id, i.id HAVING count(*) * 5 >= any_value(item_shingles) * 4
""")
def op6(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_syncmer_fingerprints")
def op7(spark, sf_dir):
    return edit_fingerprints(table(spark, sf_dir, "documents"))


@query("op8_repeated_passages")
def op8(spark, sf_dir):
    return repeated_passages(table(spark, sf_dir, "documents"))


@query("op11_token_counts")
def op11(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"))


@query("op12_hard_negatives", """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT * FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, pos.other AS positive_id,
  (row_number() OVER (PARTITION BY p.anchor_id, pos.other ORDER BY p.score DESC, p.other))::INTEGER AS rank,
  p.other AS negative_id, pos.score AS positive_score, p.score AS negative_score
FROM p JOIN pos ON p.anchor_id = pos.anchor_id AND NOT p.same AND 50 * pos.score <= 100 * p.score AND 100 * p.score <= 95 * pos.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, pos.other ORDER BY p.score DESC, p.other) <= 3
""")
def op12(spark, sf_dir):
    return hard_negatives(table(spark, sf_dir, "embeddings"))


@query("op13_lexical_search", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
i AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
c AS (SELECT doc_id, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0),
g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM c),
f AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS t FROM d) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM f, g GROUP BY t),
s AS (SELECT item_id, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::BIGINT AS score
  FROM f JOIN i USING (t) JOIN w USING (t) JOIN c USING (doc_id), g GROUP BY ALL)
SELECT item_id, (row_number() OVER best)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER best <= 20
""")
def op13(spark, sf_dir):
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
