"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_queries, importance, language, line_dedup, media, mixing, near_dedup, quality_rules, toxicity, url_filter
from .common import read

#: Host, path and verdict of the rules that the contract of op5 fixes.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_by_document(mixing.mix(read(spark, sf_dir, "documents")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_held_out(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_held_out(read(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(read(spark, sf_dir, "pages"), rules)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_documents(read(spark, sf_dir, "documents"), tokenizer_path())
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), words=2)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.media_columns(read(spark, sf_dir, "documents"))
    tail = F.expr("substring(payload, length(payload) - 15, 16)")
    return out.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.lit("logmel-"), F.sha2("tensors", 256), F.lit("-segments-"), F.size("segments").cast("string")).alias("feature"),
    )


def op9_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return importance.resample(docs, importance.good_documents(docs, read(spark, sf_dir, "labels")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_report(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "n_near")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_toxicity": op2_toxicity,
    "op3_quality_rules": op3_quality_rules,
    "op4_language": op4_language,
    "op5_url_filters": op5_url_filters,
    "op6_bpe": op6_bpe,
    "op7_near_dedup": op7_near_dedup,
    "op8_media": op8_media,
    "op9_importance": op9_importance,
    "op10_line_dedup": op10_line_dedup,
} | chat_queries.QUERIES

OP5_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r(rhost, rpath, verdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), m AS (
  SELECT n, max(struct_pack(l := length(rhost || rpath), rule := rhost || rpath, verdict := verdict)) AS best
  FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM h LEFT JOIN m USING (n)
"""

OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT n, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM d
), c AS (
  SELECT n, doc_id, len(g) AS size, list_sort(g) AS g FROM s
), nodes AS (
  SELECT g, min(n) AS node, min(doc_id) AS first_id, any_value(size) AS size FROM c WHERE size > 0 GROUP BY g
), e AS (
  SELECT node, unnest(g) AS x FROM nodes
), p AS (
  SELECT a.node AS a, b.node AS b, count(*) AS shared FROM e a JOIN e b ON a.x = b.x AND a.node < b.node GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN nodes x ON x.node = a JOIN nodes y ON y.node = b WHERE 100 * shared >= 80 * (x.size + y.size - shared)
), l2 AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), reach(a, b) AS (
  SELECT node, node FROM nodes UNION SELECT r.a, l2.b FROM reach r JOIN l2 ON r.b = l2.a
), comp AS (
  SELECT r.a AS node, min(y.first_id) AS component_id FROM reach r JOIN nodes y ON y.node = r.b GROUP BY r.a
)
SELECT c.doc_id, CAST(c.size AS BIGINT) AS n_shingles, coalesce(component_id, c.doc_id) AS component_id, c.doc_id = coalesce(component_id, c.doc_id) AS kept
FROM c LEFT JOIN nodes ON c.g = nodes.g AND c.size > 0 LEFT JOIN comp ON comp.node = nodes.node
"""

#: DuckDB's levenshtein counts bytes, so letters outside ASCII are mapped to one byte each first; the table's languages have
#: no others.
OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, pos - 1 AS pos, trim(line) AS line FROM (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))
), f AS (
  SELECT line, min(struct_pack(d := doc_id, p := pos)) AS own FROM l WHERE line <> '' GROUP BY line
), t AS (
  SELECT line, own, length(line) AS n, translate(line, 'ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü', chr(1) || chr(2) || chr(3) || chr(4) || chr(5) || chr(6) || chr(7) || chr(8) || chr(14) || chr(15) || chr(16) || chr(17) || chr(18) || chr(19) || chr(20) || chr(21) || chr(22) || chr(23) || chr(24) || chr(25) || chr(26)) AS m FROM f WHERE length(line) >= 30
), k AS (
  SELECT a.line, min(b.own) AS near FROM t a JOIN t b ON b.n BETWEEN a.n - 2 AND a.n + 2 AND a.line <> b.line AND b.own < a.own
  WHERE levenshtein(a.m, b.m) <= 2 GROUP BY a.line
), z AS (
  SELECT f.line, f.own, least(f.own, coalesce(k.near, f.own)) AS first FROM f LEFT JOIN k USING (line)
), g AS (
  SELECT l.doc_id, count(*) AS n_removed, count(*) FILTER (struct_pack(d := l.doc_id, p := l.pos) = z.own) AS n_near
  FROM l JOIN z USING (line) WHERE struct_pack(d := l.doc_id, p := l.pos) > z.first GROUP BY l.doc_id
)
SELECT doc_id, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_near, 0) AS n_near
FROM documents LEFT JOIN g USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op5_url_filters": OP5_SQL, "op7_near_dedup": OP7_SQL, "op10_line_dedup": OP10_SQL} | chat_queries.ORACLE_SQL
