"""One query per operator, over its whole table with production parameters, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, lines, media, packing, pieces, quality, secrets, simhash, toxicity, warc
from .util import table


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93).select("vec_id", "n_links", "component_id", "kept")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated_lines(table(spark, sf_dir, "documents"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id", "kept")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).withColumn("start", F.col("start").cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": op1, "op2_line_dedup": op2, "op3_quality_classifier": op3, "op4_media_tiff": op4, "op5_secret_scans": op5,
    "op6_warc": op6, "op7_simhash_near_dedup": op7, "op8_toxicity": op8, "op9_sentencepiece": op9, "op10_best_fit_packing": op10,
}

ORACLE_SQL = {
    "op1_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, c.component_id, vec_id = c.component_id AS kept
FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op2_line_dedup": """
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
o AS (SELECT doc_id, unnest(range(len(ls))) AS no, unnest(ls) AS line FROM s),
w AS (SELECT doc_id, no, line, list_sort(list_distinct(list_filter(string_split(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    '), ' '), lambda x: x <> ''))) AS ws FROM o),
f AS (SELECT ws, min(struct_pack(d := doc_id, n := no)) AS f FROM w WHERE len(ws) >= 1 GROUP BY ws),
g AS (SELECT row_number() OVER (ORDER BY f) AS id, ws, f FROM f),
u AS (SELECT id, len(ws) AS n, unnest(ws) AS w FROM g),
p AS (SELECT b.id, b.n, a.n AS m, count(*) AS c FROM u a JOIN u b ON a.w = b.w AND a.id < b.id AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) GROUP BY a.id, b.id, a.n, b.n),
x AS (SELECT DISTINCT id FROM p WHERE c >= 0.8 * (n + m - c)),
gone AS (SELECT w.doc_id, w.no FROM w JOIN g USING (ws) LEFT JOIN x ON x.id = g.id WHERE x.id IS NOT NULL OR struct_pack(d := w.doc_id, n := w.no) > g.f),
r AS (SELECT doc_id, count(*) AS n, string_agg(CAST(no AS VARCHAR), ',' ORDER BY no) AS removed FROM gone GROUP BY doc_id)
SELECT s.doc_id, CAST(len(ls) AS INTEGER) AS n_lines, CAST(coalesce(r.n, 0) AS INTEGER) AS n_removed, coalesce(removed, '') AS removed
FROM s LEFT JOIN r ON r.doc_id = s.doc_id""",
    "op6_warc": """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)""",
}
