"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, chat, collocations, license_scan, line_dedup, minhash, mixing, packing, quality, secret_scan, suffix_dedup, token_alignment, token_counts
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licences(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_report(table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_report(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op9_audio_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings rendered from all vectors; every hundredth is searched among all."""
    return audio.align(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", is_query=F.col("rec_id") % 100 == 0, vectors=True, min_votes=0).withColumnRenamed("rec_id", "vec_id")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocation_report(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_license_scan": op2_license_scan,
    "op3_token_counts": op3_token_counts,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_near_dedup": op6_near_dedup,
    "op7_source_mixing": op7_source_mixing,
    "op8_quality_rules": op8_quality_rules,
    "op9_audio_alignment": op9_audio_alignment,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_line_dedup": op11_line_dedup,
    "op12_collocations": op12_collocations,
    "op13_token_alignment": op13_token_alignment,
}

#: All shingles of all documents, all pairs that share one, components by closure.
NEAR_ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+2], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
#: All strings of 100 bytes (200 hexadecimal digits) of all documents.
REPEAT_ORACLE = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h, length(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents),
s AS (SELECT doc_id, i AS start, md5(substr(h, 2 * i + 1, 200)) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100)),
f AS (SELECT doc_id, start, row_number() OVER (PARTITION BY g ORDER BY doc_id, start) > 1 AS again FROM s),
o AS (SELECT doc_id, start, start + 100 AS stop, max(start + 100) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f WHERE again),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start) AS k FROM o),
r AS (SELECT doc_id, k, min(start) AS a, max(stop) AS b FROM g GROUP BY doc_id, k),
t AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id),
q AS (SELECT doc_id, a, b, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS later, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS k FROM r),
kept AS (SELECT q.doc_id, string_agg(CASE WHEN k = 1 THEN substr(h, 1, 2 * a) ELSE '' END || substr(h, 2 * b + 1, 2 * (coalesce(later, n) - b)), '' ORDER BY k) AS h FROM q JOIN d ON d.doc_id = q.doc_id GROUP BY q.doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op5_suffix_dedup": REPEAT_ORACLE, "op6_near_dedup": NEAR_ORACLE, "op8_quality_rules": quality.ORACLE, "op10_chat_formatting": chat.ORACLE, "op11_line_dedup": line_dedup.ORACLE, "op12_collocations": collocations.ORACLE}
