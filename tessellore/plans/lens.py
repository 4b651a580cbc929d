"""Presents the star-schema tables as a document library.

The texts are SQL that both engines read; they define inputs only, never an operator.
Orders are papers, product attributes and parties are hubs, line items are claims. Links
say the types of their ends, so a plan that needs some types reads only their branches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

_SLUG = "lower(replace(replace({0}, '#', '-'), ' ', '-'))"


def _hub(kind: str, folder: str, column: str, table: str) -> str:
    slug = _SLUG.format(column)
    return f"SELECT DISTINCT concat('{folder}/', {slug}) AS id, '{kind}' AS type, {column} AS title, CAST(NULL AS STRING) AS published, 'stable' AS status, CAST(NULL AS STRING) AS tag, CAST(NULL AS STRING) AS paper, CAST(NULL AS STRING) AS confidence, CAST(NULL AS STRING) AS stance FROM {table}"


PAPERS = """SELECT concat('papers/o', CAST(o_orderkey AS STRING)) AS id, 'Paper' AS type, concat('Order ', CAST(o_orderkey AS STRING)) AS title,
  CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS published,
  CASE o_orderstatus WHEN 'F' THEN 'stable' WHEN 'O' THEN 'draft' ELSE 'deprecated' END AS status, lower(o_orderpriority) AS tag,
  CAST(NULL AS STRING) AS paper, CAST(NULL AS STRING) AS confidence, CAST(NULL AS STRING) AS stance FROM orders"""
CLAIMS = """SELECT concat('claims/o', CAST(l_orderkey AS STRING), '--', CAST(l_linenumber AS STRING)) AS id, 'Claim' AS type,
  concat('Claim ', CAST(l_orderkey AS STRING), ' ', CAST(l_linenumber AS STRING)) AS title, CAST(NULL AS STRING) AS published,
  'stable' AS status, CAST(NULL AS STRING) AS tag, concat('papers/o', CAST(l_orderkey AS STRING)) AS paper,
  CASE WHEN min(l_discount) = 0.1 THEN 'disputed' WHEN min(l_linestatus) = 'F' THEN 'reviewed' ELSE 'extracted' END AS confidence,
  CASE min(l_returnflag) WHEN 'A' THEN 'reports' WHEN 'N' THEN 'result' ELSE 'limitation' END AS stance
  FROM lineitem GROUP BY l_orderkey, l_linenumber"""
NODES = " UNION ALL ".join(
    [
        PAPERS,
        CLAIMS,
        _hub("Topic", "topics", "p_type", "part"),
        _hub("Method", "methods", "p_brand", "part"),
        _hub("Gene", "genes", "p_name", "part"),
        _hub("Dataset", "datasets", "s_name", "supplier"),
        _hub("Entity", "entities", "c_name", "customer"),
        _hub("Pathway", "pathways", "r_name", "region"),
    ]
)
_PART = "lineitem JOIN part ON l_partkey = p_partkey"
_PAPER = "concat('papers/o', CAST({0} AS STRING))"
EDGES = " UNION ALL ".join(
    [
        *(f"SELECT DISTINCT {_PAPER.format('l_orderkey')} AS src, concat('{folder}/', {_SLUG.format(c)}) AS dst, 'Paper' AS src_type, '{kind}' AS dst_type FROM {_PART}" for kind, folder, c in (("Topic", "topics", "p_type"), ("Method", "methods", "p_brand"), ("Gene", "genes", "p_name"))),
        f"SELECT DISTINCT concat('datasets/', {_SLUG.format('s_name')}) AS src, {_PAPER.format('l_orderkey')} AS dst, 'Dataset' AS src_type, 'Paper' AS dst_type FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
        f"SELECT {_PAPER.format('o_orderkey')} AS src, concat('entities/', {_SLUG.format('c_name')}) AS dst, 'Paper' AS src_type, 'Entity' AS dst_type FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey % 10 <> 0",
        f"SELECT {_PAPER.format('o_orderkey')} AS src, concat('pathways/', {_SLUG.format('r_name')}) AS dst, 'Paper' AS src_type, 'Pathway' AS dst_type FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_custkey % 10 <> 0",
        f"SELECT DISTINCT concat('claims/o', CAST(l_orderkey AS STRING), '--', CAST(l_linenumber AS STRING)) AS src, {_PAPER.format('l_orderkey')} AS dst, 'Claim' AS src_type, 'Paper' AS dst_type FROM lineitem",
    ]
)
#: The text library: documents as extracts, labels as their status, benchmark items as quotes.
EXTRACTS = """SELECT concat('extracts/d', CAST(d.doc_id AS STRING)) AS id, 'TextExtract' AS type, d.text AS body, d.lang, d.source,
  CASE WHEN l.toxic = 1 THEN 'deprecated' WHEN l.quality = 0 THEN 'draft' ELSE 'stable' END AS status
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""

#: For oracles: the same inputs as common table expressions.
CTE = f"WITH RECURSIVE nodes AS MATERIALIZED ({NODES}), edges AS MATERIALIZED ({EDGES})"
TEXT_CTE = f"WITH RECURSIVE extracts AS ({EXTRACTS})"


def _sql(spark: SparkSession, sf_dir: str, text: str, tables: tuple[str, ...]) -> DataFrame:
    """Runs the text over the tables of one folder, without any view left in the session."""
    return spark.sql(_named(text, tables), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def _named(text: str, tables: tuple[str, ...]) -> str:
    import re

    for t in tables:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return text


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.when(F.col("tag").isNotNull(), F.array("tag")).otherwise(F.array().cast("array<string>"))
    return _sql(spark, sf_dir, NODES, ("region", "customer", "supplier", "part", "orders", "lineitem")).withColumn("tags", tags)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, EDGES, TABLES)


def extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, EXTRACTS, ("documents", "labels")).withColumn("title", F.split("body", "\n")[0])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
