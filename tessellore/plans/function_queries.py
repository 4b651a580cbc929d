"""Text functions over the given tables: paths, links, guards, replies, scores, blocks of made bodies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellore.functions import text, udf
from tessellore.operators import resolve
from tessellore.plans import lens
from tessellore.plans.base import Registry

R = Registry()


def _orders(spark, sf):
    return lens.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))


def _parts(spark, sf):
    return lens.table(spark, sf, "part").withColumnRenamed("p_partkey", "k")


@R.query("SELECT o_orderkey AS k, 'papers/o' || o_orderkey AS id, 'papers/o' || o_orderkey || '.md' AS path FROM orders")
def order_paths(spark, sf):
    """One concept, written in four ways."""
    k = F.col("k")
    raw = F.when(k % 4 == 0, F.format_string("/papers/o%d.md", k)).when(k % 4 == 1, F.format_string("papers\\o%d.MD", k)).when(k % 4 == 2, F.format_string("//papers/o%d", k)).otherwise(F.format_string("papers/o%d", k))
    return _orders(spark, sf).select("k", text.concept_id(raw).alias("id"), text.concept_path(raw).alias("path"))


@R.query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'topics/t' || o_orderkey % 7 || ',papers/o' || (o_orderkey + 1) || ',papers/p' || o_orderkey % 5 END AS links FROM orders")
def order_links(spark, sf):
    """Links up, from the root, beside the page and out of the library; every third page has none that counts."""
    k = F.col("k")
    some = F.format_string('[a](../topics/t%d.md) [b](/papers/o%d.md "t") [c](p%d.md#s) [d](http://e.org/x.md) [e](../topics/t%d.md)', k % 7, k + 1, k % 5, k % 7)
    body = F.when(k % 3 == 0, "[m](mailto:x@y.md) [f](#a) [i](a.png) [up](../../x.md)").otherwise(some)
    return _orders(spark, sf).select("k", F.array_join(text.extract_links(body, F.format_string("papers/o%d.md", k)), ",").alias("links"))


_BARE = "regexp_replace({0}, '[^A-Za-z0-9]+', '', 'g')"
_STEM = "trim(regexp_replace(lower({0}), '[\\s._-]*v?\\d+(\\.\\d+)*$', ''))"


@R.query(
    "WITH c AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 1 THEN p_brand ELSE p_name END AS a, CASE p_partkey % 3 WHEN 0 THEN p_name || ' v' || p_size || '.1' WHEN 1 THEN 'Brand#' || p_size ELSE p_type END AS b FROM part)"
    f" SELECT k, regexp_matches({_BARE.format('a')}, '[0-9]') AND regexp_matches({_BARE.format('b')}, '[0-9]') AND length({_BARE.format('a')}) <= 16 AND length({_BARE.format('b')}) <= 16 AND {_BARE.format('a')} <> {_BARE.format('b')} AS symbol, {_STEM.format('a')} <> '' AND {_STEM.format('a')} = {_STEM.format('b')} AND replace(a, ' ', '') <> replace(b, ' ', '') AS version FROM c"
)
def part_guards(spark, sf):
    """Names and their versions, numbered brands, and unlike names."""
    k = F.col("k")
    a = F.when(k % 3 == 1, F.col("p_brand")).otherwise(F.col("p_name"))
    b = F.when(k % 3 == 0, F.concat("p_name", F.lit(" v"), "p_size", F.lit(".1"))).when(k % 3 == 1, F.concat(F.lit("Brand#"), "p_size")).otherwise(F.col("p_type"))
    return _parts(spark, sf).select("k", text.symbol_pair(a, b).alias("symbol"), text.version_pair(a, b).alias("version"))


@R.query("WITH w AS (SELECT DISTINCT p_name AS a FROM part), one AS (SELECT a, a AS v FROM w UNION SELECT a, substr(a, 1, k - 1) || substr(a, k + 1) FROM w, range(1, 80) r(k) WHERE k <= length(a)), two AS (SELECT a, v FROM one UNION SELECT a, substr(v, 1, k - 1) || substr(v, k + 1) FROM one, range(1, 80) r(k) WHERE k <= length(v)) SELECT a, v FROM two")
def name_variants(spark, sf):
    """Every name with up to two letters left out."""
    return lens.table(spark, sf, "part").select(F.col("p_name").alias("a")).distinct().select("a", F.explode(text.deletion_variants(F.col("a"))).alias("v"))


@R.query("SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN '{\"k\": ' || o_orderkey || '}' WHEN 1 THEN '{\"b\": {\"c\": ' || o_orderkey || '}}' END AS json, CASE WHEN o_orderkey % 3 = 2 THEN 'none ' || o_orderkey ELSE 'answer ' || o_orderkey END AS reply FROM orders")
def order_answers(spark, sf):
    """JSON in fences, within prose or missing; replies with and without thoughts."""
    k = F.col("k")
    said = F.when(k % 3 == 0, F.format_string('Sure:\n```json\n{"k": %d}\n```', k)).when(k % 3 == 1, F.format_string('x {"b": {"c": %d}} y', k)).otherwise(F.lit("nothing"))
    reply = F.when(k % 3 == 2, F.format_string("none %d", k)).otherwise(F.format_string("<think>hm\n%d</think>\nanswer %d", k, k))
    return _orders(spark, sf).select("k", text.json_object(said).alias("json"), text.strip_thinking(reply).alias("reply"))


@R.query("WITH c AS (SELECT o_orderkey AS k, o_orderkey % 17 = 0 AS d, (o_orderkey % 101) / 100.0::DOUBLE AS o, o_orderkey % 2 = 0 AS y FROM orders) SELECT k, round(CASE WHEN d THEN 1.0 WHEN o >= 0.95 AND y THEN 0.95 WHEN o >= 0.95 THEN 0.88 WHEN o >= 0.6 AND y THEN 0.55 ELSE least(o * 0.4, 0.4) END::DOUBLE, 6) AS score FROM c")
def order_biblio_scores(spark, sf):
    k = F.col("k")
    return _orders(spark, sf).select("k", F.round(text.biblio_score(k % 17 == 0, (k % 101).cast("double") / 100.0, k % 2 == 0), 6).alias("score"))


@R.query(
    "WITH b AS (SELECT p_partkey AS k, unnest([{'pos': 0, 'kind': 'heading2', 'body': p_name}, {'pos': 1, 'kind': 'paragraph', 'body': p_type || chr(10) || 'two'}, {'pos': 2, 'kind': 'list', 'body': p_brand || chr(10) || 'b'}, {'pos': 3, 'kind': 'ordered-list', 'body': 'c'}, {'pos': 4, 'kind': 'quote', 'body': p_name || chr(10) || 'r'}, {'pos': 5, 'kind': 'code', 'body': '# ' || p_size}, {'pos': 6, 'kind': 'rule', 'body': ''}, {'pos': 7, 'kind': 'table', 'body': 'h | i' || chr(10) || p_size || ' | 2'}]) AS x FROM part)"
    " SELECT k, x.pos AS pos, x.kind AS kind, x.body AS body FROM b"
)
def part_blocks(spark, sf):
    """A page of every kind of block for each part."""
    body = F.concat(F.lit("## "), "p_name", F.lit("\n"), "p_type", F.lit("\ntwo\n- "), "p_brand", F.lit("\n* b\n1. c\n> "), "p_name", F.lit("\n>r\n```x\n# "), "p_size", F.lit("\n```\n***\n| h | i |\n|---|---|\n| "), "p_size", F.lit(" | 2 |\n"))
    return _parts(spark, sf).select("k", F.posexplode(udf.blocks_column(body)).alias("pos", "b")).select("k", "pos", "b.kind", F.col("b.text").alias("body"))


@R.query("SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'both' WHEN 1 THEN 'both' WHEN 3 THEN 'left' ELSE 'right' END AS keep FROM part")
def part_suggestions(spark, sf):
    """Catalogue symbols, versions, a title within a longer one on either side, and equal titles."""
    k, n = F.col("k"), F.col("p_name")
    left = F.when(k % 5 == 0, F.format_string("AB%dX1", k)).when(k % 5 == 3, F.concat(n, F.lit(" kit"))).otherwise(n)
    right = F.when(k % 5 == 0, F.format_string("AB%dX2", k)).when(k % 5 == 1, F.concat(n, F.lit(" 3"))).when(k % 5 == 2, F.concat(n, F.lit(" kit"))).when(k % 5 == 3, n).otherwise(F.concat(F.lit("The "), n))
    reason = F.when(k % 5 < 2, "edit-distance:1").when(k % 5 < 4, "token:contain").otherwise("align:title")
    return _parts(spark, sf).select("k", resolve.suggestion(reason, left, right).alias("keep"))


@R.query("SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 1 THEN 'no heading for pages 2,' || (p_size + 2) WHEN 2 THEN 'hardly any text for pages 2' END AS problem FROM part")
def part_transcripts(spark, sf):
    """Transcripts that are whole, lack pages, or have one that is as good as empty."""
    k = F.col("k")
    first = F.concat(F.lit("### Page 1\nlong enough text of "), "p_name")
    page = F.when(k % 3 == 0, F.concat(first, F.lit("\n### Page 2\nalso long enough"))).when(k % 3 == 1, first).otherwise(F.concat(first, F.lit("\n### Page 2\n tiny ")))
    pages = F.when(k % 3 == 1, F.array(F.lit(1), F.lit(2), F.col("p_size") + 2)).otherwise(F.array(F.lit(1), F.lit(2)))
    return _parts(spark, sf).select("k", text.vision_problem(page, pages).alias("problem"))
