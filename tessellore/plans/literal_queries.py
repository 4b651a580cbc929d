"""Queries over hand-made cases that the tables lack: links, Han text, guards, paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellore.functions import text, udf
from tessellore.plans.base import Registry

R = Registry()


def cases(spark, *values):
    return spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], "i int, a string, b string" if isinstance(values[0], tuple) else "i int, a string")


@R.query(r"SELECT * FROM (VALUES (0, 'papers/a', 'papers/a.md'), (1, 'topics/b', 'topics/b.md'), (2, 'x/y', 'x/y.md'), (3, 'notes/z', 'notes/z.md')) AS t(i, id, path)")
def concept_ids(spark, sf):
    c = cases(spark, "/papers/a.md", "topics/b", "x\\y.MD", "//notes/z.md")
    return c.select("i", text.concept_id(F.col("a")).alias("id"), text.concept_path(F.col("a")).alias("path"))


@R.query("SELECT * FROM (VALUES (0, 'topics/x,papers/p,papers/p2'), (1, ''), (2, 'a/b')) AS t(i, links)")
def links_extracted(spark, sf):
    c = cases(spark, ('[a](../topics/x.md) [b](/papers/p.md "t") [c](p2.md#s) [d](http://e.org/x.md) [e](../topics/x.md)', "papers/q.md"), ("[m](mailto:x@y.md) [f](#a) [i](a.png) [up](../../x.md)", "papers/q.md"), ("[a](./b.md)", "a/c.md"))
    return c.select("i", F.array_join(text.extract_links(F.col("a"), F.col("b")), ",").alias("links"))


@R.query("WITH c AS (SELECT * FROM (VALUES (0, '基因的表达'), (1, 'abc 基x因'), (2, 'latin only')) AS t(i, a)), h AS (SELECT i, regexp_extract_all(a, '\\p{Han}') AS h FROM c), k AS (SELECT i, unnest(h) AS token FROM h UNION ALL SELECT i, unnest(list_transform(range(1, greatest(len(h), 1)), lambda j: h[j] || h[j + 1])) FROM h) SELECT i, token FROM k WHERE token NOT IN ('的', '因')")
def han_tokens(spark, sf):
    return cases(spark, "基因的表达", "abc 基x因", "latin only").select("i", F.explode(text.han_tokens(F.col("a"))).alias("token"))


@R.query("SELECT * FROM (VALUES (0, true, false), (1, false, true), (2, false, true), (3, false, false), (4, true, false)) AS t(i, symbol, version)")
def merge_guards(spark, sf):
    c = cases(spark, ("COL5A1", "COL4A1"), ("Cellpose", "Cellpose 3"), ("FA", "FA v2.1"), ("abc", "abd"), ("IL-6", "IL-8"))
    return c.select("i", text.symbol_pair(F.col("a"), F.col("b")).alias("symbol"), (text.version_pair(F.col("a"), F.col("b")) & ~text.symbol_pair(F.col("a"), F.col("b"))).alias("version"))


@R.query("WITH w AS (SELECT * FROM (VALUES (0, 'kitten'), (1, 'aab')) AS t(i, a)), one AS (SELECT i, a AS v FROM w UNION SELECT i, substr(a, 1, k - 1) || substr(a, k + 1) FROM w, range(1, 7) r(k) WHERE k <= length(a)), two AS (SELECT i, v FROM one UNION SELECT i, substr(v, 1, k - 1) || substr(v, k + 1) FROM one, range(1, 7) r(k) WHERE k <= length(v)) SELECT DISTINCT i, v FROM two")
def deletion_variants(spark, sf):
    return cases(spark, "kitten", "aab").select("i", F.explode(text.deletion_variants(F.col("a"))).alias("v"))


@R.query("SELECT * FROM (VALUES (0, '{\"a\": 1}'), (1, '{\"b\": {\"c\": 2}}'), (2, NULL)) AS t(i, json)")
def json_objects(spark, sf):
    return cases(spark, 'Sure:\n```json\n{"a": 1}\n```', 'x {"b": {"c": 2}} y', "nothing").select("i", text.json_object(F.col("a")).alias("json"))


@R.query("SELECT * FROM (VALUES (0, 'answer'), (1, 'plain')) AS t(i, reply)")
def replies(spark, sf):
    return cases(spark, "<think>hm\nhm</think>\nanswer", "plain").select("i", text.strip_thinking(F.col("a")).alias("reply"))


@R.query("SELECT i, score::DOUBLE AS score FROM (VALUES (0, 1.0), (1, 0.95), (2, 0.88), (3, 0.55), (4, 0.2)) AS t(i, score)")
def biblio_scores(spark, sf):
    c = spark.createDataFrame([(0, True, 0.0, False), (1, False, 1.0, True), (2, False, 0.96, False), (3, False, 0.7, True), (4, False, 0.5, True)], "i int, d boolean, o double, y boolean")
    return c.select("i", F.round(text.biblio_score(F.col("d"), F.col("o"), F.col("y")), 6).alias("score"))


EXTRACT = "Before it. The quick brown fox, jumps over the lazy\n dog near the old river bank to-\nday. After."


@R.query("SELECT * FROM (VALUES (0, 'The quick brown fox, jumps'), (1, 'The quick brown fox, jumps over the lazy' || chr(10) || ' dog near the old river bank to-' || chr(10) || 'day.'), (2, NULL), (3, NULL), (4, NULL)) AS t(i, span)")
def snap_cases(spark, sf):
    """A quote by its words, one by its ends, and three that have no span: too short anchors, unknown words, nothing."""
    quotes = ("THE quick  brown fox jumps", "the quick brown fox leaps over a sleeping dog near the old river bank today", "the a of to in an on at", "nothing of the kind is said anywhere in this text", "")
    return cases(spark, *quotes).select("i", udf.snap_column(F.col("a"), F.lit(EXTRACT)).alias("span"))


@R.query("SELECT * FROM (VALUES (0, 'aaaa' || chr(10) || 'bb|cc'), (1, 'aaaaaaaaaa|bb'), (2, ''), (3, 'aaaaaa|bbbb')) AS t(i, parts)")
def segment_cases(spark, sf):
    """Cut at a blank line, hard, not at all, at a line."""
    def ten(value: str | None) -> list[str]:
        return udf.segments(value, 10)

    from pyspark.sql import types as T

    column = udf.column(ten, T.ArrayType(T.StringType()))
    return cases(spark, "aaaa\nbb\n\ncc", "a" * 10 + "bb", " \n ", "aaaaaa\nbbbb").select("i", F.array_join(column(F.col("a")), "|").alias("parts"))


@R.query("SELECT i, lengths FROM (VALUES (0, '401,10'), (1, '800,800,1,10'), (2, '790,20'), (3, '21')) AS t(i, lengths)")
def passage_cases(spark, sf):
    """Paragraphs join below 400 characters if they fit in 800; longer ones are cut."""
    texts = ("a" * 390 + "\n\n" + "b" * 10 + "\n\n" + "c" * 10, "a" * 1601 + "\n\n" + "b" * 10, "a" * 390 + "\n\n" + "b" * 399 + "\n\n" + "c" * 20, "a" * 10 + " \n \n\n" + "b" * 5 + " \n" + "c" * 4)
    lengths = F.transform(udf.passages_column(F.col("a")), lambda p: F.length(p).cast("string"))
    return cases(spark, *texts).select("i", F.array_join(lengths, ",").alias("lengths"))


@R.query(
    "SELECT * FROM (VALUES (0, 0, 'heading2', 'T'), (0, 1, 'paragraph', 'one' || chr(10) || 'two'), (0, 2, 'list', 'a' || chr(10) || 'b'), (0, 3, 'ordered-list', 'c'), (0, 4, 'quote', 'q' || chr(10) || 'r'), (0, 5, 'code', '# x'), (0, 6, 'rule', ''), (0, 7, 'table', 'h | i' || chr(10) || '1 | 2'),"
    " (1, 0, 'paragraph', '| no table |'), (1, 1, 'paragraph', '##### five' || chr(10) || '___')) AS t(i, pos, kind, body)"
)
def block_cases(spark, sf):
    texts = ("## T\none\ntwo\n- a\n* b\n1. c\n> q\n>r\n```x\n# x\n```\n***\n| h | i |\n|---|---|\n| 1 | 2 |\n", "| no table |\n\n##### five\n___")
    return cases(spark, *texts).select("i", F.posexplode(udf.blocks_column(F.col("a"))).alias("pos", "b")).select("i", "pos", "b.kind", F.col("b.text").alias("body"))


@R.query("SELECT * FROM (VALUES (0, 0, 'text', 'a ', NULL), (0, 1, 'strong', 'b', NULL), (0, 2, 'text', ' ', NULL), (0, 3, 'code', '*c*', NULL), (0, 4, 'link', 'd', '/papers/e.md'), (0, 5, 'text', 'alt', NULL), (0, 6, 'em', 'f', NULL), (0, 7, 'text', '.', NULL)) AS t(i, pos, kind, body, href)")
def inline_cases(spark, sf):
    return cases(spark, "a **b** `*c*`[d](/papers/e.md)![alt](x.png)_f_.").select("i", F.posexplode(udf.inlines_column(F.col("a"))).alias("pos", "b")).select("i", "pos", "b.kind", F.col("b.text").alias("body"), "b.href")
