"""Queries over pages that change: links, write path, merges, and what readers and models are shown."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellore.functions import text
from tessellore.operators import compile as compiling
from tessellore.operators import align, context, coverage, graph, integrity, links, merge, pages, resolve, search, survey
from tessellore.plans import lens
from tessellore.plans.base import Registry
from tessellore.plans.library_queries import ALLOWED, BASE, CTE, DEGREE, HUBS, RANK, TOPIC, both
from tessellore.storage import cut

R = Registry()
ORDER_ID = "concat('papers/o', o_orderkey)"


def _orders(spark, sf):
    k = F.col("o_orderkey")
    return lens.table(spark, sf, "orders").withColumn("id", F.concat(F.lit("papers/o"), k.cast("string"))).withColumn("k", k)


# links --------------------------------------------------------------------------------
#: Each order's page links its neighbours in the table, an invented page and a page elsewhere.
BODIES = "b AS (SELECT concat('papers/o', o_orderkey) AS id, o_orderkey AS k, '[next](/papers/o' || (o_orderkey + 1) || '.md) and [gone](topics/none.md#x), see [web](https://e.org/a.md).' AS body FROM orders)"


def _bodies(spark, sf):
    return _orders(spark, sf).select("id", "k", F.format_string("[next](/papers/o%d.md) and [gone](topics/none.md#x), see [web](https://e.org/a.md).", F.col("k") + 1).alias("body"))


@R.query(f"WITH {BODIES} SELECT id, 0 AS pos, 'next' AS label, 'papers/o' || (k + 1) || '.md' AS target FROM b UNION ALL SELECT id, 1, 'gone', 'topics/none.md' FROM b")
def body_links(spark, sf):
    return links.body_links(_bodies(spark, sf))


@R.query(f"WITH {BODIES} SELECT id, CASE WHEN (k + 1) % 5 = 0 THEN replace(body, '/papers/o' || (k + 1) || '.md', '/papers/n' || (k + 1) || '.md') ELSE body END AS body FROM b")
def rewritten_links(spark, sf):
    moves = spark.range(0, 1).select(F.lit("x").alias("old"), F.lit("y").alias("new")).unionByName(_orders(spark, sf).select(((F.col("k") + 1).cast("string")).alias("n"), ((F.col("k") + 1) % 5).alias("r")).filter("r = 0").select(F.concat(F.lit("papers/o"), "n").alias("old"), F.concat(F.lit("papers/n"), "n").alias("new")))
    return links.rewrite_links(_bodies(spark, sf).select("id", "body"), moves)


@R.query(f"WITH {BODIES}, o AS (SELECT o_orderkey AS k FROM orders) SELECT id, CASE WHEN (SELECT count(*) FROM o WHERE o.k = b.k + 1) = 0 THEN 'next' ELSE '[next](/papers/o' || (k + 1) || '.md)' END || ' and [gone](topics/none.md#x), see [web](https://e.org/a.md).' AS body FROM b")
def legal_cites(spark, sf):
    return links.strip_illegal_cites(_bodies(spark, sf).select("id", "body"), _orders(spark, sf).select("id"))


SANITIZED = [
    ("a", "[Spatial](/topics/spatial.md) [two](topics/ambi.md) [my paper](/paper/invented.md) [other](/papers/zzz.md) [kept](/topics/spatial-omics.md#s)", "papers/2020-my-paper-on-cells.md"),
    ("b", "[x](/domains/y.md) [img](a.png) [me](/papers/2021-stories.md) [STORIES](/papers/wrong.md)", "papers/2021-stories.md"),
]
FILES = ["topics/spatial-omics.md", "topics/ambiguous.md", "topics/ambivalent.md", "papers/2020-my-paper-on-cells.md", "topics/deep/spatial-x.md.bak"]


def _sanitize(spark):
    bodies = spark.createDataFrame(SANITIZED, "id string, body string, paper string")
    return bodies, spark.createDataFrame([(f,) for f in FILES], "path string")


@R.query(
    "SELECT * FROM (VALUES ('a', 0, 'align', 'topics/spatial-omics.md'), ('a', 1, 'unlink', NULL), ('a', 2, 'paper', 'papers/2020-my-paper-on-cells.md'), ('a', 3, 'unlink', NULL), ('a', 4, 'keep', 'topics/spatial-omics.md'),"
    " ('b', 0, 'unlink', NULL), ('b', 2, 'keep', 'papers/2021-stories.md'), ('b', 3, 'paper', 'papers/2021-stories.md')) AS t(id, pos, action, target)"
)
def sanitized_links(spark, sf):
    bodies, files = _sanitize(spark)
    return links.sanitize_links(links.body_links(bodies), files, bodies).select("id", "pos", "action", F.col("into").alias("target"))


@R.query(
    "SELECT * FROM (VALUES ('a', '[Spatial](/topics/spatial-omics.md) two [my paper](/papers/2020-my-paper-on-cells.md) other [kept](/topics/spatial-omics.md#s)'),"
    " ('b', 'x [img](a.png) [me](/papers/2021-stories.md) [STORIES](/papers/2021-stories.md)')) AS t(id, body)"
)
def sanitized_bodies(spark, sf):
    return links.sanitize_bodies(*_sanitize(spark))


#: Pages of all hubs, one link to each under a wrong slug: the label finds the hub again, or the page is to be made.
@R.query(f"{CTE} SELECT id, CASE WHEN length(title) % 2 = 0 THEN 'align' ELSE 'stub' END AS action, CASE WHEN length(title) % 2 = 0 THEN id || '.md' END AS target FROM nodes WHERE type IN ('Method', 'Dataset')")
def guarded_links(spark, sf):
    hubs = lens.nodes(spark, sf).filter(F.col("type").isin("Method", "Dataset")).select("id", "type", F.concat("id", F.lit(".md")).alias("path"), "title", F.array().cast("array<string>").alias("aliases"))
    label = F.when(F.length("title") % 2 == 0, F.col("title")).otherwise(F.concat(F.lit("unheard of "), F.reverse("title")))
    bodies = hubs.select("id", F.concat(F.lit("["), label, F.lit("](/"), F.regexp_extract("path", "^([^/]*)/", 1), F.lit("/lost-"), F.regexp_extract("path", "([^/]*)$", 1), F.lit(")")).alias("body"))
    guarded = links.guard_links(links.body_links(bodies), hubs.select("path"), hubs)
    return guarded.select("id", "action", F.col("into").alias("target"))


# write path ---------------------------------------------------------------------------
BOUND = "e AS (SELECT o_orderkey AS k, 'extracts/' || o_orderkey || '.md' AS path, CASE WHEN o_orderkey % 6 = 0 THEN 'papers/o' || o_orderkey WHEN o_orderkey % 6 = 1 THEN 'papers/lost' END AS paper, CASE WHEN o_orderkey % 6 IN (0, 3) THEN 'sources/' || o_orderkey || '.pdf' END AS resource, CASE WHEN o_orderkey % 6 IN (3, 4) THEN 'doi:10.1/' || o_orderkey END AS doi FROM orders)"


@R.query(
    f"WITH {BOUND} SELECT path, CASE k % 6 WHEN 5 THEN NULL ELSE 'papers/o' || k END AS paper, CASE k % 6 WHEN 5 THEN NULL ELSE '10.1/' || k END AS doi,"
    " CASE k % 6 WHEN 0 THEN 'paper' WHEN 1 THEN 'pipeline' WHEN 2 THEN 'pipeline' WHEN 3 THEN 'resource' WHEN 4 THEN 'doi' END AS bound_by, k % 6 <> 5 AS changed FROM e"
)
def bound_extracts(spark, sf):
    """Extracts find their papers by name, pipeline record, resource and DOI, in this order."""
    o, k = _orders(spark, sf), F.col("k")
    s = k.cast("string")
    source = F.concat(F.lit("sources/"), s, F.lit(".pdf"))
    extracts = o.select(
        F.concat(F.lit("extracts/"), s, F.lit(".md")).alias("path"),
        F.when(k % 6 == 0, F.col("id")).when(k % 6 == 1, F.lit("papers/lost")).alias("paper"),
        F.when((k % 6).isin(0, 3), source).alias("resource"),
        F.when((k % 6).isin(3, 4), F.concat(F.lit("doi:10.1/"), s)).alias("doi"),
    )
    papers = o.select("id", F.concat(F.lit("10.1/"), s).alias("doi"), F.array(source).alias("resources"))
    state = o.filter((k % 6).isin(1, 2)).select(F.concat(F.lit("/extracts/"), s, F.lit(".md")).alias("extract"), F.concat("id", F.lit(".md")).alias("paper"))
    return compiling.bind_extracts(extracts, papers, state)


TARGETS = [
    ("extracts/a.md", "sources/pdfs/first-upload-of-2020.pdf", "Deep cells", "papers/2020-deep-cells.md"),
    ("extracts/b.md", "sources/pdfs/upload-number-two.pdf", "Other work on migration", None),
    ("extracts/c.md", "sources/pdfs/upload-number-three.pdf", "Thirdly and lastly", None),
    ("extracts/d.md", "sources/pdfs/2019-tissue-atlas-of-mice.pdf", "scanned pages 0001", None),
    ("extracts/e.md", "sources/pdfs/upload-number-five.pdf", "The twin of another", None),
    ("extracts/f.md", "sources/pdfs/upload-number-six.pdf", "The twin of another", None),
]
SELECTORS = ("extracts/a", "/Upload-Number-Two.pdf", "2020-deep-cells", "papers/2021-recorded", "papers/2022-by-resource", "papers/2018-other-work-on-migration", "2019-tissue-atlas-of-mice-and-men", "2000-the-twin-of-another", "papers/nothing-like-it-at-all")


@R.query(
    "SELECT * FROM (VALUES ('extracts/a', 'extracts/a.md', 'papers/2020-deep-cells.md', 'extract'), ('/Upload-Number-Two.pdf', 'extracts/b.md', NULL, 'source'), ('2020-deep-cells', 'extracts/a.md', 'papers/2020-deep-cells.md', 'paper'),"
    " ('papers/2021-recorded', 'extracts/c.md', 'papers/2021-recorded.md', 'pipeline'), ('papers/2022-by-resource', 'extracts/e.md', 'papers/2022-by-resource.md', 'resource'), ('papers/2022-by-resource', 'extracts/f.md', 'papers/2022-by-resource.md', 'resource'),"
    " ('papers/2018-other-work-on-migration', 'extracts/b.md', 'papers/2018-other-work-on-migration.md', 'title'), ('2019-tissue-atlas-of-mice-and-men', 'extracts/d.md', NULL, 'slug')) AS t(selector, extract, paper, matched_by)"
)
def compile_targets(spark, sf):
    targets = spark.createDataFrame(TARGETS, "extract string, source string, title string, paper string")
    papers = spark.createDataFrame([("papers/2022-by-resource", "R", ["sources/pdfs/upload-number-five.pdf", "sources/pdfs/upload-number-six.pdf"]), ("papers/2018-other-work-on-migration", "Other work on migration", [])], "id string, title string, resources array<string>")
    state = spark.createDataFrame([("/extracts/c.md", "papers/2021-recorded.md")], "extract string, paper string")
    out = None
    for selector in SELECTORS:
        found = compiling.compile_targets(targets, selector, papers, state).select(F.lit(selector).alias("selector"), "extract", "paper", "matched_by")
        out = found if out is None else out.unionByName(found)
    return out


ITEMS = "i AS (SELECT p_size % 7 AS doc, p_partkey % 5 AS segment, p_partkey AS pos, 'Topic' AS kind, CASE WHEN p_partkey % 3 = 0 THEN upper(p_type) ELSE 'The ' || p_type END AS title, [lower(p_brand)] AS tags, '<' || p_partkey || '>' AS body FROM part)"


@R.query(
    f"WITH {ITEMS}, k AS (SELECT *, regexp_replace(regexp_replace(lower(title), '^(the|an|a)\\s+', ''), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS key FROM i)"
    " SELECT doc, kind, key, arg_min(title, segment * 1000000 + pos) AS title, string_agg(body, chr(10) || chr(10) ORDER BY segment, pos) AS body, count(DISTINCT tags[1])::INT AS n_tags FROM k GROUP BY doc, kind, key"
)
def merged_segments(spark, sf):
    p = lens.table(spark, sf, "part")
    title = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_type")).otherwise(F.concat(F.lit("The "), "p_type"))
    items = p.select((F.col("p_size") % 7).alias("doc"), (F.col("p_partkey") % 5).alias("segment"), F.col("p_partkey").alias("pos"), F.lit("Topic").alias("kind"), title.alias("title"), F.array(F.lower("p_brand")).alias("tags"), F.format_string("<%d>", "p_partkey").alias("body"))
    return compiling.merge_segment_concepts(items).select("doc", "kind", "key", "title", "body", F.size("tags").alias("n_tags"))


@R.query("WITH c AS (SELECT item_id % 4 AS doc, item_id % 3 AS segment, item_id AS pos, 'Claim ' || item_id AS title, CASE WHEN item_id % 5 = 0 THEN '' ELSE '“' || replace(substr(text, 1, 20), ' ', '  ') || '”' END AS quote FROM benchmark), k AS (SELECT *, CASE WHEN quote <> '' THEN trim(lower(regexp_replace(regexp_replace(regexp_replace(quote, '-\\s+([a-z])', '\\1', 'g'), '[.,;:()\\[\\]\"''“”‘’…]', '', 'g'), '\\s+', ' ', 'g'))) ELSE lower(title) END AS key FROM c) SELECT doc, key, arg_min(title, segment * 1000000 + pos) AS title FROM k WHERE key <> '' GROUP BY doc, key")
def merged_claims(spark, sf):
    b, i = lens.table(spark, sf, "benchmark"), F.col("item_id")
    claims = b.select((i % 4).alias("doc"), (i % 3).alias("segment"), i.alias("pos"), F.concat(F.lit("Claim "), i.cast("string")).alias("title"), F.when(i % 5 == 0, "").otherwise(F.concat(F.lit("“"), F.replace(F.substring("text", 1, 20), F.lit(" "), F.lit("  ")), F.lit("”"))).alias("quote"))
    return compiling.merge_segment_claims(claims).select("doc", "key", "title")


PAGE_SQL = "p AS (SELECT p_partkey AS k, 'topics/p' || p_partkey || '.md' AS path, p_name AS title, 'Body ' || p_partkey AS body FROM part)"


@R.query(
    f"WITH {PAGE_SQL} SELECT path, CASE WHEN k % 4 = 0 THEN 'skipped' WHEN k % 4 = 1 THEN 'updated' ELSE 'written' END AS action, CASE WHEN k % 4 < 2 THEN 'Old ' || k ELSE title END AS title, CASE WHEN k % 4 = 0 THEN 'old' WHEN k % 4 = 1 THEN 'old,new' ELSE 'new' END AS tags,"
    " CASE WHEN k % 4 < 2 THEN title || ',alias' ELSE '' END AS aliases, CASE WHEN k % 4 = 0 THEN 'Kept [p](/papers/q.md)' || chr(10) || chr(10) || '- [Paper](/papers/n.md)' || chr(10) WHEN k % 4 = 1 THEN body || chr(10) || chr(10) || '- [Paper](/papers/n.md)' || chr(10) || chr(10) || '- [p](/papers/q.md)' || chr(10) ELSE body || chr(10) || chr(10) || '- [Paper](/papers/n.md)' || chr(10) END AS body FROM p"
)
def upserted_pages(spark, sf):
    """Every fourth page is verified, every fourth is there, the others are new."""
    k = F.col("p_partkey")
    path = F.format_string("topics/p%d.md", k)
    p = lens.table(spark, sf, "part")
    incoming = p.select(path.alias("path"), F.col("p_name").alias("title"), F.col("p_name").alias("incoming_title"), F.array(F.lit("new")).alias("tags"), F.concat(F.lit("Body "), k.cast("string")).alias("body"), F.lit("Paper").alias("paper_title"), F.lit("/papers/n.md").alias("paper_href"))
    existing = p.filter(k % 4 < 2).select(path.alias("path"), F.concat(F.lit("Old "), k.cast("string")).alias("title"), F.array(F.lit("old")).alias("tags"), F.array("p_name", F.lit("alias")).alias("aliases"), F.lit("Kept [p](/papers/q.md)\n").alias("body"), (k % 4 == 0).alias("verified"))
    out = compiling.upsert_pages(incoming, existing)
    return out.select("path", "action", "title", F.array_join("tags", ",").alias("tags"), F.array_join("aliases", ",").alias("aliases"), "body")


@R.query(
    "WITH i AS (SELECT p_partkey AS k, p_name AS name, p_name || 's' AS title, p_brand AS tag, 'Body ' || p_partkey || '.' AS body, '/papers/p' || lpad(p_partkey::VARCHAR, 7, '0') || '.md' AS href, length(p_name) % 2 = 0 AS there FROM part),"
    " g AS (SELECT 'topics/' || replace(CASE WHEN there THEN name ELSE title END, ' ', '-') || '.md' AS path, bool_or(there) AS there, min(name) AS name, min(title) AS title, string_agg(body, chr(10) || chr(10) ORDER BY href) || string_agg(chr(10) || chr(10) || '- [P' || k || '](' || href || ')', '' ORDER BY href) || chr(10) AS body, list_sort(list_distinct(list(tag))) AS tags, count(*) AS n FROM i GROUP BY 1)"
    " SELECT path, CASE WHEN there THEN 'updated' ELSE 'written' END AS action, CASE WHEN there THEN name ELSE title END AS title, CASE WHEN there THEN title ELSE '' END AS aliases, CASE WHEN there THEN regexp_replace(body, chr(10) || '$', '') || chr(10) || chr(10) || '- [Old](/papers/old.md)' || chr(10) ELSE body END AS body, array_to_string(tags, ',') AS tags, n FROM g"
)
def compiled_collisions(spark, sf):
    """Many papers name one hub, by the plural of its title where it is there: all bodies, tags and links are kept."""
    from pyspark.sql import types as T

    from tessellore import schema
    from tessellore.api import Library

    k, name = F.col("p_partkey"), F.col("p_name")
    part = lens.table(spark, sf, "part")
    items = part.select(F.concat(name, F.lit("s")).alias("title"), F.lit("Topic").alias("type"), F.array("p_brand").alias("tags"), F.format_string("Body %d.", k).alias("body"), F.format_string("P%d", k).alias("paper_title"), F.format_string("/papers/p%07d.md", k).alias("paper_href"))
    path = F.concat(F.lit("topics/"), F.replace(name, F.lit(" "), F.lit("-")), F.lit(".md"))
    held = part.filter(F.length(name) % 2 == 0).select(name.alias("title"), path.alias("path")).distinct()
    given = {"id": F.regexp_replace("path", r"\.md$", ""), "path": F.col("path"), "type": F.lit("Topic"), "title": F.col("title"), "status": F.lit("stable"), "body": F.lit("- [Old](/papers/old.md)\n"), "tags": F.array().cast("array<string>"), "aliases": F.array().cast("array<string>"), "verified_human": F.lit(False)}
    shape = T.StructType.fromDDL(schema.CONCEPTS)
    concepts = held.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in shape.fields])
    out = Library(concepts).compile(items)
    return out.select("path", "action", "title", F.array_join("aliases", ",").alias("aliases"), "body", F.array_join(F.array_sort("tags"), ",").alias("tags"), F.regexp_count("body", F.lit(r"\]\(/papers/p")).cast("long").alias("n"))


@R.query("SELECT 'claims/b' || item_id || '--claim-' || item_id || '.md' AS path, CASE WHEN item_id % 2 = 1 THEN 'omitted' WHEN item_id % 6 = 0 THEN 'skipped' ELSE 'written' END AS action, CASE WHEN item_id % 2 = 0 THEN text END AS quote FROM benchmark")
def written_claims(spark, sf):
    """Quotes with other blanks and marks snap back to what the text says; odd items' texts don't hold them."""
    b, i = lens.table(spark, sf, "benchmark"), F.col("item_id").cast("string")
    paper = F.concat(F.lit("papers/b"), i)
    claims = b.select(paper.alias("paper"), F.lit("P").alias("paper_title"), F.concat(F.lit(" Claim "), i).alias("title"), F.concat(F.lit("“"), F.replace("text", F.lit(" "), F.lit("  ")), F.lit("”")).alias("quote"), F.lit("").alias("note"))
    texts = b.select(paper.alias("paper"), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("Before it. "), "text", F.lit(" After."))).otherwise("Nothing of the kind.").alias("extract"))
    held = b.filter("item_id % 6 = 0").select(F.concat(F.lit("claims/b"), i, F.lit("--claim-"), i, F.lit(".md")).alias("path"), F.lit(False).alias("verified"), F.lit("reviewed").alias("confidence"))
    return compiling.write_claims(claims, texts, held).select("path", "action", F.trim("quote").alias("quote"))


@R.query("SELECT id AS path, title, coalesce(confidence, 'extracted') AS confidence FROM (" + lens.CLAIMS + ") WHERE paper = 'papers/o1'")
def claims_of_paper(spark, sf):
    return compiling.claims_of(lens.nodes(spark, sf).withColumn("path", F.col("id")), "papers/o1")


@R.query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m') || '-01' WHEN 1 THEN strftime(o_orderdate, '%Y') || '-01-01' WHEN 2 THEN '2011-01-01' END AS published FROM orders")
def published_of(spark, sf):
    o, k = lens.table(spark, sf, "orders"), F.col("o_orderkey") % 4
    model = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM")).when(k == 1, "no date")
    name = F.when(k == 1, F.concat(F.lit("paper_"), F.date_format("o_orderdate", "yyyy"), F.lit("_v12345.pdf"))).otherwise("x20119.pdf")
    return o.select("o_orderkey", compiling.published_of(model, name, F.when(k == 2, "D:20110203").otherwise("")).alias("published"))


# merges -------------------------------------------------------------------------------
@R.query(
    "WITH p AS (SELECT p_partkey AS k, 'topics/p' || p_partkey || '.md' AS path FROM part) SELECT path, CASE WHEN k % 3 = 0 THEN 'added' WHEN k % 3 = 1 THEN 'skipped' ELSE 'merged' END AS action, CASE WHEN k % 3 = 0 THEN 'new' ELSE 'old' END AS title, CASE WHEN k % 3 = 0 THEN 'n' ELSE 'o,n' END AS tags, k % 3 = 1 AS conflict,"
    " CASE k % 3 WHEN 0 THEN 'In [n](/papers/n.md)' WHEN 1 THEN 'Own [o](/papers/o.md)' || chr(10) || chr(10) || '- [n](/papers/n.md)' || chr(10) ELSE 'In [n](/papers/n.md)' || chr(10) || chr(10) || '- [o](/papers/o.md)' || chr(10) END AS body FROM p"
)
def merged_hubs(spark, sf):
    p, k = lens.table(spark, sf, "part"), F.col("p_partkey")
    path = F.format_string("topics/p%d.md", k).alias("path")
    source = p.select(path, F.lit("new").alias("title"), F.array(F.lit("n")).alias("tags"), F.lit("In [n](/papers/n.md)").alias("body"))
    dest = p.filter(k % 3 > 0).select(path, F.lit("old").alias("title"), F.array(F.lit("o")).alias("tags"), F.lit("Own [o](/papers/o.md)").alias("body"), (k % 3 == 1).alias("verified"))
    out = merge.merge_hubs(source, dest)
    return out.select("path", "action", "title", F.array_join("tags", ",").alias("tags"), "conflict", "body")


@R.query(
    "WITH o AS (SELECT o_orderkey AS k FROM orders) SELECT CASE WHEN k % 4 = 3 THEN 'path:claims/s' || k || '.md' ELSE 'title:papers/' || CASE WHEN k % 2 = 0 THEN 'n' ELSE 'o' END || k || '|claim-' || k END AS key, CASE WHEN k % 4 = 3 THEN 'claims/s' || k || '.md' WHEN k % 4 = 0 THEN 'claims/n' || k || '--claim-' || k || '.md' ELSE 'claims/d' || k || '.md' END AS path,"
    " CASE k % 4 WHEN 1 THEN 'skipped' WHEN 2 THEN 'merged' ELSE 'added' END AS action, CASE WHEN k % 4 = 3 THEN NULL WHEN k % 2 = 0 THEN 'papers/n' || k ELSE 'papers/o' || k END AS paper, k % 4 = 1 AS conflict FROM o"
)
def merged_claim_pages(spark, sf):
    o, k = _orders(spark, sf), F.col("k")
    s = k.cast("string")
    title = F.when(k % 4 != 3, F.concat(F.lit("Claim "), s)).alias("title")
    owner = lambda letter: F.when(k % 4 != 3, F.concat(F.lit(f"papers/{letter}"), s))
    source = o.select(F.format_string("claims/s%d.md", k).alias("path"), owner("o").alias("paper"), title, F.lit("q").alias("quote"), F.lit("new").alias("body"))
    dest = o.filter((k % 4).isin(1, 2)).select(F.format_string("claims/d%d.md", k).alias("path"), F.when(k % 2 == 0, owner("n")).otherwise(owner("o")).alias("paper"), title, F.lit("q").alias("quote"), F.lit("old").alias("body"), F.lit(False).alias("verified"), F.when(k % 4 == 1, "reviewed").otherwise("extracted").alias("confidence"))
    moves = o.filter(k % 2 == 0).select(F.col("id").alias("old"), F.concat(F.lit("papers/n"), s).alias("new"))
    return merge.merge_claims(source, dest, moves).select("key", "path", "action", "paper", "conflict")


@R.query("SELECT * FROM (VALUES ('surveys/a.md', 'added', 'new', false), ('surveys/b.md', 'merged', 'mine' || chr(10) || '<!-- generated:cov -->' || chr(10) || 'new' || chr(10) || '<!-- /generated:cov -->' || chr(10), false), ('surveys/c.md', 'skipped', 'old', true), ('surveys/d.md', 'skipped', 'same', false)) AS t(path, action, body, conflict)")
def merged_surveys(spark, sf):
    block = "<!-- generated:cov -->\n{0}\n<!-- /generated:cov -->"
    source = spark.createDataFrame([("surveys/a.md", "new"), ("surveys/b.md", "other\n" + block.format("new")), ("surveys/c.md", "new"), ("surveys/d.md", "same ")], "path string, body string")
    dest = spark.createDataFrame([("surveys/b.md", "mine\n" + block.format("old"), True), ("surveys/c.md", "old", False), ("surveys/d.md", "same", False)], "path string, body string, verified boolean")
    return merge.merge_slug_pages(source, dest, "Survey")


@R.query(
    "WITH o AS (SELECT o_orderkey AS k FROM orders) SELECT CASE k % 4 WHEN 0 THEN 'doi:10.1/' || k WHEN 1 THEN 'paper:papers/n' || k WHEN 2 THEN 'title:extract-' || k ELSE 'stem:s' || k END AS key, CASE WHEN k % 4 = 3 THEN 'extracts/s' || k || '.md' ELSE 'extracts/d' || k || '.md' END AS path, CASE WHEN k % 4 = 3 THEN 'added' ELSE 'merged' END AS action,"
    " CASE k % 4 WHEN 0 THEN 'a longer one' WHEN 1 THEN 'the longest of both' WHEN 2 THEN 'same size b' ELSE 'a longer one' END AS body FROM o"
)
def merged_extract_pages(spark, sf):
    o, k = _orders(spark, sf), F.col("k")
    s, r = k.cast("string"), k % 4
    columns = lambda letter, owner, body, made: (F.format_string(f"extracts/{letter}%d.md", k).alias("path"), F.when(r == 0, F.concat(F.lit("10.1/"), s)).alias("doi"), F.when(r == 1, F.concat(F.lit(f"papers/{owner}"), s)).alias("paper"), F.when(r == 2, F.concat(F.lit("Extract "), s)).alias("title"), body.alias("body"), F.lit(made).alias("made"))
    source = o.select(*columns("s", "o", F.when(r == 2, "same size b").otherwise("a longer one"), "2021"))
    dest = o.filter(r != 3).select(*columns("d", "n", F.when(r == 0, "short").when(r == 1, "the longest of both").otherwise("same size a"), "2020"))
    moves = o.select(F.col("id").alias("old"), F.concat(F.lit("papers/n"), s).alias("new"))
    return merge.merge_extracts(source, dest, moves).select("key", "path", "action", "body")


@R.query(f"WITH {BODIES} SELECT id, CASE WHEN k % 3 = 0 THEN 'papers/o' || (k + 1) ELSE 'papers/m' END AS paper, replace(body, '/papers/o' || (k + 1) || '.md', CASE WHEN (k + 1) % 3 = 0 THEN '/papers/m.md' ELSE '/papers/o' || (k + 1) || '.md' END) AS body FROM b")
def remapped_bodies(spark, sf):
    b = _bodies(spark, sf)
    rows = b.select("id", F.when(F.col("k") % 3 == 0, F.format_string("papers/o%d.md", F.col("k") + 1)).otherwise("papers/m").alias("paper"), "body")
    moves = spark.range(1, 1).select(F.lit("").alias("old"), F.lit("").alias("new")).unionByName(b.filter("(k + 1) % 3 = 0").select(F.format_string("papers/o%d", F.col("k") + 1).alias("old"), F.lit("papers/m").alias("new")))
    return merge.remap_bodies(rows, moves).select("id", F.regexp_replace("paper", r"\.md$", "").alias("paper"), "body")


# resolution ---------------------------------------------------------------------------
@R.query(f"{CTE}, p AS (SELECT title, id FROM nodes WHERE type = 'Method') SELECT upper(title) AS probe, id AS path, 'title' AS matched_by FROM p")
def aligned_titles(spark, sf):
    hubs = lens.nodes(spark, sf).filter("type = 'Method'").select("type", F.col("id").alias("path"), "title", F.array().cast("array<string>").alias("aliases"))
    probes = hubs.select(F.upper("title").alias("probe"), "type", F.upper("title").alias("title"))
    return align.lookup(align.index(hubs), probes)


@R.query("SELECT * FROM (VALUES (0, 'both'), (1, 'both'), (2, 'right'), (3, 'left'), (4, 'right')) AS t(i, keep)")
def review_suggestions(spark, sf):
    rows = [(0, "edit-distance:1", "COL5A1", "COL4A1"), (1, "edit-distance:1", "Cellpose", "Cellpose 3"), (2, "token:contain", "cells", "stem cells"), (3, "token:contain", "stem cells", "cells"), (4, "align:title", "Beta", "The beta")]
    return spark.createDataFrame(rows, "i int, reason string, l string, r string").select("i", resolve.suggestion(F.col("reason"), F.col("l"), F.col("r")).alias("keep"))


@R.query("WITH p AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 'deprecated' ELSE 'stable' END AS status, o_orderkey AS k FROM orders) SELECT count(*) FILTER (k % 50 = 0) AS missing_published, count(*) FILTER (k % 7 <> 0) AS missing_doi, count(*) FILTER (k % 11 = 0) AS low_confidence FROM p WHERE status <> 'deprecated'")
def biblio_gaps(spark, sf):
    o, k = _orders(spark, sf), F.col("k")
    papers = o.select(F.when(F.col("o_orderstatus") == "P", "deprecated").otherwise("stable").alias("status"), F.when(k % 50 != 0, F.col("o_orderdate").cast("string")).alias("published"), F.when(k % 7 == 0, "10.1/x").otherwise(" ").alias("doi"), F.when(k % 11 == 0, "suggested").alias("biblio"))
    return resolve.biblio_gaps(papers)


@R.query("SELECT * FROM (VALUES (0, 'a|B|c', 'a|B|c'), (1, 'Cell|cell|The cell|x', 'Cell|x')) AS t(i, all_values, by_key)")
def united_lists(spark, sf):
    rows = spark.createDataFrame([(0, ["a", "B"], ["B", "c"]), (1, ["Cell", "cell"], ["The cell", "x"])], "i int, a array<string>, b array<string>")
    return rows.select("i", F.array_join(resolve.unite(F.col("a"), F.col("b")), "|").alias("all_values"), F.array_join(resolve.unite_aliases(F.col("a"), F.col("b")), "|").alias("by_key"))


# graphs -------------------------------------------------------------------------------
REACH = "und AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"


@R.query(f"{CTE}, {ALLOWED}, {REACH}, s AS (SELECT id FROM nodes JOIN allowed USING (id) WHERE type = 'Paper' AND substr(published, 1, 4) BETWEEN '1996' AND '1996'), k AS (SELECT id FROM s UNION SELECT und.dst FROM und JOIN s ON und.src = s.id) SELECT id FROM k JOIN allowed USING (id) JOIN nodes USING (id) WHERE type IN ('Paper', 'Topic', 'Claim')")
def filtered_graph(spark, sf):
    nodes, edges = both(spark, sf)
    return graph.filter_graph(nodes, edges, types=("Paper", "Topic", "Claim"), this_year=2000, low="1996", high="1996-05", most=10_000_000)[0]


@R.query(f"{CTE}, {ALLOWED}, {REACH}, g AS (SELECT n.id, n.type, n.published FROM nodes n JOIN allowed USING (id)), w AS (SELECT id, published FROM g WHERE type = 'Paper' AND substr(published, 1, 4) >= '1985' ORDER BY coalesce(published, '') DESC, id LIMIT 80), k AS (SELECT id FROM w UNION SELECT und.dst FROM und JOIN w ON und.src = w.id) SELECT k.id FROM k JOIN g USING (id) WHERE g.type IN ('Paper', 'Topic', 'Method') ORDER BY k.id LIMIT 180")
def capped_graph(spark, sf):
    """Too large for the cap, so the newest papers of the window and what they touch stand for it."""
    return graph.filter_graph(*both(spark, sf), types=("Paper", "Topic", "Method"), this_year=2000)[0]


@R.query(
    f"{CTE}, {ALLOWED}, {DEGREE}, g AS (SELECT id, type, title, published, paper, degree, {RANK} AS rank FROM nodes JOIN allowed USING (id) JOIN deg USING (id) WHERE type IN ('Pathway', 'Claim')), o AS (SELECT id, type, title, rank, 0 AS place FROM g WHERE type <> 'Claim'), c AS (SELECT id, type, title, row_number() OVER (PARTITION BY paper ORDER BY degree DESC, id) AS turn, paper FROM g WHERE type = 'Claim')"
    " SELECT id, type, title FROM o UNION ALL (SELECT id, type, title FROM (SELECT * FROM c ORDER BY turn, paper, id LIMIT 43))"
)
def tool_graph(spark, sf):
    """Five hubs and, in turn from their papers, as many claims as the cap of 48 leaves."""
    nodes, edges = both(spark, sf)
    allowed = nodes.filter(F.col("type").isin("Pathway", "Claim")).select("id")
    return graph.tool_graph(nodes, edges, allowed, True)[0].select("id", "type", "title")


@R.query(f"{CTE}, {ALLOWED}, h AS (SELECT 'papers/o1' AS id UNION ALL SELECT 'papers/o2' UNION ALL SELECT 'claims/o3--1') SELECT id FROM allowed WHERE id IN (SELECT id FROM h) OR id IN (SELECT dst FROM edges JOIN h ON src = h.id)")
def search_scope(spark, sf):
    nodes, edges = both(spark, sf)
    hits = spark.createDataFrame([("papers/o1",), ("papers/o2",), ("claims/o3--1",)], "id string")
    return graph.search_scope(nodes, edges.withColumn("pos", F.lit(0)), hits)


@R.query(f"{CTE}, h AS (SELECT * FROM (VALUES ('claims/o1--1', 0), ('datasets/supplier-000000001', 1), ('papers/o2', 2)) AS t(id, rank)), r AS (SELECT id, rank, 0 AS step FROM h UNION ALL SELECT n.paper, rank, 1 FROM h JOIN nodes n USING (id) WHERE n.paper IS NOT NULL UNION ALL SELECT e.dst, rank, 2 FROM h JOIN edges e ON e.src = h.id), m AS (SELECT id, min(rank * 10 + step) AS o FROM r GROUP BY id) SELECT m.id, (o // 10)::INT AS rank, (o % 10)::INT AS step FROM m JOIN nodes n USING (id) WHERE n.type = 'Paper'")
def papers_from_hits(spark, sf):
    hits = spark.createDataFrame([("claims/o1--1", 0), ("datasets/supplier-000000001", 1), ("papers/o2", 2)], "id string, rank int")
    return graph.papers_from_hits(*both(spark, sf), hits)


@R.query(f"{CTE}, t AS (SELECT * FROM nodes WHERE type IN ('Paper', 'Pathway', 'Entity')), s AS (SELECT id FROM t WHERE contains(lower(title), 'customer#00000001')), k AS (SELECT id FROM s UNION SELECT dst FROM edges JOIN s ON src = s.id UNION SELECT src FROM edges JOIN s ON dst = s.id) SELECT id FROM t WHERE id IN (SELECT id FROM k)")
def client_graph(spark, sf):
    return graph.client_filter(*both(spark, sf), ("Paper", "Pathway", "Entity"), query="Customer#00000001")[0].select("id")


@R.query("SELECT * FROM (VALUES ('a', 'Paper', 'A', '2020'), ('b', 'Topic', 'B', NULL), ('c', 'unknown', 'c', NULL), ('d', 'Method', 'D', '2021'), ('e', 'unknown', 'E', NULL)) AS t(id, type, title, published)")
def merged_graphs(spark, sf):
    shape = "id string, type string, title string, published string"
    base = spark.createDataFrame([("a", "Paper", "A", "2020"), ("b", "unknown", "b", None), ("c", "unknown", "c", None), ("e", "unknown", "e", None)], shape)
    extra = spark.createDataFrame([("a", "Topic", "Other", None), ("b", "Topic", "B", None), ("c", "unknown", "c", None), ("d", "Method", "D", "2021"), ("e", "unknown", "E", None)], shape)
    return graph.merge_graphs(base, extra)


AUDIT = "st AS (SELECT 'sources/' || o_orderkey || '.pdf' AS path, CASE o_orderkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'queued' ELSE 'done' END AS status, CASE WHEN o_orderkey % 5 > 1 THEN 'papers/o' || CASE WHEN o_orderkey % 7 = 0 THEN -o_orderkey ELSE o_orderkey END || '.md' END AS paper FROM orders WHERE o_orderkey % 3 > 0)"


def _audit(spark, sf):
    o, k = _orders(spark, sf), F.col("k")
    source = F.format_string("sources/%d.pdf", k)
    state = o.filter(k % 3 > 0).select(source.alias("path"), F.when(k % 5 == 0, "failed").when(k % 5 == 1, "queued").otherwise("done").alias("status"), F.when(k % 5 > 1, F.format_string("papers/o%d.md", F.when(k % 7 == 0, -k).otherwise(k))).alias("paper"), F.when(k % 5 == 0, "boom").alias("error"))
    return state, o.select(source.alias("path")).unionByName(o.select(F.concat("id", F.lit(".md")).alias("path")))


@R.query(
    f"WITH {AUDIT} SELECT path, CASE WHEN status = 'queued' THEN 'warning' ELSE 'error' END AS severity, CASE status WHEN 'failed' THEN 'status=failed (boom)' WHEN 'queued' THEN 'status=queued' ELSE 'paper is missing: ' || paper END AS problem FROM st WHERE status <> 'done' OR paper LIKE 'papers/o-%'"
    " UNION ALL SELECT 'sources/' || o_orderkey || '.pdf', 'warning', 'never ingested' FROM orders WHERE o_orderkey % 3 = 0"
)
def pipeline_audit(spark, sf):
    return graph.pipeline_audit(*_audit(spark, sf))


@R.query(
    f"{CTE}, {AUDIT}, ids AS MATERIALIZED (SELECT id, type, status FROM nodes), ed AS MATERIALIZED (SELECT src, dst FROM edges), real AS (SELECT src AS node, dst AS id, 0 AS i FROM ed WHERE src <> dst UNION ALL SELECT dst, src, 1 FROM ed WHERE src <> dst), seen AS MATERIALIZED (SELECT node, count(*) AS n, count(*) FILTER (o.type <> 'Claim') AS n_other, sum(i) AS n_in FROM real JOIN ids o ON o.id = real.id GROUP BY node),"
    f" c AS (SELECT CASE WHEN type = 'Paper' AND coalesce(n, 0) = 0 THEN 'ip' WHEN type = 'Paper' AND coalesce(n_other, 0) = 0 THEN 'cp' WHEN type IN ({HUBS}) AND coalesce(n, 0) = 0 THEN 'ic' WHEN type IN ({HUBS}) AND coalesce(n_in, 0) = 0 THEN 'uc' END AS k FROM ids LEFT JOIN seen ON seen.node = ids.id WHERE status <> 'deprecated')"
    " SELECT (SELECT count(*) FROM ids WHERE type = 'Paper') AS papers, (SELECT count(*) FROM ids) AS concepts, (SELECT count(*) FROM ed ANTI JOIN ids ON ids.id = ed.dst) AS dead_link, count(*) FILTER (k = 'ip') AS isolated_paper, count(*) FILTER (k = 'cp') AS claim_only_paper, count(*) FILTER (k = 'ic') AS isolated_concept, count(*) FILTER (k = 'uc') AS unreferenced_concept,"
    " (SELECT count(*) FROM st WHERE status <> 'done' OR paper LIKE 'papers/o-%') AS incomplete, (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0) AS unrecorded, (SELECT count(*) FROM st) AS records FROM c"
)
def check_counters(spark, sf):
    return graph.check_summary(*both(spark, sf), *_audit(spark, sf))


# coverage and surveys -----------------------------------------------------------------
SCOPE = f"sc AS (SELECT DISTINCT live.paper, published, year, year IS NOT NULL AS dated FROM live JOIN links USING (paper) WHERE hub = '{TOPIC}' AND (year IS NULL OR year BETWEEN '1996' AND '1998'))"


@R.query(f"{BASE}, {SCOPE} SELECT * FROM sc")
def survey_scope(spark, sf):
    return coverage.survey_scope(*both(spark, sf), topics=[TOPIC], low="1996-02", high="1998")


@R.query(f"{BASE}, {SCOPE}, c AS (SELECT id, paper, CASE WHEN confidence = 'reviewed' THEN 'reviewed' ELSE 'extracted' END AS part FROM nodes WHERE type = 'Claim' AND paper IN (SELECT paper FROM sc WHERE dated)), r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY id)::INT AS place FROM c) SELECT * FROM r WHERE place <= 24")
def survey_claim_parts(spark, sf):
    nodes, edges = both(spark, sf)
    return coverage.survey_claims(nodes, coverage.survey_scope(nodes, edges, topics=[TOPIC], low="1996", high="1998").filter("dated"))


@R.query(f"{BASE}, {SCOPE} SELECT paper AS id FROM sc UNION ALL SELECT id FROM nodes WHERE type = 'Claim' AND paper IN (SELECT paper FROM sc WHERE dated)")
def survey_allowed(spark, sf):
    nodes, edges = both(spark, sf)
    return coverage.allowed_ids(coverage.survey_scope(nodes, edges, topics=[TOPIC], low="1996", high="1998"), nodes)


@R.query(f"{BASE}, c AS (SELECT hub AS topic_id, year, count(DISTINCT paper) AS n FROM links JOIN live USING (paper) WHERE kind = 'Topic' AND year IS NOT NULL GROUP BY hub, year) SELECT topic_id, rpad(topic_id, 32, ' ') || " + " || ".join(f"lpad(coalesce(sum(n) FILTER (year = '{y}'), 0)::BIGINT::VARCHAR, 4, ' ')" for y in ("1996", "1997")) + " AS line FROM c GROUP BY topic_id")
def coverage_report(spark, sf):
    return coverage.gap_report(coverage.heatmap(*both(spark, sf), ["1996", "1997"]), ["1996", "1997"])


@R.query("SELECT * FROM (VALUES (0, '1999', '2020', true), (1, NULL, NULL, false), (2, '2011', '2011', true)) AS t(i, low, high, asks)")
def coverage_questions(spark, sf):
    rows = spark.createDataFrame([(0, "Which years lack papers from 2020 back to 1999 and 3020?"), (1, "what of engaged mice"), (2, "2011 的空白")], "i int, q string")
    return rows.select("i", text.coverage_years(F.col("q")).low.alias("low"), text.coverage_years(F.col("q")).high.alias("high"), text.asks_coverage(F.col("q")).alias("asks"))


# pages --------------------------------------------------------------------------------
@R.query(f"{CTE} SELECT id, published, title FROM nodes WHERE type = 'Paper' ORDER BY coalesce(published, '') DESC, title, id LIMIT 60")
def workbench_papers(spark, sf):
    return lens.nodes(spark, sf).filter("type = 'Paper'").orderBy(*pages.workbench_order()).limit(60).select("id", "published", "title")


@R.query(f"{CTE} SELECT id FROM nodes WHERE type = 'Paper' AND published >= '1997-03' AND published <= '1997-09' AND (contains(lower(title), 'order 1') OR contains(id, 'order 1') OR contains(lower(coalesce(tag, '')), 'order 1'))")
def reader_filter(spark, sf):
    return pages.paper_filter(lens.nodes(spark, sf).filter("type = 'Paper'"), "1997-03", "1997-09", " Order 1").select("id")


@R.query("SELECT concat('notes/d', doc_id) AS id, CASE WHEN length(t) > 220 THEN rtrim(substr(t, 1, 220)) || '…' ELSE t END AS excerpt, CASE WHEN doc_id % 2 = 0 THEN 'papers/a' ELSE '' END AS links FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '[#*_`>]', '', 'g'), '\\s+', ' ', 'g')) AS t FROM documents)")
def reader_cards(spark, sf):
    d = lens.table(spark, sf, "documents")
    rows = d.select(F.lit("Note").alias("type"), F.concat(F.lit("notes/d"), F.col("doc_id").cast("string")).alias("id"), F.lit(None).cast("string").alias("title"), F.lit("stable").alias("status"), F.col("text").alias("body"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("papers/a"))).otherwise(F.array().cast("array<string>")).alias("outgoing"))
    return pages.cards(rows.withColumn("path", F.concat("id", F.lit(".md")))).select("id", "excerpt", F.array_join("links", ",").alias("links"))


# models' inputs and outputs -----------------------------------------------------------
@R.query("WITH d AS (SELECT doc_id, text FROM documents), v AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text || chr(10) || chr(10) || '## Visual extracts' || chr(10) || chr(10) || '### Page 1' WHEN 1 THEN text ELSE '## Visual extracts' END AS body, text FROM d) SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN '' ELSE regexp_replace(text, '\\s+$', '') END AS own, CASE WHEN doc_id % 3 = 0 THEN '### Page 1' ELSE '' END AS seen FROM v")
def visual_sections(spark, sf):
    d, k = lens.table(spark, sf, "documents"), F.col("doc_id") % 3
    body = F.when(k == 0, F.concat("text", F.lit("\n\n## Visual extracts\n\n### Page 1"))).when(k == 1, F.col("text")).otherwise("## Visual extracts")
    return d.select("doc_id", text.strip_visual(body).alias("own"), text.visual_section(body, F.lit(False)).alias("seen"))


@R.query("SELECT * FROM (VALUES (0, 'a' || chr(10) || chr(10) || '## Visual extracts' || chr(10) || chr(10) || 'v' || chr(10)), (1, 'v' || chr(10) || chr(10) || '## Embedded text layer' || chr(10) || chr(10) || 'a' || chr(10)), (2, 'a'), (3, 'a' || chr(10)), (4, '## Visual extracts' || chr(10) || chr(10) || 'v' || chr(10)), (5, 'v' || chr(10))) AS t(i, body)")
def merged_visuals(spark, sf):
    rows = [(0, "a\n\n## Visual extracts\n\nold", " v ", False), (1, "a", "v", True), (2, "a", " ", True), (3, "a", "", False), (4, "", "v", False), (5, "", "v", True)]
    return spark.createDataFrame(rows, "i int, layer string, visual string, scan boolean").select("i", text.merge_visual(F.col("layer"), F.col("visual"), F.col("scan")).alias("body"))


@R.query("SELECT * FROM (VALUES (0, NULL), (1, 'no heading for pages 2,5'), (2, 'hardly any text for pages 2')) AS t(i, problem)")
def vision_checks(spark, sf):
    rows = [(0, "### Page 1\nlong enough text\n### Page 2\nalso long enough", [1, 2]), (1, "### Page 1\nlong enough text", [1, 2, 5]), (2, "### Page 1\nlong enough text\n### Page 2\n tiny ", [1, 2])]
    return spark.createDataFrame(rows, "i int, markdown string, pages array<int>").select("i", text.vision_problem(F.col("markdown"), F.col("pages")).alias("problem"))


@R.query("SELECT * FROM (VALUES (0, 'hm', 'answer'), (1, '', 'plain text'), (2, 'a|open', 'x')) AS t(i, thinking, answer)")
def parsed_replies(spark, sf):
    rows = spark.createDataFrame([(0, "<think>hm 🤔</think>\nanswer 👍🏽"), (1, "plain ✨ text"), (2, "<thinking>a</thinking>x<think>open")], "i int, raw string")
    got = text.parse_reply(F.col("raw"))
    return rows.select("i", F.array_join(got.thinking, "|").alias("thinking"), got.answer.alias("answer"))


@R.query("SELECT o_orderkey, '\\textbf{\\#' || o_orderkey || '}' || chr(10) || '\\section{' || o_orderkey || '\\% of \\$5\\_x}' || chr(10) || 'a & b' AS latex FROM orders")
def latex_bodies(spark, sf):
    k = F.col("o_orderkey").cast("string")
    body = F.concat(F.lit("**\\#"), k, F.lit("**\n## "), k, F.lit("% of $5_x\na & b"))
    return lens.table(spark, sf, "orders").select("o_orderkey", text.latex_body(body).alias("latex"))


@R.query("SELECT * FROM (VALUES (0, 'a', 'x' || chr(10)), (1, 'cov:1,gap:2', ''), (2, '', 'plain' || chr(10))) AS t(i, blocks, rest)")
def block_contents(spark, sf):
    wrap = "<!-- generated:{0} -->\n{1}\n<!-- /generated:{0} -->"
    rows = [(0, "x\n" + wrap.format("a", "")), (1, wrap.format("cov", "1") + "\n\n\n" + wrap.format("gap", "2")), (2, "plain")]
    blocks = F.transform(text.generated_blocks(F.col("body")), lambda b: F.concat_ws(":", b["name"], F.nullif(b["content"], F.lit(""))))
    return spark.createDataFrame(rows, "i int, body string").select("i", F.array_join(blocks, ",").alias("blocks"), text.strip_generated_blocks(F.col("body")).alias("rest"))


@R.query("SELECT * FROM (VALUES ('a', 0), ('b', 1), ('c', 2), ('d', 3)) AS t(id, rank)")
def united_hits(spark, sf):
    shape = "id string, rank int"
    return context.union_hits(spark.createDataFrame([("a", 0), ("b", 1)], shape), spark.createDataFrame([("b", 0), ("c", 1), ("d", 2)], shape))


PASSAGES = "p AS (SELECT doc_id, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS p FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n\\s*\\n')) AS x FROM documents))"


@R.query("SELECT concat('extracts/d', doc_id) AS id, len(regexp_split_to_array(trim(text), '\\s+'))::INT AS n_words, true AS whole FROM documents")
def passages_whole(spark, sf):
    """The passages of a document hold its words, all of them and in order, in pieces of 800 characters at most."""
    from tessellore.functions import udf

    cut_ = udf.passages_column(F.col("text"))
    d = lens.table(spark, sf, "documents").select(F.concat(F.lit("extracts/d"), F.col("doc_id").cast("string")).alias("id"), "text", cut_.alias("p"))
    glued = lambda x: F.regexp_replace(x, r"\s+", "")
    whole = (glued(F.array_join("p", "")) == glued(F.col("text"))) & F.forall("p", lambda x: F.length(x) <= 800)
    return d.select("id", F.size(F.split(F.trim(F.regexp_replace("text", r"^\s+|\s+$", "")), r"\s+")).alias("n_words"), whole.alias("whole"))


# review -------------------------------------------------------------------------------
REVIEWED = """r AS (SELECT 'papers/o' || o_orderkey AS path, 'Paper' AS type, CASE WHEN o_orderstatus = 'P' THEN 'deprecated' WHEN o_orderkey % 13 = 0 THEN 'draft' ELSE 'stable' END AS status, CASE WHEN o_orderkey % 50 <> 0 THEN 'd' END AS published, CASE WHEN o_orderkey % 4 = 0 THEN '10.1/x' END AS doi, CASE WHEN o_orderkey % 17 = 0 THEN 'suggested' END AS biblio, NULL AS confidence, NULL AS paper, NULL AS quote FROM orders
  UNION ALL SELECT 'claims/b' || item_id, 'Claim', CASE WHEN item_id % 3 = 0 THEN 'draft' ELSE 'stable' END, NULL, NULL, NULL, CASE WHEN item_id % 5 = 0 THEN 'disputed' END, 'papers/b' || item_id, text FROM benchmark),
  x AS (SELECT 'papers/b' || item_id AS paper, CASE WHEN item_id % 2 = 0 THEN 'It says: ' || text ELSE 'It says nothing.' END AS extract FROM benchmark WHERE item_id % 7 > 0),
  c AS (SELECT r.*, extract IS NOT NULL AND extract = 'It says nothing.' AS lost FROM r LEFT JOIN x USING (paper)),
  i AS (SELECT 'missing_published' AS kind, path, NULL AS other, NULL AS paper, 'no date' AS reason FROM c WHERE type = 'Paper' AND status <> 'deprecated' AND published IS NULL UNION ALL SELECT 'missing_doi', path, NULL, NULL, 'no DOI' FROM c WHERE type = 'Paper' AND status <> 'deprecated' AND doi IS NULL
    UNION ALL SELECT 'low_confidence_biblio', path, NULL, NULL, 'a bibliography hit waits' FROM c WHERE type = 'Paper' AND status <> 'deprecated' AND biblio IS NOT NULL UNION ALL SELECT 'disputed_claim', path, NULL, paper, CASE WHEN lost THEN 'quote not in extract' ELSE 'disputed' END FROM c WHERE type = 'Claim' AND (lost OR confidence = 'disputed')
    UNION ALL SELECT 'draft', path, NULL, NULL, 'draft' FROM c WHERE status = 'draft' AND NOT (type = 'Claim' AND (lost OR coalesce(confidence = 'disputed', false))) UNION ALL SELECT 'near_duplicate', 'topics/a.md', 'topics/b.md', NULL, 'align:stem' UNION ALL SELECT 'merge_conflict', 'papers/z.md', NULL, NULL, 'differs')"""


def _queue(spark, sf):
    o, k = _orders(spark, sf), F.col("k")
    none = F.lit(None).cast("string")
    papers = o.select(F.col("id").alias("path"), F.lit("Paper").alias("type"), F.when(F.col("o_orderstatus") == "P", "deprecated").when(k % 13 == 0, "draft").otherwise("stable").alias("status"), F.when(k % 50 != 0, "d").alias("published"), F.when(k % 4 == 0, "10.1/x").alias("doi"), F.when(k % 17 == 0, "suggested").alias("biblio"), none.alias("confidence"), none.alias("paper"), none.alias("quote"))
    b, i = lens.table(spark, sf, "benchmark"), F.col("item_id")
    owner = F.concat(F.lit("papers/b"), i.cast("string"))
    claims = b.select(F.concat(F.lit("claims/b"), i.cast("string")).alias("path"), F.lit("Claim").alias("type"), F.when(i % 3 == 0, "draft").otherwise("stable").alias("status"), none.alias("published"), none.alias("doi"), none.alias("biblio"), F.when(i % 5 == 0, "disputed").alias("confidence"), owner.alias("paper"), F.col("text").alias("quote"))
    extracts = b.filter(i % 7 > 0).select(F.concat(F.lit("extracts/b"), i.cast("string")).alias("id"), owner.alias("paper"), F.when(i % 2 == 0, F.concat(F.lit("It says: "), "text")).otherwise("It says nothing.").alias("body"))
    pairs = spark.createDataFrame([("topics/a.md", "topics/b.md", "align:stem")], "a string, b string, reason string")
    return integrity.review_queue(papers.unionByName(claims), pairs, extracts, spark.createDataFrame([("papers/z.md", "differs")], "path string, reason string"))


@R.query(f"WITH {REVIEWED} SELECT * FROM i")
def review_queue(spark, sf):
    return _queue(spark, sf)


KIND_RANK = "CASE kind WHEN 'missing_published' THEN 0 WHEN 'missing_doi' THEN 1 WHEN 'low_confidence_biblio' THEN 2 WHEN 'disputed_claim' THEN 3 WHEN 'near_duplicate' THEN 4 WHEN 'merge_conflict' THEN 5 ELSE 6 END"


@R.query(f"WITH {REVIEWED} SELECT kind, path FROM i ORDER BY {KIND_RANK}, path, coalesce(other, '') LIMIT 100")
def review_first(spark, sf):
    return integrity.review_order(_queue(spark, sf)).select("kind", "path").limit(100)


@R.query(f"WITH {REVIEWED} SELECT count(*) FILTER (kind NOT IN ('disputed_claim', 'draft')) AS actions, count(*) FILTER (kind IN ('disputed_claim', 'draft')) AS backlog FROM i")
def review_totals(spark, sf):
    return integrity.review_totals(_queue(spark, sf))


# index and chunks ---------------------------------------------------------------------
@R.query("WITH d AS (SELECT doc_id, concat('extracts/d', doc_id) AS id, CASE WHEN doc_id % 13 = 0 THEN text || ' zzdelta' ELSE text END AS body FROM documents WHERE doc_id % 11 <> 0), p AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(body), '[a-z0-9][a-z0-9+-]{1,}')) AS token FROM d) SELECT token, count(*) AS df FROM p GROUP BY token")
def persisted_index(spark, sf):
    """An index that is written, brought up to date from its delta and read again has the frequencies of a new one."""
    import uuid

    from tessellore.sources.store import POSTINGS, Store
    from tessellore.storage import shared_folder

    d = lens.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("extracts/d"), F.col("doc_id").cast("string")).alias("id"), F.lit(None).cast("string").alias("title"), F.col("text").alias("body"))
    root = f"{shared_folder(spark)}/tessellore-index-{uuid.uuid4().hex}"
    Store(spark, root).build_index(d.filter("doc_id % 7 <> 0").drop("doc_id"))
    edited = F.when(F.col("doc_id") % 13 == 0, F.concat("body", F.lit(" zzdelta"))).otherwise(F.col("body"))
    Store(spark, root).refresh_index(d.filter("doc_id % 11 <> 0").withColumn("body", edited).drop("doc_id"))
    return Store(spark, root).load(POSTINGS).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


@R.query("SELECT 'claims/b' || item_id || '#quote' AS chunk_id, 'Claim ' || item_id || chr(10) || text AS body FROM benchmark")
def claim_chunks(spark, sf):
    b, i = lens.table(spark, sf, "benchmark"), F.col("item_id").cast("string")
    records = b.select(F.concat(F.lit("claims/b"), i).alias("id"), F.lit("Claim").alias("type"), F.concat(F.lit("Claim "), i).alias("title"), F.concat(F.lit("> "), "text", F.lit("\n")).alias("body"))
    return search.chunks(records, records.limit(0)).select("chunk_id", F.col("text").alias("body"))


#: Blanks as passages are split at them: those of Unicode, and the separators before the space.
BLANKS = r"(?U)\s+|[\x1c-\x1f]+"


@R.query("SELECT concat('extracts/d', doc_id) AS source_id, true AS whole FROM documents")
def extract_chunks(spark, sf):
    """The first sixteen passages of each extract: numbered from 0, of at most 800 characters, the beginning of its text; one without words has none.

    Rows of one id are extracts of their own, so each is numbered; the numbers are written, as they must stay.
    """
    source = F.concat(F.lit("extracts/d"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = lens.table(spark, sf, "documents").select(source.alias("source_id"), F.concat(source, F.lit("/"), F.monotonically_increasing_id()).alias("id"), F.col("text").alias("body"))
    d = cut(rows).withColumns({"type": F.lit("TextExtract"), "title": F.lit("t")})
    cut_ = search.chunks(d, d).groupBy(F.col("source_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ordinal", "chunk_id", "text"))).alias("c"))
    met = d.join(cut_, "id", "left").withColumn("c", F.coalesce("c", F.array().cast(cut_.schema["c"].dataType)))
    glued = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), BLANKS, "")
    joined = glued(F.array_join(F.transform("c", lambda x: x.text), ""))
    right = F.forall(F.transform("c", lambda x, i: (x.ordinal == i) & (x.chunk_id == F.concat("id", F.lit("#p"), i.cast("string"))) & (F.length(x.text) <= 800)), lambda x: x)
    whole = right & (F.size("c") <= 16) & glued(F.col("body")).startswith(joined) & ((F.size("c") > 0) | (glued(F.col("body")) == ""))
    return met.select("source_id", whole.alias("whole"))


@R.query("WITH h AS (SELECT o_orderkey % 11 AS p, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1) SELECT 'papers/o' || p AS id, 'Order ' || p AS title, n FROM h WHERE p IN (SELECT o_orderkey FROM orders)")
def evidence_rollup(spark, sf):
    o = _orders(spark, sf)
    found = o.filter("k % 3 = 0").select(F.format_string("papers/o%d", F.col("k") % 11).alias("paper"))
    return search.evidence_papers(found, o.select("id", F.concat(F.lit("Order "), F.col("k").cast("string")).alias("title")))


# messages, comparisons, manuscripts ---------------------------------------------------
@R.query("WITH m AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (turn % 3 = 0) AS said, count(*) FILTER (turn % 3 > 0) AS rest FROM conversations GROUP BY conv_id) SELECT * FROM m")
def system_texts(spark, sf):
    """Every third turn stands for a system message."""
    c = lens.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("turn") % 3 == 0, "system").otherwise("user").alias("role"), F.col("text").alias("content")))).alias("m"))
    return c.select("conv_id", text.system_text(F.col("m")).alias("said"), F.size(F.filter("m", lambda x: x.role != "system")).cast("long").alias("rest"))


@R.query("SELECT * FROM (VALUES (0, 'image/png', 3), (1, 'image/jpeg', 1), (2, NULL, NULL), (3, NULL, NULL)) AS t(i, media, n)")
def image_urls(spark, sf):
    rows = spark.createDataFrame([(0, "data:image/png;base64,YWJj"), (1, " data:image/JPG;base64,YQ== "), (2, "https://e.org/a.png"), (3, "data:image/png;base64,")], "i int, url string")
    got = text.image_of(F.col("url"))
    return rows.select("i", got.media.alias("media"), F.octet_length(got.content).alias("n"))


@R.query("SELECT * FROM (VALUES (0, 'ab'), (1, '')) AS t(i, said)")
def message_texts(spark, sf):
    rows = spark.createDataFrame([(0, [("text", "a"), ("image_url", None), ("text", "b")]), (1, [])], "i int, parts array<struct<type:string,text:string>>")
    return rows.select("i", text.message_text(F.col("parts")).alias("said"))


@R.query(f"{CTE} SELECT lower(tag) AS tag, count(DISTINCT id) AS n_papers, count(DISTINCT id) = 24 AS in_all FROM nodes WHERE type = 'Paper' AND id IN ({', '.join(repr(f'papers/o{k}') for k in range(1, 25))}) GROUP BY 1 HAVING count(DISTINCT id) >= 2")
def compare_tags(spark, sf):
    return graph.shared_tags(lens.nodes(spark, sf), [f"papers/o{k}" for k in range(1, 25)])


@R.query(f"WITH {BODIES}, o AS (SELECT o_orderkey AS k FROM orders) SELECT b.id, CASE WHEN o.k IS NULL THEN 'next' ELSE '[@key' || o.k || ']' END || ' and gone, see [web](https://e.org/a.md).' AS text FROM b LEFT JOIN o ON o.k = b.k + 1")
def manuscripts(spark, sf):
    """Links to papers become citations, those to other pages their labels, those to elsewhere stay."""
    return survey.manuscript(_bodies(spark, sf).select("id", F.regexp_replace("body", "#x", "").alias("body")), _orders(spark, sf).select("id", F.concat(F.lit("key"), F.col("k").cast("string")).alias("key")))


@R.query("SELECT o_orderkey, array_to_string(list_filter([1, 2, 3, 4, 5], lambda x: x % (1 + o_orderkey % 3) <> 0), ',') AS pages_left FROM orders")
def remaining_pages(spark, sf):
    o = lens.table(spark, sf, "orders")
    planned = F.array(*map(F.lit, (1, 2, 3, 4, 5)))
    done = F.filter(planned, lambda x: x % (1 + F.col("o_orderkey") % 3) == 0)
    return o.select("o_orderkey", F.array_join(text.remaining(planned, done), ",").alias("pages_left"))
