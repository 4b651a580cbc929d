"""Queries over the text library: retrieval, vectors, evidence, text functions, incremental refresh, events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellore.functions import text, udf
from tessellore.operators import quotes as quotes_
from tessellore.operators import align, incremental, integrity, resolve, search, survey
from tessellore.plans import lens
from tessellore.plans.base import Registry
from tessellore.sources import library
from tessellore.streaming import events as streams

R = Registry()
QUERY = "then the reathe onth"
TOKENS = ("then", "the", "reathe", "onth")
#: Titles are the first lines, bodies the whole texts, as the index sees them.
DOCS = "docs AS (SELECT doc_id, concat('extracts/d', doc_id) AS id, string_split(text, chr(10))[1] AS title, text AS body FROM documents)"
POSTINGS = f"""{DOCS}, postings AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(title || chr(10) || body), '[a-z0-9][a-z0-9+-]{{1,}}')) AS token FROM docs),
  heads AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(title), '[a-z0-9][a-z0-9+-]{{1,}}')) AS token FROM docs)"""
MATCH = " OR ".join(f"starts_with(p.token, '{t}')" for t in TOKENS)
SCORES = f"""{POSTINGS}, df AS (SELECT token, count(*) AS df FROM postings GROUP BY token),
  scores AS (SELECT p.id, round(sum(2 * (ln(((SELECT count(*) FROM docs) + 1) / (df + 1)) + 1) * CASE WHEN h.id IS NULL THEN 1 ELSE 3 END), 6) AS score
    FROM postings p JOIN df ON df.token = p.token LEFT JOIN heads h ON h.id = p.id AND h.token = p.token WHERE {MATCH} GROUP BY p.id)"""


def docs(spark, sf):
    d = lens.table(spark, sf, "documents")
    return d.select("doc_id", F.concat(F.lit("extracts/d"), F.col("doc_id").cast("string")).alias("id"), F.split("text", "\n")[0].alias("title"), F.col("text").alias("body"))


def hits(spark, sf):
    found = docs(spark, sf)
    return search.fts_search(search.postings_for(found, QUERY), found.count(), QUERY).select("id", F.round("score", 6).alias("score"))


@R.query(f"WITH {POSTINGS} SELECT token, count(*) AS df, round(ln(((SELECT count(*) FROM docs) + 1) / (count(*) + 1)) + 1, 6) AS idf FROM postings GROUP BY token")
def fts_df_idf(spark, sf):
    found = docs(spark, sf)
    return search.token_stats(search.build_postings(found), found.count()).select("token", "df", F.round("idf", 6).alias("idf"))


@R.query(f"WITH {SCORES} SELECT id, score FROM scores")
def fts_score(spark, sf):
    found = docs(spark, sf)
    return search.fts_scores(search.postings_for(found, QUERY), found.count(), QUERY).select("id", F.round("score", 6).alias("score"))


@R.query(f"WITH {SCORES} SELECT id, score FROM scores ORDER BY score DESC, id LIMIT 40")
def fts_search(spark, sf):
    return hits(spark, sf)


@R.query(f"WITH {POSTINGS} SELECT p.token, p.id, h.id IS NOT NULL AS in_title FROM postings p LEFT JOIN heads h ON h.id = p.id AND h.token = p.token WHERE {MATCH}")
def fts_prefix(spark, sf):
    return search.postings_for(docs(spark, sf), QUERY).select("token", "id", "in_title")


PAPERS = "papers AS (SELECT o_orderkey - 1 AS k, concat('papers/o', o_orderkey) AS id, concat('Order ', o_orderkey) AS title, CASE o_orderstatus WHEN 'F' THEN 'stable' WHEN 'O' THEN 'draft' ELSE 'deprecated' END AS status, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS published FROM orders)"


@R.query(f"WITH {SCORES}, {PAPERS}, h AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM (SELECT * FROM scores ORDER BY score DESC, id LIMIT 40)), t AS (SELECT p.id, p.title, p.status, p.published, rank, row_number() OVER (PARTITION BY p.id ORDER BY rank) AS n FROM h JOIN papers p ON concat('extracts/d', p.k // 4) = h.id) SELECT id, title, status, published, rank::INT AS rank FROM t WHERE n = 1 ORDER BY rank, id LIMIT 16")
def search_promoted(spark, sf):
    """Hits stand for the papers that own them; each order owns the extract of a quarter of its key."""
    ranked = search.ranked(hits(spark, sf))
    nodes = lens.nodes(spark, sf).filter("type = 'Paper'")
    key = ((F.regexp_extract("id", r"(\d+)$", 1).cast("long") - 1) / 4).cast("long")
    owners = nodes.select(F.col("id").alias("paper"), F.concat(F.lit("extracts/d"), key.cast("string")).alias("id"))
    records = owners.withColumn("type", F.lit("TextExtract"))
    return search.promote(ranked, records, nodes).orderBy("rank", "id")


# vectors ------------------------------------------------------------------------------
ASKED = "asked AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7)"


def _asked(spark, sf):
    return [float(x) for x in lens.table(spark, sf, "embeddings").filter("vec_id = 7").first().embedding]


@R.query(f"WITH {ASKED} SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, asked ORDER BY score DESC, id LIMIT 40")
def vector_topk(spark, sf):
    chunks = lens.table(spark, sf, "embeddings").select(F.col("vec_id").alias("source_id"), "embedding")
    return search.vector_search(chunks, _asked(spark, sf)).select("id", F.round("score", 6).alias("score"))


@R.query(f"WITH {ASKED} SELECT label AS id, round(max(list_cosine_similarity(embedding::DOUBLE[], q)), 6) AS score FROM embeddings, asked GROUP BY label ORDER BY score DESC, id LIMIT 40")
def vector_max_per_source(spark, sf):
    chunks = lens.table(spark, sf, "embeddings").select(F.col("label").alias("source_id"), "embedding")
    return search.vector_search(chunks, _asked(spark, sf)).select("id", F.round("score", 6).alias("score"))


@R.query(f"WITH {SCORES}, {ASKED}, a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM (SELECT * FROM scores ORDER BY score DESC, id LIMIT 40)), v AS (SELECT concat('extracts/d', vec_id) AS id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS s FROM embeddings, asked), b AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS r FROM (SELECT * FROM v ORDER BY s DESC, id LIMIT 40)) SELECT id, round(sum(1.0 / (60 + r)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id")
def rrf_fusion(spark, sf):
    chunks = lens.table(spark, sf, "embeddings").select(F.concat(F.lit("extracts/d"), F.col("vec_id").cast("string")).alias("source_id"), "embedding")
    vectors = search.vector_search(chunks, _asked(spark, sf))
    return search.fuse(search.ranked(hits(spark, sf)), search.ranked(vectors)).select("id", F.round("score", 9).alias("score"))


# evidence -----------------------------------------------------------------------------
@R.query(f"WITH {SCORES}, c AS (SELECT item_id, concat('extracts/d', item_id) AS id FROM benchmark) SELECT c.item_id, c.id, scores.score FROM c JOIN scores ON scores.id = c.id ORDER BY score DESC, c.id LIMIT 12")
def evidence(spark, sf):
    found = docs(spark, sf)
    scored = search.fts_scores(search.postings_for(found, QUERY), found.count(), QUERY).select("id", F.round("score", 6).alias("score"))
    claims = lens.table(spark, sf, "benchmark").select("item_id", F.concat(F.lit("extracts/d"), F.col("item_id").cast("string")).alias("id"))
    return search.evidence(claims, scored).select("item_id", "id", "score")


@R.query(f"WITH {SCORES}, c AS (SELECT item_id % 5 AS paper, concat('extracts/d', item_id) AS id FROM benchmark), e AS (SELECT * FROM c JOIN scores USING (id) ORDER BY score DESC, id LIMIT 12) SELECT paper, count(*) AS n FROM e GROUP BY paper")
def evidence_papers(spark, sf):
    return evidence(spark, sf).groupBy((F.col("item_id") % 5).alias("paper")).agg(F.count(F.lit(1)).alias("n"))


#: The passages ``ps`` (id, ordinal from 0, passage) of ``t`` (id, body): short paragraphs joined, long ones cut.
PASSAGES = """q AS (SELECT id, list_filter(list_transform(regexp_split_to_array(body, '\\n\\s*\\n'), lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g'))), lambda p: p <> '') AS paras FROM t),
f AS (SELECT id, array_to_string(paras, ' ') AS flat, list_reduce(list_transform(paras, lambda p: {'spans': [{'a': length(p), 'b': 0::BIGINT}], 'more': false, 'stop': 0::BIGINT}), lambda s, x:
  CASE WHEN x.spans[1].a > 800 THEN {'spans': list_concat(s.spans, list_transform(range(s.stop + 1, s.stop + 1 + x.spans[1].a, 800), lambda i: {'a': i, 'b': least(i + 800, s.stop + 1 + x.spans[1].a)})), 'more': false, 'stop': s.stop + 1 + x.spans[1].a}
       WHEN s.more AND s.spans[-1].b - s.spans[-1].a < 400 AND s.stop + 1 + x.spans[1].a - s.spans[-1].a <= 800 THEN {'spans': list_append(s.spans[:-2], {'a': s.spans[-1].a, 'b': s.stop + 1 + x.spans[1].a}), 'more': true, 'stop': s.stop + 1 + x.spans[1].a}
       ELSE {'spans': list_append(s.spans, {'a': s.stop + 1, 'b': s.stop + 1 + x.spans[1].a}), 'more': true, 'stop': s.stop + 1 + x.spans[1].a} END,
  {'spans': []::STRUCT(a BIGINT, b BIGINT)[], 'more': false, 'stop': (-1)::BIGINT}) AS r FROM q WHERE len(paras) > 0),
ps AS (SELECT id, i - 1 AS ordinal, substr(flat, r.spans[i].a + 1, r.spans[i].b - r.spans[i].a) AS passage FROM (SELECT *, unnest(range(1, len(r.spans) + 1)) AS i FROM f))"""
#: Every third document has each line as a paragraph, the others are as they are.
PARAGRAPHS = "SELECT concat('extracts/d', doc_id) AS id, CASE WHEN doc_id % 3 = 0 THEN replace(text, chr(10), chr(10) || ' ' || chr(10)) ELSE text END AS body FROM documents"


def paragraphed(spark, sf):
    d = lens.table(spark, sf, "documents")
    body = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", "\n", "\n \n")).otherwise(F.col("text"))
    return d.select(F.concat(F.lit("extracts/d"), F.col("doc_id").cast("string")).alias("id"), body.alias("body"))


@R.query(f"WITH t AS ({PARAGRAPHS}), {PASSAGES}, s AS (SELECT id, ordinal, " + " + ".join(f"contains(lower(passage), '{t}')::INT" for t in TOKENS) + " AS score FROM ps), w AS (SELECT *, max(score) OVER (PARTITION BY id) AS top, row_number() OVER (PARTITION BY id ORDER BY score DESC, ordinal) AS place FROM s) SELECT id, ordinal::INT AS ordinal, score, place::INT AS place FROM w WHERE place <= 3 AND (score > 0 OR top = 0)")
def passages_scored(spark, sf):
    return search.best_passages(paragraphed(spark, sf), QUERY)


# quotes and claims --------------------------------------------------------------------
_FOLD = "trim(lower(regexp_replace(regexp_replace(regexp_replace({0}, '-\\s+([a-z])', '\\1', 'g'), '[.,;:()\\[\\]\"''“”‘’…]', '', 'g'), '\\s+', ' ', 'g')))"


@R.query(f"SELECT item_id, {_FOLD.format('text')} AS folded, substr({_FOLD.format('text')}, 1, 120) AS fingerprint FROM benchmark")
def quote_fold(spark, sf):
    t = F.col("text")
    return lens.table(spark, sf, "benchmark").select("item_id", text.fold_quote(t).alias("folded"), text.quote_fingerprint(t).alias("fingerprint"))


#: Every quote, and pieces of one, two, three, five and seven words of it.
QUOTES = "q AS (SELECT item_id, item_id * 10 AS item, text FROM benchmark UNION ALL SELECT item_id, item_id * 10 + n, array_to_string(string_split(text, ' ')[3:2 + n], ' ') FROM benchmark, (SELECT unnest([1, 2, 3, 5, 7]) AS n) WHERE item_id % 9 = 0)"


@R.query(f"WITH {QUOTES} SELECT item, doc_id FROM (SELECT item, {_FOLD.format('text')} AS q FROM q) b JOIN (SELECT doc_id, {_FOLD.format('text')} AS e FROM documents) d ON q <> '' AND contains(e, q)")
def quote_in_extract(spark, sf):
    """Quotes of any length in the texts that hold them."""
    b = lens.table(spark, sf, "benchmark")
    pieces = b.filter("item_id % 9 = 0").select("item_id", F.explode(F.array(*map(F.lit, (1, 2, 3, 5, 7)))).alias("n"), "text")
    cut = pieces.select((F.col("item_id") * 10 + F.col("n")).alias("item"), F.array_join(F.slice(F.split("text", " "), 3, F.col("n")), " ").alias("text"))
    quotes = b.select((F.col("item_id") * 10).alias("item"), "text").unionByName(cut).select("item", text.fold_quote(F.col("text")).alias("q"))
    texts = lens.table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), text.fold_quote(F.col("text")).alias("e"))
    return quotes_.held_quotes(quotes, texts).select("item", F.col("doc").alias("doc_id"))


CLAIMS = "c AS (SELECT item_id, item_id % 7 = 0 AS reviewed, item_id AS paper, text AS quote FROM benchmark)"


@R.query(f"WITH {CLAIMS} SELECT concat('claims/b', item_id) AS id, concat('papers/', paper) AS paper, CASE WHEN reviewed OR d.doc_id IS NULL THEN 'kept' WHEN contains({_FOLD.format('d.text')}, {_FOLD.format('quote')}) THEN 'kept' ELSE 'pruned' END AS verdict FROM c LEFT JOIN documents d ON d.doc_id = c.paper")
def claims_prune(spark, sf):
    claims = lens.table(spark, sf, "benchmark").select(F.concat(F.lit("claims/b"), F.col("item_id").cast("string")).alias("id"), F.concat(F.lit("papers/"), F.col("item_id").cast("string")).alias("paper"), F.when(F.col("item_id") % 7 == 0, "reviewed").otherwise("extracted").alias("confidence"), F.col("text").alias("quote"))
    extracts = docs(spark, sf).select("id", F.concat(F.lit("papers/"), F.col("doc_id").cast("string")).alias("paper"), "body")
    return integrity.prune_claims(claims, extracts)


@R.query(f"WITH m AS (SELECT item_id, doc_id, b.text AS t, d.text AS x FROM benchmark b JOIN documents d ON contains({_FOLD.format('d.text')}, {_FOLD.format('b.text')})) SELECT item_id, doc_id, {_FOLD.format('t')} AS folded FROM m")
def snap_quotes(spark, sf):
    """Spans that quotes with other blanks and marks snap to, in the documents that hold them; folded, they are the quotes."""
    held = quote_in_extract(spark, sf).filter("item % 10 = 0").select((F.col("item") / 10).cast("long").alias("item_id"), "doc_id")
    quotes = lens.table(spark, sf, "benchmark").select("item_id", F.concat(F.lit("“"), F.replace("text", F.lit(" "), F.lit("  ")), F.lit("”")).alias("quote"))
    texts = lens.table(spark, sf, "documents").select("doc_id", "text")
    met = held.join(quotes, "item_id").join(texts, "doc_id")
    return met.select("item_id", "doc_id", text.fold_quote(udf.snap_column(F.col("quote"), F.col("text"))).alias("folded"))


@R.query()
def segments(spark, sf):
    d = lens.table(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(udf.segments_column(F.col("text"))).alias("ordinal", "segment")).select("doc_id", "ordinal", F.length("segment").alias("n_chars"))


@R.query(f"WITH t AS ({PARAGRAPHS}), {PASSAGES} SELECT id || '#p' || ordinal AS chunk_id, passage FROM ps WHERE ordinal < 16")
def passages(spark, sf):
    d = paragraphed(spark, sf)
    return d.select("id", F.posexplode(F.slice(udf.passages_column(F.col("body")), 1, 16)).alias("ordinal", "passage")).select(F.concat("id", F.lit("#p"), F.col("ordinal").cast("string")).alias("chunk_id"), "passage")


@R.query()
def md_blocks(spark, sf):
    d = lens.table(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(udf.blocks_column(F.col("text"))).alias("ordinal", "block")).groupBy("doc_id", "block.kind").agg(F.count(F.lit(1)).alias("n"))


# text functions -----------------------------------------------------------------------
@R.query("SELECT doc_id, CASE WHEN s = '' THEN 'untitled' ELSE s END AS slug FROM (SELECT doc_id, substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(string_split(text, chr(10))[1])), '\\s+', '-', 'g'), '[^\\p{L}\\p{N}-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), 1, 80) AS s FROM documents)")
def slug(spark, sf):
    return docs(spark, sf).select("doc_id", text.slug(F.col("title")).alias("slug"))


DATES = "d AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CAST(year(o_orderdate) AS VARCHAR) WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y') || '-13' WHEN 3 THEN strftime(o_orderdate, '%Y') || '-02-30' WHEN 4 THEN ' ' || strftime(o_orderdate, '%Y-%m-%d') || ' ' ELSE 'n.d.' END AS raw FROM orders)"


@R.query(f"WITH {DATES} SELECT o_orderkey, CASE WHEN try_strptime(x, '%Y-%m-%d') IS NOT NULL THEN x END AS published, substr(CASE WHEN try_strptime(x, '%Y-%m-%d') IS NOT NULL THEN x END, 1, 4) AS year FROM (SELECT o_orderkey, CASE WHEN regexp_full_match(trim(raw), '\\d{{4}}') THEN trim(raw) || '-01-01' WHEN regexp_full_match(trim(raw), '\\d{{4}}-\\d{{2}}') THEN trim(raw) || '-01' WHEN regexp_full_match(trim(raw), '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN trim(raw) END AS x FROM d)")
def normalize_published(spark, sf):
    o, k = lens.table(spark, sf, "orders"), F.col("o_orderkey") % 6
    form = lambda p: F.date_format("o_orderdate", p)
    raw = F.when(k == 0, form("yyyy")).when(k == 1, form("yyyy-MM")).when(k == 2, F.concat(form("yyyy"), F.lit("-13"))).when(k == 3, F.concat(form("yyyy"), F.lit("-02-30"))).when(k == 4, F.concat(F.lit(" "), form("yyyy-MM-dd"), F.lit(" "))).otherwise("n.d.")
    out = text.normalize_published(raw)
    return o.select("o_orderkey", out.alias("published"), text.published_year(out).alias("year"))


@R.query("SELECT o_orderkey, '10.1000/ab.' || o_orderkey AS doi FROM orders")
def doi_norm(spark, sf):
    k = F.col("o_orderkey")
    bare = F.concat(F.lit("10.1000/AB."), k.cast("string"))
    raw = F.when(k % 3 == 0, F.concat(F.lit(" https://doi.org/"), bare)).when(k % 3 == 1, F.concat(F.lit("DOI: "), bare)).otherwise(F.concat(F.lit("http://dx.doi.org/"), bare, F.lit(" ")))
    return lens.table(spark, sf, "orders").select("o_orderkey", text.normalize_doi(raw).alias("doi"))


@R.query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages")
def page_hrefs(spark, sf):
    return lens.table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("href"))


@R.query("WITH l AS (SELECT 'pages/p' || page_id AS scope, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS target FROM pages) SELECT target, min(scope) AS scope FROM l WHERE target NOT IN (SELECT '/' || regexp_extract(url, '^https?://[^/]+/([a-z]+)', 1) FROM pages) GROUP BY target")
def check_dead_links(spark, sf):
    p = lens.table(spark, sf, "pages")
    links = page_hrefs(spark, sf).select(F.concat(F.lit("pages/p"), F.col("page_id").cast("string")).alias("scope"), F.col("href").alias("target"))
    there = p.select(F.concat(F.lit("/"), F.regexp_extract("url", "^https?://[^/]+/([a-z]+)", 1)).alias("path")).distinct()
    return integrity.dead_links(links, there)


@R.query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages")
def html_text(spark, sf):
    return library.html_text(lens.table(spark, sf, "pages"))


@R.query("SELECT doc_id, CASE WHEN length(t) > 160 THEN rtrim(substr(t, 1, 160)) || '…' ELSE t END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '[#*_`>]', '', 'g'), '\\s+', ' ', 'g')) AS t FROM documents)")
def excerpt(spark, sf):
    return docs(spark, sf).select("doc_id", text.excerpt(F.col("body")).alias("excerpt"))


@R.query("SELECT doc_id, sha256(text) AS sha, substr(sha256(text), 1, 16) AS fingerprint FROM documents")
def fingerprints(spark, sf):
    return docs(spark, sf).select("doc_id", F.sha2("body", 256).alias("sha"), text.fingerprint16(F.col("body")).alias("fingerprint"))


@R.query("SELECT doc_id, len(regexp_extract_all(text, '\\b[B-HJ-Z] [a-z]{2,}\\b'))::INT AS n, len(regexp_extract_all(text, '\\b[B-HJ-Z] [a-z]{2,}\\b')) >= 80 AS broken FROM documents")
def broken_words(spark, sf):
    n = text.broken_words(F.col("body"))
    return docs(spark, sf).select("doc_id", n.alias("n"), (n >= text.BROKEN_WORD_THRESHOLD).alias("broken"))


@R.query("SELECT doc_id, regexp_replace(regexp_replace(list_reduce(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '</?(?:u|i|b|em|strong|sub|sup)>', '', 'g'), '[ \\t]+$', '')), lambda x: NOT regexp_full_match(trim(x), 'OPEN ACCESS|RESEARCH ARTICLE|\\d{1,3} of \\d{1,3}')), lambda a, b: a || chr(10) || b), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS clean FROM documents")
def clean_markdown(spark, sf):
    return docs(spark, sf).select("doc_id", text.normalize_markdown(F.col("body")).alias("clean"))


NAMES = "n AS (SELECT DISTINCT p_name AS title FROM part), t AS (SELECT title, list_distinct(list_filter(regexp_split_to_array(lower(title), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 2)) AS k FROM n)"


#: The least similarity of titles that is looked for.
SIMILAR = 0.3


@R.query(f"WITH {NAMES}, s AS (SELECT a.title AS a, b.title AS b, len(list_intersect(a.k, b.k)) / len(list_distinct(list_concat(a.k, b.k))) AS score FROM t a JOIN t b ON a.title < b.title AND len(list_intersect(a.k, b.k)) > 0) SELECT a, b, round(score, 6) AS score FROM s WHERE score >= {SIMILAR}")
def jaccard_titles(spark, sf):
    t = lens.table(spark, sf, "part").select(F.col("p_name").alias("title")).distinct().withColumn("tokens", text.align_tokens(F.col("title")))
    return resolve.similar_titles(t, SIMILAR).select("a", "b", F.round("score", 6).alias("score"))


KITS = "n AS (SELECT DISTINCT p_name AS title FROM part UNION SELECT DISTINCT p_name || ' kit' FROM part), t AS (SELECT title, list_distinct(list_filter(regexp_split_to_array(lower(title), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 2)) AS k FROM n)"


@R.query(f"WITH {KITS}, p AS (SELECT a.title AS a, b.title AS b, a.k AS ka, b.k AS kb FROM t a JOIN t b ON a.title <> b.title AND len(list_intersect(a.k, b.k)) = len(a.k)), m AS (SELECT a, b, CASE WHEN len(ka) = len(kb) THEN 'equal' WHEN len(ka) >= 2 OR (length(ka[1]) >= 5 AND len(kb) - len(ka) <= 2) THEN 'existing-in-incoming' END AS match FROM p WHERE len(ka) > 0) SELECT * FROM m WHERE match IS NOT NULL")
def token_match(spark, sf):
    """Titles, and each with one more word: the shorter lies in the longer."""
    name = lens.table(spark, sf, "part").select(F.col("p_name").alias("title")).distinct()
    t = name.unionByName(name.select(F.concat("title", F.lit(" kit")).alias("title"))).distinct().withColumn("k", text.align_tokens(F.col("title")))
    sets = t.select(F.lit("x").alias("type"), F.array_sort("k").alias("tokens")).filter(F.size("tokens") > 0).distinct()
    side = lambda c, k: t.select(F.col("title").alias(c), F.col("k").alias(f"k{c}"), F.array_sort("k").alias(k))
    met = align.contained(sets, sets).join(side("a", "small"), "small").join(side("b", "large"), "large").filter("a <> b")
    return met.select("a", "b", text.token_match(F.col("ka"), F.col("kb")).alias("match")).filter("match is not null")


CITED = "b AS (SELECT o_orderkey % 97 AS survey, string_agg('see papers/o' || o_orderkey || ' and claims/o' || (o_orderkey + 14990) || '--1.', ' ' ORDER BY o_orderkey) AS body FROM orders GROUP BY 1)"


@R.query(f"{lens.CTE}, {CITED}, c AS (SELECT DISTINCT survey, rtrim(unnest(regexp_extract_all(body, '(?:papers|claims)/[A-Za-z0-9][A-Za-z0-9._/-]*')), '.') AS cited FROM b) SELECT survey AS id, cited, cited IN (SELECT id FROM nodes WHERE type IN ('Paper', 'Claim')) AS legal FROM c")
def cite_check(spark, sf):
    k = F.col("o_orderkey")
    line = F.format_string("see papers/o%d and claims/o%d--1.", k, k + 14990)
    bodies = lens.table(spark, sf, "orders").groupBy((k % 97).alias("id")).agg(F.array_join(F.array_sort(F.collect_list(line)), " ").alias("body"))
    return integrity.cite_check(bodies, lens.nodes(spark, sf).select("id", "type"))


@R.query("WITH s AS (SELECT conv_id, conv_id % 3 AS workspace, count(*) AS n_turns, max(turn) AS updated FROM conversations GROUP BY conv_id), r AS (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY n_turns = 0, updated DESC, conv_id) AS n FROM s) SELECT workspace, conv_id AS id, updated, n_turns FROM r WHERE n <= 40")
def session_prune(spark, sf):
    c = lens.table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.max("turn").alias("updated"))
    return survey.prune_sessions(c.select((F.col("conv_id") % 3).alias("workspace"), F.col("conv_id").alias("id"), "updated", "n_turns"))


@R.query("SELECT conv_id, CASE WHEN length(t) > 36 THEN substr(t, 1, 35) || '…' ELSE t END AS title FROM (SELECT conv_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations WHERE turn = 0)")
def session_titles(spark, sf):
    return lens.table(spark, sf, "conversations").filter("turn = 0").select("conv_id", text.session_title(F.col("text")).alias("title"))


# incremental --------------------------------------------------------------------------
STAMPS = "a AS (SELECT concat('extracts/d', doc_id) AS path, sha256(CASE WHEN doc_id % 13 = 0 THEN text || '!' ELSE text END) AS s FROM documents WHERE doc_id % 11 <> 0), b AS (SELECT concat('extracts/d', doc_id) AS path, sha256(text) AS s FROM documents WHERE doc_id % 7 <> 0)"


def _stamps(spark, sf):
    d = docs(spark, sf)
    edited = F.when(F.col("doc_id") % 13 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body"))
    now = d.filter("doc_id % 11 <> 0").select(F.col("id").alias("path"), F.sha2(edited, 256).alias("sha256"))
    return now, d.filter("doc_id % 7 <> 0").select(F.col("id").alias("path"), F.sha2("body", 256).alias("sha256"))


@R.query(f"WITH {STAMPS} SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'new' WHEN a.path IS NULL THEN 'removed' WHEN a.s <> b.s THEN 'changed' ELSE 'same' END AS change FROM a FULL OUTER JOIN b ON a.path = b.path")
def delta_changes(spark, sf):
    return incremental.changes(*_stamps(spark, sf))


@R.query("WITH d AS (SELECT concat('extracts/d', doc_id) AS id, CASE WHEN doc_id % 13 = 0 THEN text || ' zzdelta' ELSE text END AS body FROM documents WHERE doc_id % 11 <> 0), p AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(body), '[a-z0-9][a-z0-9+-]{1,}')) AS token FROM d) SELECT token, count(*) AS df FROM p GROUP BY token")
def delta_refresh(spark, sf):
    """The delta-refreshed index has the document frequencies of one built anew."""
    d = docs(spark, sf)
    edited = F.when(F.col("doc_id") % 13 == 0, F.concat("body", F.lit(" zzdelta"))).otherwise(F.col("body"))
    now = d.filter("doc_id % 11 <> 0").withColumn("body", edited).withColumn("title", F.lit(None).cast("string"))
    before = d.filter("doc_id % 7 <> 0").withColumn("title", F.lit(None).cast("string"))
    stamp = lambda f: f.select(F.col("id").alias("path"), F.sha2("body", 256).alias("sha256"))
    delta = incremental.changes(stamp(now), stamp(before))
    out = incremental.refresh_postings(search.build_postings(before), now, delta)
    return out.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


@R.query("WITH s AS (SELECT concat('extracts/d', doc_id) AS path, sha256(text) AS s, doc_id % 4 AS version FROM documents WHERE doc_id % 7 <> 0), a AS (SELECT concat('extracts/d', doc_id) AS path, sha256(CASE WHEN doc_id % 13 = 0 THEN text || '!' ELSE text END) AS s FROM documents WHERE doc_id % 11 <> 0) SELECT a.path, CASE WHEN s.path IS NULL THEN 'new' WHEN s.s <> a.s THEN 'content' ELSE 'version' END AS reason FROM a LEFT JOIN s ON a.path = s.path WHERE s.path IS NULL OR s.s <> a.s OR version < 3")
def compile_plan(spark, sf):
    now, _ = _stamps(spark, sf)
    state = docs(spark, sf).filter("doc_id % 7 <> 0").select(F.col("id").alias("path"), F.sha2("body", 256).alias("sha256"), (F.col("doc_id") % 4).alias("version"))
    return incremental.to_compile(now, state, 3)


@R.query("SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def state_latest(spark, sf):
    return incremental.latest_state(lens.table(spark, sf, "events"), "user_id", ["ts", "event_id"]).select("user_id", "ts", "event_id", "event_type")


@R.query("SELECT user_id AS path, array_to_string(list_filter(['click', 'view', 'purchase', 'signup'], lambda x: NOT list_contains(list(DISTINCT event_type), x)), ',') AS missing FROM events GROUP BY user_id")
def stage_skip(spark, sf):
    done = lens.table(spark, sf, "events").groupBy(F.col("user_id").alias("path")).agg(F.collect_set("event_type").alias("stages"))
    return incremental.missing_stages(done, ["click", "view", "purchase", "signup"]).withColumn("missing", F.array_join("missing", ","))


STATUSES = ("queued", "extracting", "extracting_vision", "awaiting_vision", "compiling", "done", "failed", "needs_vision", "compile_failed")


@R.query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 9 THEN 'imported' WHEN o_orderkey % 10 <= 4 THEN 'running' WHEN o_orderkey % 10 = 5 THEN 'ok' ELSE 'failed' END AS shown FROM orders")
def process_status(spark, sf):
    status = F.get(F.array(*map(F.lit, STATUSES)), (F.col("o_orderkey") % 10).cast("int"))
    return incremental.process_status(lens.table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), status.alias("status"))).select(F.col("path").alias("o_orderkey"), "shown")


# events -------------------------------------------------------------------------------
@R.query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_hourly(spark, sf):
    return streams.hourly(lens.table(spark, sf, "events"))


@R.query("WITH o AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o) SELECT user_id, min(ts) AS begun, count(*) AS n FROM s GROUP BY user_id, k")
def events_sessions(spark, sf):
    return streams.sessions(lens.table(spark, sf, "events"))


@R.query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_hourly(spark, sf):
    """The hourly counts by a stream over the table's files, run to its end."""
    return streams.run_to_end(spark, f"{sf}/events.parquet", streams.hourly, ["hour", "event_type"])


@R.query("SELECT user_id, count(*) AS n_events, max(ts) AS last_ts FROM events GROUP BY user_id")
def stream_user_state(spark, sf):
    """Keyed state of each user kept by a stream over the table's files."""
    return streams.run_state(spark, f"{sf}/events.parquet")
