"""Queries of what a library keeps between sessions: vectors and segments that follow their texts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessellore.operators import coverage, graph, merging, pruned, search
from tessellore.plans import lens
from tessellore.plans.base import Registry
from tessellore.plans.library_queries import ALLOWED, BASE, COMPARED, CTE, HUB, UNDIRECTED
from tessellore.plans.text_queries import ASKED, PARAGRAPHS, PASSAGES, QUERY, SCORES, docs, paragraphed
from tessellore.sources import segments
from tessellore.sources.store import POSTINGS, Store
from tessellore.storage import shared_folder

R = Registry()


def _store(spark):
    return Store(spark, f"{shared_folder(spark)}/tessellore-store-{uuid.uuid4().hex}")


def _client(texts):
    return [[float(len(t)), float(sum(t.encode()[:50]))] for t in texts]


def _sources(spark, sf):
    """Documents as extracts, benchmark items as claims, with titles."""
    extracts = paragraphed(spark, sf).select("id", F.lit("x").alias("title"), F.coalesce("body", F.lit("")).alias("body"), F.lit("TextExtract").alias("type"))
    b, i = lens.table(spark, sf, "benchmark"), F.col("item_id").cast("string")
    return extracts.unionByName(b.select(F.concat(F.lit("claims/b"), i).alias("id"), F.concat(F.lit("Claim "), i).alias("title"), F.concat(F.lit("> "), F.regexp_replace("text", "\\n", "\n> ")).alias("body"), F.lit("Claim").alias("type")))


@R.query(
    f"WITH t0 AS ({PARAGRAPHS}), t AS (SELECT id, CASE WHEN n % 13 = 0 THEN body || chr(10) || chr(10) || 'An added end.' ELSE body END AS body FROM (SELECT *, substr(id, 11)::INT AS n FROM t0) WHERE n % 11 <> 0), {PASSAGES},"
    " c AS (SELECT id || '#p' || ordinal AS chunk_id, id AS source_id, passage AS text FROM ps WHERE ordinal < 16 UNION ALL SELECT 'claims/b' || item_id || '#quote', 'claims/b' || item_id, 'Claim ' || item_id || chr(10) || text FROM benchmark)"
    " SELECT chunk_id, source_id, text, length(text)::DOUBLE AS x, 'm2' AS model FROM c"
)
def synced_vectors(spark, sf):
    """Vectors after a first call, a change of model, edits, removals and new documents: as if all were embedded at once."""
    every, kept = _sources(spark, sf), _store(spark)
    n = F.regexp_extract("id", "([0-9]+)$", 1).cast("int")
    extract = F.col("type") == "TextExtract"
    first = every.filter(~extract | (n % 7 != 0))
    last = every.filter(~extract | (n % 11 != 0)).withColumn("body", F.when(extract & (n % 13 == 0), F.concat("body", F.lit("\n\nAn added end."))).otherwise(F.col("body")))
    kinds = every.select("id", "type")

    def sync(rows, model):
        return kept.refresh_vectors(rows.select("id", "title", "body"), lambda delta: search.chunks(delta.join(kinds, "id"), delta), _client, model)

    sync(first, "m1")
    sync(first, "m2")
    return sync(last, "m2").select("chunk_id", "source_id", "text", F.col("embedding")[0].cast("double").alias("x"), "model")


@R.query("SELECT 'all' AS part, count(*) AS n FROM documents WHERE doc_id % 11 <> 0 UNION ALL SELECT 'second segment', count(*) FILTER (doc_id % 97 = 0 AND doc_id % 11 <> 0) + count(*) FILTER (doc_id % 11 = 0 AND doc_id % 97 = 1) FROM documents")
def delta_segments(spark, sf):
    """How many documents the index stamps after a small delta, and how many its second segment had to write."""
    d = lens.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("extracts/d"), F.col("doc_id").cast("string")).alias("id"), F.lit(None).cast("string").alias("title"), F.coalesce("text", F.lit("")).alias("body"))
    k, kept = F.col("doc_id"), _store(spark)
    kept.build_index(d.filter((k % 11 != 0) | (k % 97 == 1)).drop("doc_id"))
    kept.refresh_index(d.filter(k % 11 != 0).withColumn("body", F.when(k % 97 == 0, F.concat("body", F.lit(" zzdelta"))).otherwise(F.col("body"))).drop("doc_id"))
    held, root = kept.entry(POSTINGS)["segments"], f"{kept.root}/{POSTINGS}"
    count = lambda frame, part: frame.agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n"))
    return count(segments.stamps(spark, root, held), "all").unionByName(count(spark.read.parquet(f"{root}/{held[-1]['name']}/stamps"), "second segment"))


# searches that read less, merges ----------------------------------------------------------
@R.query(f"WITH {SCORES} SELECT id, score FROM scores ORDER BY score DESC, id LIMIT 40")
def fts_topk_blocks(spark, sf):
    """The first forty hits from blocks of postings whose bound reaches the fortieth score."""
    found = docs(spark, sf)
    n = found.count()
    dealt, bounds = pruned.blocked(search.build_postings(found), n)
    kept = _store(spark)
    dealt, bounds = kept.save("blocked", dealt, "token"), kept.save("bounds", bounds, "token")
    return pruned.top_documents(dealt, bounds, n, QUERY)[0].select("id", F.round("score", 6).alias("score"))


@R.query(f"WITH {ASKED} SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, asked ORDER BY score DESC, id LIMIT 40")
def vector_topk_cells(spark, sf):
    """The forty nearest vectors from cells whose bound reaches the fortieth similarity."""
    e = lens.table(spark, sf, "embeddings")
    asked = [float(x) for x in e.filter("vec_id = 7").first().embedding]
    dealt, cells = pruned.celled(e.select(F.col("vec_id").alias("source_id"), "embedding"), 16)
    return pruned.top_sources(dealt, cells, asked)[0].select("id", F.round("score", 6).alias("score"))


#: Pairs of neighbouring suppliers by hashed order, every ninth page verified.
MERGES = "w AS (SELECT row_number() OVER (ORDER BY (s_suppkey * 7919) % 10007, s_suppkey) AS i, 'p' || s_suppkey AS a, 'p' || (s_suppkey * 31 + 7) % 97 AS b FROM supplier), v AS (SELECT DISTINCT x FROM (SELECT a AS x FROM w UNION ALL SELECT b FROM w) WHERE substr(x, 2)::BIGINT % 9 = 0)"


@R.query(
    f"WITH RECURSIVE {MERGES}, p AS (SELECT row_number() OVER (ORDER BY i) AS i, CASE WHEN b IN (SELECT x FROM v) THEN b ELSE a END AS keep, CASE WHEN b IN (SELECT x FROM v) THEN a ELSE b END AS gone FROM w WHERE a <> b AND NOT (a IN (SELECT x FROM v) AND b IN (SELECT x FROM v))),"
    " r AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS gone, ''::VARCHAR AS g, ''::VARCHAR AS into_page UNION ALL SELECT p.i, CASE WHEN list_contains(r.gone, p.keep) OR list_contains(r.gone, p.gone) THEN r.gone ELSE list_append(r.gone, p.gone) END, CASE WHEN list_contains(r.gone, p.keep) OR list_contains(r.gone, p.gone) THEN '' ELSE p.gone END, p.keep FROM r JOIN p ON p.i = r.i + 1)"
    " SELECT g AS gone, into_page AS into FROM r WHERE g <> ''"
)
def consolidated(spark, sf):
    """Merges in order, of which a later one may not touch what an earlier one dropped."""
    k = F.col("s_suppkey")
    w = lens.table(spark, sf, "supplier").select(F.struct(((k * 7919) % 10007).alias("h"), k.alias("k")).alias("place"), F.concat(F.lit("p"), k).alias("keep"), F.concat(F.lit("p"), (k * 31 + 7) % 97).alias("drop"))
    pages = w.select(F.explode(F.array("keep", "drop")).alias("id")).distinct()
    return merging.consolidate(w, pages.filter(F.substring("id", 2, 20).cast("long") % 9 == 0)).select("gone", "into")


@R.query(
    "WITH RECURSIVE m AS (SELECT s_suppkey AS f, CASE WHEN s_suppkey % 10 = 9 THEN s_suppkey - 2 WHEN s_suppkey % 10 = 4 THEN s_suppkey + 96 ELSE s_suppkey + 1 END AS t FROM supplier), r AS (SELECT f, t, [f] AS seen FROM m UNION ALL SELECT r.f, m.t, list_append(r.seen, r.t) FROM r JOIN m ON m.f = r.t WHERE NOT list_contains(r.seen, r.t)),"
    " e AS (SELECT f, t, seen, list_contains(seen, t) AS around FROM r QUALIFY row_number() OVER (PARTITION BY f ORDER BY len(seen) DESC) = 1), z AS (SELECT f, CASE WHEN around THEN list_min(seen[list_position(seen, t):]) ELSE t END AS t FROM e)"
    " SELECT f::VARCHAR AS from_id, t::VARCHAR AS to_id FROM z WHERE f <> t"
)
def redirect_closure(spark, sf):
    """Chains of redirects, some of which end in a cycle."""
    k = F.col("s_suppkey")
    to = F.when(k % 10 == 9, k - 2).when(k % 10 == 4, k + 96).otherwise(k + 1)
    moves = lens.table(spark, sf, "supplier").select(k.alias("from_id"), to.alias("to_id"))
    return merging.closure(moves).select(F.col("from_id").cast("string").alias("from_id"), F.col("to_id").cast("string").alias("to_id"))


@R.query(f"{CTE}, {ALLOWED}, {UNDIRECTED}, k AS (SELECT id, 0 AS hops FROM allowed WHERE id = '{HUB}' UNION SELECT a.id, k.hops + 1 FROM k JOIN und ON und.src = k.id JOIN allowed a ON a.id = und.dst WHERE k.hops < 2) SELECT id, min(hops) AS hops FROM k GROUP BY id")
def khop_adjacency(spark, sf):
    """Two steps from a hub by the kept adjacency."""
    nodes, edges = lens.nodes(spark, sf), lens.edges(spark, sf)
    return graph.neighborhood(nodes, edges, [HUB], 2, graph.adjacency(edges)).select("id", "hops")


@R.query(
    f"{BASE}, c AS (SELECT dst AS id, src AS claim FROM edges WHERE src LIKE 'claims/%' UNION SELECT paper, id FROM nodes WHERE type = 'Claim'), k AS (SELECT id, count(DISTINCT claim) AS n_claims FROM c GROUP BY id),"
    " t AS (SELECT l.paper, l.hub, l.kind, h.title, row_number() OVER (PARTITION BY l.paper, l.kind ORDER BY h.title, l.hub) AS n FROM links l JOIN nodes h ON h.id = l.hub),"
    f" g AS (SELECT paper, string_agg(kind || ' ' || hub, ',' ORDER BY kind, title, hub) AS hubs FROM t WHERE n <= 12 GROUP BY paper) SELECT p.id, p.title, p.published, coalesce(hubs, '') AS hubs, coalesce(n_claims, 0) AS n_claims FROM nodes p LEFT JOIN g ON g.paper = p.id LEFT JOIN k ON k.id = p.id WHERE p.type = 'Paper' AND p.id IN {COMPARED}"
)
def compare_cards(spark, sf):
    """The cards of papers that are compared: their hubs by kind and title, and their claims."""
    nodes, edges = lens.nodes(spark, sf), lens.edges(spark, sf)
    cards = graph.paper_cards(nodes, edges, coverage.hub_links(nodes, edges), COMPARED)
    return cards.select("id", "title", "published", F.array_join(F.transform("hubs", lambda h: F.concat_ws(" ", h.kind, h.id)), ",").alias("hubs"), "n_claims")
