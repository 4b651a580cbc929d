"""Queries over the order library: coverage, census, graph, checks, resolution, merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellore import schema
from tessellore.functions import text
from tessellore.operators import align, coverage, graph, integrity, merge, resolve, search, survey
from tessellore.plans import lens
from tessellore.plans.base import Registry

R = Registry()
CTE = lens.CTE
HUBS = "'Topic', 'Method', 'Entity', 'Dataset', 'Gene', 'Pathway'"
LINKS = f"""links AS (SELECT DISTINCT p.id AS paper, h.id AS hub, h.type AS kind
  FROM (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges) e
  JOIN nodes p ON p.id = e.a AND p.type = 'Paper' JOIN nodes h ON h.id = e.b AND h.type IN ({HUBS}))"""
LIVE = "live AS (SELECT id AS paper, title, published, substr(published, 1, 4) AS year FROM nodes WHERE type = 'Paper' AND status <> 'deprecated')"
BASE = f"{CTE}, {LINKS}, {LIVE}"
TOPIC = "topics/promo"


def both(spark, sf):
    return lens.nodes(spark, sf), lens.edges(spark, sf)


# coverage -----------------------------------------------------------------------------
@R.query(f"{BASE} SELECT hub AS topic_id, year, count(DISTINCT paper) AS n_papers FROM links JOIN live USING (paper) WHERE kind = 'Topic' AND year IS NOT NULL GROUP BY hub, year")
def cov_topic_year(spark, sf):
    return coverage.topic_year_counts(*both(spark, sf))


@R.query(f"{BASE} SELECT hub AS topic_id, year, count(DISTINCT paper) AS n_papers, string_agg(DISTINCT paper, ',' ORDER BY paper) AS papers FROM links JOIN live USING (paper) WHERE kind = 'Topic' AND year IS NOT NULL GROUP BY hub, year")
def cov_topic_year_papers(spark, sf):
    return coverage.topic_years(*both(spark, sf)).withColumn("papers", F.array_join("papers", ","))


@R.query(f"{BASE} SELECT t.hub AS topic_id, o.kind, o.hub, count(DISTINCT t.paper) AS n_papers FROM links t JOIN links o USING (paper) JOIN live USING (paper) WHERE t.kind = 'Topic' AND o.kind IN ('Method', 'Dataset', 'Gene', 'Pathway') GROUP BY t.hub, o.kind, o.hub")
def cov_topic_hub(spark, sf):
    return coverage.topic_hubs(*both(spark, sf))


@R.query(f"{BASE} SELECT min(year) AS first_year, max(year) AS last_year FROM live")
def cov_year_span(spark, sf):
    return coverage.live_papers(lens.nodes(spark, sf)).agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))


@R.query(f"{BASE}, c AS (SELECT hub AS topic_id, year, count(DISTINCT paper) AS n FROM links JOIN live USING (paper) WHERE kind = 'Topic' GROUP BY hub, year) SELECT topic_id, " + ", ".join(f"coalesce(sum(n) FILTER (year = '{y}'), 0)::BIGINT AS \"{y}\"" for y in range(1995, 2002)) + " FROM c WHERE year IS NOT NULL GROUP BY topic_id")
def cov_heatmap(spark, sf):
    return coverage.heatmap(*both(spark, sf), [str(y) for y in range(1995, 2002)])


#: Every topic has papers in all years, so customers stand in for topics where gaps are looked for.
SWAPPED = f"""{CTE}, swapped AS (SELECT * REPLACE (CASE type WHEN 'Entity' THEN 'Topic' WHEN 'Topic' THEN 'Entity' ELSE type END AS type) FROM nodes),
  {LINKS.replace('JOIN nodes', 'JOIN swapped')}, {LIVE.replace('FROM nodes', 'FROM swapped')}"""
CUSTOMER = "entities/customer-000000001"


def swapped(spark, sf):
    """Nodes and links in which customers are topics and product types are entities."""
    swap = lambda c: F.when(F.col(c) == "Entity", "Topic").when(F.col(c) == "Topic", "Entity").otherwise(F.col(c))
    nodes, edges = both(spark, sf)
    return nodes.withColumn("type", swap("type")), edges.withColumn("src_type", swap("src_type")).withColumn("dst_type", swap("dst_type"))


AXIS = "axis AS (SELECT CAST(unnest(range(min(CAST(year AS INT)), max(CAST(year AS INT)) + 1)) AS VARCHAR) AS year FROM live)"
CELLS = "cells AS (SELECT DISTINCT hub AS topic_id, year FROM links JOIN live USING (paper) WHERE kind = 'Topic' AND year IS NOT NULL)"
USED = "used AS (SELECT DISTINCT kind, hub FROM links JOIN live USING (paper) WHERE kind IN ('Method', 'Dataset', 'Gene', 'Pathway'))"


@R.query(f"{SWAPPED}, {AXIS}, {CELLS} SELECT t.topic_id, axis.year FROM (SELECT DISTINCT topic_id FROM cells) t CROSS JOIN axis ANTI JOIN cells c ON c.topic_id = t.topic_id AND c.year = axis.year")
def gap_missing_year(spark, sf):
    return coverage.missing_years(*swapped(spark, sf))


MISSING_HUB = f"SELECT '{TOPIC}' AS topic_id, kind, hub FROM used WHERE hub NOT IN (SELECT o.hub FROM links t JOIN links o USING (paper) JOIN live USING (paper) WHERE t.hub = '{TOPIC}')"


@R.query(f"{SWAPPED}, {USED} " + MISSING_HUB.replace(TOPIC, CUSTOMER))
def gap_missing_hub(spark, sf):
    return coverage.missing_hubs(*swapped(spark, sf), CUSTOMER)


@R.query(f"{BASE} SELECT paper FROM live WHERE year IS NULL")
def gap_undated(spark, sf):
    return coverage.undated(lens.nodes(spark, sf))


GAPS = f"""gaps AS (SELECT concat_ws(':', 'year', t.topic_id, axis.year) AS gap_id, 'missing-year' AS kind FROM (SELECT DISTINCT topic_id FROM cells WHERE topic_id = '{TOPIC}') t CROSS JOIN axis ANTI JOIN cells c ON c.topic_id = t.topic_id AND c.year = axis.year
  UNION ALL SELECT concat_ws(':', lower(kind), topic_id, hub), 'missing-' || lower(kind) FROM ({MISSING_HUB})
  UNION ALL SELECT 'undated:' || paper, 'undated' FROM live WHERE year IS NULL)"""


@R.query(f"{BASE}, {AXIS}, {CELLS}, {USED}, {GAPS} SELECT gap_id, kind FROM gaps")
def gap_all(spark, sf):
    return coverage.gaps(*both(spark, sf), TOPIC)


@R.query(f"{BASE}, {AXIS}, {CELLS}, {USED}, {GAPS} SELECT 'questions/' || substr(regexp_replace(regexp_replace(lower(gap_id), '[:/ ]', '-', 'g'), '-+', '-', 'g'), 1, 80) AS id, kind, gap_id FROM gaps WHERE gap_id NOT LIKE '%50' ORDER BY gap_id LIMIT 50")
def draft_questions(spark, sf):
    found = coverage.gaps(*both(spark, sf), TOPIC)
    existing = found.filter(F.col("gap_id").endswith("50")).select(F.concat(F.lit("questions/"), F.regexp_replace("gap_id", "[:/]", "-")).alias("id"))
    return coverage.draft_questions(found, existing)


@R.query(f"{BASE}, n AS (SELECT substr(p.published, 1, 4) AS year, hub AS topic_id, count(*) AS n_papers FROM links JOIN nodes p ON p.id = links.paper WHERE kind = 'Topic' AND p.published IS NOT NULL GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY year ORDER BY n_papers DESC, topic_id)::INT AS rank FROM n")
def hotspots(spark, sf):
    return coverage.hotspots(*both(spark, sf))


@R.query(f"{BASE} SELECT type, count(*) AS n FROM nodes WHERE status <> 'deprecated' GROUP BY type")
def stats_counts(spark, sf):
    return coverage.census(lens.nodes(spark, sf))


@R.query(f"{BASE} SELECT year, count(*) AS n FROM live WHERE year IS NOT NULL GROUP BY year")
def stats_years(spark, sf):
    return coverage.papers_by_year(lens.nodes(spark, sf))


@R.query(f"{BASE} SELECT lower(tag) AS tag, count(DISTINCT id) AS n FROM nodes WHERE type = 'Paper' AND status <> 'deprecated' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 16")
def stats_tags(spark, sf):
    return coverage.tag_census(lens.nodes(spark, sf))


@R.query(f"{BASE}, c AS (SELECT kind, hub, count(*) AS n FROM links GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, hub)::INT AS rank FROM c) SELECT * FROM r WHERE rank <= 16")
def stats_hubs(spark, sf):
    return coverage.hub_ranking(*both(spark, sf))


@R.query(f"{BASE}, r AS (SELECT paper, count(*) AS c FROM nodes WHERE type = 'Claim' AND confidence = 'reviewed' GROUP BY paper) SELECT hub AS topic_id, coalesce(sum(c), 0)::BIGINT AS n_reviewed, coalesce(sum(c), 0) >= 3 AS answered FROM links LEFT JOIN r USING (paper) WHERE kind = 'Topic' GROUP BY hub")
def question_answered(spark, sf):
    return coverage.answered_questions(*both(spark, sf))


@R.query(f"{BASE}, p AS (SELECT year, paper, published, row_number() OVER (PARTITION BY year ORDER BY published DESC, paper)::INT AS place FROM live WHERE year IS NOT NULL AND paper IN (SELECT paper FROM links WHERE hub = '{TOPIC}')) SELECT * FROM p WHERE place <= 6")
def survey_buckets(spark, sf):
    return coverage.survey_buckets(*both(spark, sf), TOPIC)


@R.query(f"{BASE}, c AS (SELECT id, confidence, paper, row_number() OVER (PARTITION BY confidence ORDER BY id)::INT AS place FROM nodes WHERE type = 'Claim' AND confidence IN ('reviewed', 'extracted') AND paper IN (SELECT paper FROM links JOIN live USING (paper) WHERE hub = '{TOPIC}')) SELECT * FROM c WHERE place <= 24")
def survey_claims(spark, sf):
    from pyspark.sql import Window

    nodes, edges = both(spark, sf)
    papers = coverage.hub_links(nodes, edges, ("Topic",)).filter(F.col("hub") == TOPIC).join(coverage.live_papers(nodes).select("paper"), "paper", "left_semi").select("paper")
    claims = nodes.filter((F.col("type") == "Claim") & F.col("confidence").isin("reviewed", "extracted")).join(papers, "paper", "left_semi")
    place = F.row_number().over(Window.partitionBy("confidence").orderBy("id"))
    return claims.withColumn("place", place).filter("place <= 24").select("id", "confidence", "paper", "place")


# graph --------------------------------------------------------------------------------
@R.query(f"{CTE} SELECT src AS id, count(*) AS n_out FROM edges GROUP BY src")
def edges_out(spark, sf):
    return graph.out_degree(lens.edges(spark, sf))


DEGREE = "deg AS (SELECT id, coalesce(o.n, 0) AS n_out, coalesce(i.n, 0) AS n_in, coalesce(o.n, 0) + coalesce(i.n, 0) AS degree FROM nodes LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY src) o ON o.src = id LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY dst) i ON i.dst = id)"


@R.query(f"{CTE}, {DEGREE} SELECT * FROM deg")
def degree(spark, sf):
    return graph.degree(*both(spark, sf))


HUB = "entities/customer-000000001"


@R.query(f"{CTE} SELECT DISTINCT id, title, type, paper FROM nodes JOIN edges ON src = id WHERE dst = '{HUB}'")
def backlinks(spark, sf):
    return graph.backlinks(*both(spark, sf), HUB)


RANK = "CASE type WHEN 'Paper' THEN 0 WHEN 'Topic' THEN 1 WHEN 'Method' THEN 2 WHEN 'Entity' THEN 3 WHEN 'Dataset' THEN 4 WHEN 'Gene' THEN 5 WHEN 'Pathway' THEN 6 WHEN 'Claim' THEN 7 ELSE 8 END"
PAPER = "papers/o1"


@R.query(f"{CTE}, n AS (SELECT dst AS id, 1 AS o, 0 AS i FROM edges WHERE src = '{PAPER}' UNION ALL SELECT src, 0, 1 FROM edges WHERE dst = '{PAPER}'), m AS (SELECT id, max(o) AS o, max(i) AS i FROM n GROUP BY id) SELECT id, title, type, {RANK} AS rank, CASE WHEN o = 1 AND i = 1 THEN 'both' WHEN o = 1 THEN 'out' ELSE 'in' END AS direction FROM nodes JOIN m USING (id)")
def neighbors_merged(spark, sf):
    return graph.neighbors(*both(spark, sf), PAPER)


ALLOWED = "allowed AS (SELECT id FROM nodes WHERE status <> 'deprecated' AND NOT (type = 'Claim' AND coalesce(confidence, '') = 'disputed'))"
UNDIRECTED = "und AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"


@R.query(f"{CTE}, {ALLOWED}, {UNDIRECTED}, k AS (SELECT id, 0 AS hops FROM allowed WHERE id = '{HUB}' UNION SELECT a.id, k.hops + 1 FROM k JOIN und ON und.src = k.id JOIN allowed a ON a.id = und.dst WHERE k.hops < 2) SELECT id, min(hops) AS hops FROM k GROUP BY id")
def khop_undirected(spark, sf):
    return graph.neighborhood(*both(spark, sf), [HUB], 2)


@R.query(f"{CTE}, {ALLOWED}, k AS (SELECT id, 0 AS hops FROM nodes WHERE id = 'datasets/supplier-000000001' UNION SELECT n.id, k.hops + 1 FROM k JOIN edges ON edges.src = k.id JOIN nodes n ON n.id = edges.dst WHERE k.hops < 2) SELECT id, any_value(type) AS type, min(hops) AS hops FROM k JOIN allowed USING (id) JOIN nodes USING (id) GROUP BY id")
def walk_directed(spark, sf):
    return graph.walk(*both(spark, sf), "datasets/supplier-000000001", 2)


#: All papers and hubs fit and 200 claims do, so all tiers are met.
CAPPED = f"""{CTE}, {ALLOWED}, {DEGREE}, g AS MATERIALIZED (SELECT id, type, paper, degree FROM nodes JOIN allowed USING (id) JOIN deg USING (id)), p AS (SELECT id FROM g WHERE type = 'Paper'),
  t AS (SELECT dst AS id FROM edges JOIN p ON src = p.id UNION SELECT src FROM edges JOIN p ON dst = p.id), c AS (SELECT id, paper, row_number() OVER (PARTITION BY coalesce(paper, '__claim:' || id) ORDER BY degree DESC, id) AS turn FROM g WHERE type = 'Claim')
  SELECT id, type, 0 AS tier FROM g WHERE type = 'Paper' UNION ALL SELECT g.id, g.type, CASE WHEN t.id IS NULL THEN 2 ELSE 1 END FROM g LEFT JOIN t ON t.id = g.id WHERE g.type NOT IN ('Paper', 'Claim')
  UNION ALL SELECT id, 'Claim', 3 FROM (SELECT * FROM c ORDER BY turn, paper, id LIMIT 200)"""


@R.query(CAPPED)
def graph_capped(spark, sf):
    nodes, edges = both(spark, sf)
    fits = graph.graph_nodes(nodes).filter("type <> 'Claim'").count()
    return graph.select_capped(nodes, edges, fits + 200)


@R.query(f"{CTE}, {ALLOWED}, {DEGREE} SELECT id, type, 0 AS tier FROM nodes JOIN allowed USING (id) JOIN deg USING (id) WHERE type = 'Paper' ORDER BY degree DESC, id LIMIT 48")
def graph_capped_papers(spark, sf):
    return graph.select_capped(*both(spark, sf), 48)


@R.query(f"{CTE}, {ALLOWED}, {DEGREE}, c AS (SELECT id, paper, degree FROM nodes JOIN allowed USING (id) JOIN deg USING (id) WHERE type = 'Claim'), w AS (SELECT *, row_number() OVER (PARTITION BY coalesce(paper, '__claim:' || id) ORDER BY degree DESC, id) AS turn FROM c) SELECT id, paper, degree, paper AS grp, turn::INT AS turn FROM w ORDER BY turn, paper, id LIMIT 200")
def fair_claims(spark, sf):
    nodes, edges = both(spark, sf)
    claims = graph.graph_nodes(nodes).filter(F.col("type") == "Claim").select("id", "paper").join(graph.degree(nodes, edges).select("id", "degree"), "id")
    return graph.fair_claims(claims, 200)


@R.query(f"{CTE}, {ALLOWED}, {UNDIRECTED}, k AS (SELECT '{HUB}' AS id UNION SELECT a.id FROM und JOIN allowed a ON a.id = und.dst WHERE und.src = '{HUB}') SELECT src, dst FROM edges WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
def graph_edges_induced(spark, sf):
    nodes, edges = both(spark, sf)
    return graph.induced(edges, graph.neighborhood(nodes, edges, [HUB], 1)).select("src", "dst")


@R.query(f"{CTE} SELECT count(*) FILTER (type = 'Claim' AND status <> 'deprecated') AS n_claims, count(*) FILTER (type = 'Claim' AND status <> 'deprecated') >= 40 AS hide FROM nodes")
def graph_hide_claims(spark, sf):
    n = F.count_if((F.col("type") == "Claim") & (F.col("status") != "deprecated"))
    return lens.nodes(spark, sf).agg(n.alias("n_claims"), (n >= 40).alias("hide"))


ISSUES = f"""real AS (SELECT src AS node, dst AS id, 0 AS i FROM edges WHERE src <> dst UNION ALL SELECT dst, src, 1 FROM edges WHERE src <> dst),
  seen AS (SELECT node, count(*) AS n, count(*) FILTER (o.type <> 'Claim') AS n_other, sum(i) AS n_in FROM real JOIN nodes o ON o.id = real.id GROUP BY node),
  found AS (SELECT CASE WHEN type = 'Paper' AND coalesce(n, 0) = 0 THEN 'isolated-paper' WHEN type = 'Paper' AND coalesce(n_other, 0) = 0 THEN 'claim-only-paper'
    WHEN type IN ({HUBS}) AND coalesce(n, 0) = 0 THEN 'isolated-concept' WHEN type IN ({HUBS}) AND coalesce(n_in, 0) = 0 THEN 'unreferenced-concept' END AS category, nodes.id
    FROM nodes LEFT JOIN seen ON seen.node = nodes.id WHERE status <> 'deprecated'
    UNION ALL SELECT 'dead-link', src || ' -> ' || dst FROM edges ANTI JOIN nodes ON nodes.id = edges.dst)"""


@R.query(f"{CTE}, {ISSUES} SELECT category, id FROM found WHERE category IS NOT NULL")
def check_issues(spark, sf):
    return graph.issues(*both(spark, sf))


@R.query(f"{CTE}, {ISSUES} SELECT category, count(*) AS n FROM found WHERE category IS NOT NULL GROUP BY category")
def check_summary(spark, sf):
    return graph.issues(*both(spark, sf)).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@R.query(f"{CTE}, {ISSUES} SELECT id FROM found WHERE category = 'isolated-paper'")
def check_isolated(spark, sf):
    return graph.issues(*both(spark, sf)).filter("category = 'isolated-paper'").select("id")


@R.query(f"{CTE}, {ISSUES} SELECT id FROM found WHERE category = 'unreferenced-concept'")
def check_unreferenced(spark, sf):
    return graph.issues(*both(spark, sf)).filter("category = 'unreferenced-concept'").select("id")


COMPARED = tuple(f"papers/o{k}" for k in range(1, 25))


@R.query(f"{BASE} SELECT hub, kind, count(DISTINCT paper) AS n_papers, count(DISTINCT paper) = 24 AS in_all FROM links WHERE paper IN {COMPARED} GROUP BY hub, kind HAVING count(DISTINCT paper) >= 2")
def compare_shared(spark, sf):
    nodes, edges = both(spark, sf)
    return graph.shared_hubs(nodes, coverage.hub_links(nodes, edges), COMPARED)


@R.query(f"{BASE} SELECT hub, kind, count(DISTINCT paper) AS n_papers FROM links WHERE paper IN ('papers/o1', 'papers/o2') GROUP BY hub, kind HAVING count(DISTINCT paper) = 2")
def compare_in_all(spark, sf):
    nodes, edges = both(spark, sf)
    return graph.shared_hubs(nodes, coverage.hub_links(nodes, edges), ("papers/o1", "papers/o2")).filter("in_all").drop("in_all")


@R.query(f"{CTE}, c AS (SELECT dst AS id, src AS claim FROM edges WHERE src LIKE 'claims/%' UNION SELECT paper, id FROM nodes WHERE type = 'Claim') SELECT c.id, count(DISTINCT claim) AS n_claims FROM c JOIN nodes ON nodes.id = c.id AND type = 'Paper' GROUP BY c.id")
def claim_counts(spark, sf):
    return graph.claim_counts(*both(spark, sf))


# filters and inheritance --------------------------------------------------------------
FILTERED = f"""{CTE}, f AS (SELECT n.id, n.type, n.status, coalesce(n.published, p.published) AS published, coalesce(n.tag, p.tag) AS tag
  FROM nodes n LEFT JOIN nodes p ON p.id = n.paper AND p.type = 'Paper')"""


def _inherited(spark, sf):
    nodes = lens.nodes(spark, sf)
    return search.inherit(nodes, nodes.filter(F.col("type") == "Paper"))


@R.query(f"{FILTERED} SELECT id, published, tag FROM f WHERE type = 'Claim'")
def inherit_paper_fields(spark, sf):
    return _inherited(spark, sf).filter(F.col("type") == "Claim").select("id", "published", F.get("tags", F.lit(0)).alias("tag"))


@R.query(f"{FILTERED} SELECT id FROM f WHERE type = 'Claim' AND status = 'stable' AND published >= '1996-03' AND published <= '1997' AND tag = '1-urgent'")
def filter_status_tags_dates(spark, sf):
    return search.retrieve(_inherited(spark, sf), kind="Claim", low="1996-03", high="1997", tags=["1-urgent"]).select("id")


@R.query(f"{FILTERED} SELECT id FROM f WHERE type = 'Paper' AND status = 'stable' AND substr(published, 1, 4) BETWEEN '1996' AND '1997'")
def filter_inclusive_year(spark, sf):
    kept = search.retrieve(_inherited(spark, sf), kind="Paper")
    return kept.filter(search.within(F.col("published"), "1996", "1997", inclusive_year=True)).select("id")


@R.query(f"{CTE} SELECT id, published, title, row_number() OVER (ORDER BY published DESC NULLS LAST, title)::INT AS place FROM nodes WHERE type = 'Paper' AND published >= '2001-01' ORDER BY published DESC NULLS LAST, title LIMIT 80")
def papers_newest(spark, sf):
    from pyspark.sql import Window

    kept = lens.nodes(spark, sf).filter((F.col("type") == "Paper") & (F.col("published") >= "2001-01")).select("id", "published", "title")
    top = kept.orderBy(F.col("published").desc_nulls_last(), "title").limit(80)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.col("published").desc_nulls_last(), "title")))  # 80 rows


@R.query(f"{CTE} SELECT id, title FROM nodes WHERE type = 'Paper' AND published >= '1998' AND published <= '1999' AND (contains(lower(title), '12') OR contains(id, '12') OR contains(coalesce(tag, ''), '12'))")
def ui_paper_filter(spark, sf):
    hit = F.contains(F.lower("title"), F.lit("12")) | F.contains("id", F.lit("12")) | F.exists("tags", lambda t: F.contains(t, F.lit("12")))
    return lens.nodes(spark, sf).filter((F.col("type") == "Paper") & search.within(F.col("published"), "1998", "1999") & hit).select("id", "title")


# resolution ---------------------------------------------------------------------------
KEY = "regexp_replace(regexp_replace(lower(trim({0})), '^(the|an|a)\\s+', ''), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def hubs(spark, sf, kinds):
    rows = lens.nodes(spark, sf).filter(F.col("type").isin(*kinds))
    return rows.select("type", F.col("id").alias("path"), "title", F.array().cast("array<string>").alias("aliases"))


def _genes(alias):
    return f"(SELECT id AS path, title, {KEY.format('title')} AS key FROM nodes WHERE type = 'Gene') {alias}"


@R.query(
    f"{CTE}, h AS (SELECT type, id, title, {KEY.format('title')} AS key FROM nodes WHERE type IN ({HUBS})), k AS (SELECT type, 'c:' || key AS key, id AS path, 0 AS rank FROM h UNION ALL SELECT type, 's:' || regexp_replace(regexp_replace(regexp_replace(lower(title), '\\s+', '-', 'g'), '[^\\p{{L}}\\p{{N}}-]', '', 'g'), '-+', '-', 'g'), id, 2 FROM h"
    " UNION ALL SELECT type, 's:' || regexp_replace(id, '^.*/', ''), id, 2 FROM h UNION ALL SELECT type, 'c:' || CASE WHEN length(key) <= 5 THEN NULL WHEN key LIKE '%s' AND key NOT LIKE '%ss' THEN key[:-2] ELSE key || 's' END, id, 3 FROM h) SELECT type, key, path, CASE min(rank) WHEN 0 THEN 'title' WHEN 2 THEN 'slug' ELSE 'stem' END AS kind FROM k WHERE key IS NOT NULL GROUP BY type, key, path"
)
def align_keys(spark, sf):
    return align.align_keys(hubs(spark, sf, schema.HUB_TYPES))


@R.query(f"{CTE} SELECT 'Gene' AS type, least(a.path, b.path) AS a, greatest(a.path, b.path) AS b, levenshtein(a.key, b.key)::INT AS distance FROM {_genes('a')} JOIN {_genes('b')} ON a.key < b.key AND length(a.key) >= 6 AND length(b.key) >= 6 AND levenshtein(a.key, b.key) <= 2")
def near_dup_pairs(spark, sf):
    return resolve.edit_pairs(hubs(spark, sf, ("Gene",)))


@R.query(f"{CTE} SELECT a.path AS a, b.path AS b, 'edit-distance:' || levenshtein(a.key, b.key) AS reason FROM {_genes('a')} JOIN {_genes('b')} ON a.path < b.path AND length(a.key) >= 6 AND length(b.key) >= 6 AND a.key <> b.key AND levenshtein(a.key, b.key) <= 2")
def near_duplicate_reasons(spark, sf):
    rows = hubs(spark, sf, ("Gene",))
    return _reasoned(rows, resolve.near_duplicate_reason(F.col("type"), F.col("a_title"), F.col("b_title")))


def _reasoned(rows, reason):
    pairs = resolve.candidate_pairs(rows)
    title = lambda side: rows.select(F.col("path").alias(side), F.col("title").alias(f"{side}_title"))
    return pairs.join(title("a"), "a").join(title("b"), "b").select("a", "b", reason.alias("reason")).filter("reason is not null")


#: The titles of parts, and those with their words turned, with one more, as plurals or as versions, so that each reason is met.
TITLES = f"""m AS (SELECT DISTINCT length(p_name) AS k, p_name AS title FROM part), v AS (SELECT DISTINCT title FROM m UNION SELECT CASE k % 4 WHEN 0 THEN regexp_replace(title, '^(\\S+) (\\S+)', '\\2 \\1') WHEN 1 THEN title || ' kit' WHEN 2 THEN 'The ' || title || 's' ELSE title || ' 2' END FROM m),
  t AS (SELECT concat('entities/', replace(title, ' ', '-')) AS path, title, {KEY.format('title')} AS key, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(title, '\\([^)]*\\)', ' ', 'g')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 2 AND x NOT IN {text.TOKEN_STOPS}))) AS k FROM v),
  p AS (SELECT a.path AS a, b.path AS b, a.title AS ta, b.title AS tb, a.key AS ka, b.key AS kb, a.k AS la, b.k AS lb, len(list_intersect(a.k, b.k)) AS met FROM t a JOIN t b ON a.path < b.path),
  f AS (SELECT *, regexp_matches(ka, '[0-9]') AND regexp_matches(kb, '[0-9]') AND length(regexp_replace(ka, '[^a-z0-9]+', '', 'g')) <= 16 AND length(regexp_replace(kb, '[^a-z0-9]+', '', 'g')) <= 16 AND regexp_replace(ka, '[^a-z0-9]+', '', 'g') <> regexp_replace(kb, '[^a-z0-9]+', '', 'g') AS symbols,
    trim(regexp_replace(lower(ta), '[\\s._-]*v?\\d+(\\.\\d+)*$', '')) AS sa, trim(regexp_replace(lower(tb), '[\\s._-]*v?\\d+(\\.\\d+)*$', '')) AS sb,
    (len(la) > 0 AND met = len(la) AND len(lb) > len(la) AND (len(la) >= 2 OR (length(la[1]) >= 5 AND len(lb) - len(la) <= 2))) OR (len(lb) > 0 AND met = len(lb) AND len(la) > len(lb) AND (len(lb) >= 2 OR (length(lb[1]) >= 5 AND len(la) - len(lb) <= 2))) AS contained FROM p)"""
_DISTANCE = "CASE WHEN length(ka) >= 6 AND length(kb) >= 6 AND ka <> kb AND levenshtein(ka, kb) <= 2 THEN 'edit-distance:' || levenshtein(ka, kb) END"


def _variants(spark, sf):
    base = lens.table(spark, sf, "part").select(F.length("p_name").alias("k"), F.col("p_name").alias("title")).distinct()
    turned = F.when(F.col("k") % 4 == 0, F.regexp_replace("title", r"^(\S+) (\S+)", "$2 $1")).when(F.col("k") % 4 == 1, F.concat("title", F.lit(" kit"))).when(F.col("k") % 4 == 2, F.concat(F.lit("The "), "title", F.lit("s"))).otherwise(F.concat("title", F.lit(" 2")))
    rows = base.select("title").unionByName(base.select(turned.alias("title"))).distinct()
    return rows.select(F.lit("Entity").alias("type"), F.concat(F.lit("entities/"), F.replace("title", F.lit(" "), F.lit("-"))).alias("path"), "title", F.array().cast("array<string>").alias("aliases"))


@R.query(f"WITH {TITLES} SELECT a, b, CASE WHEN ka <> '' AND ka = kb THEN 'align:title' ELSE coalesce({_DISTANCE}, CASE WHEN len(la) > 0 AND la = lb THEN 'token:equal' WHEN contained AND abs(len(la) - len(lb)) <= 2 THEN 'token:contain' END) END AS reason FROM f WHERE NOT symbols AND NOT (sa <> '' AND sa = sb AND regexp_replace(ta, '\\s+', '', 'g') <> regexp_replace(tb, '\\s+', '', 'g')) AND reason IS NOT NULL")
def auto_merge_reason(spark, sf):
    """All branches of the decision list but aliases: guards, titles, edits, token sets."""
    none = F.array().cast("array<string>")
    return _reasoned(_variants(spark, sf), resolve.merge_reason(F.col("type"), F.col("a_title"), F.col("b_title"), none, none))


@R.query(f"WITH {TITLES} SELECT count(*) AS blocked, count(*) FILTER (sa <> '' AND sa = sb) AS versions, count(*) FILTER (symbols) AS symbols FROM f WHERE (symbols OR (sa <> '' AND sa = sb AND regexp_replace(ta, '\\s+', '', 'g') <> regexp_replace(tb, '\\s+', '', 'g'))) AND (ka = kb OR {_DISTANCE} IS NOT NULL OR contained OR (len(la) > 0 AND la = lb))")
def auto_merge_blocked(spark, sf):
    """How many pairs that look alike the guards keep apart."""
    rows = _variants(spark, sf)
    none = F.array().cast("array<string>")
    a, b = F.col("a_title"), F.col("b_title")
    ka, kb = text.align_key(a), text.align_key(b)
    far = F.levenshtein(ka, kb, resolve.EDIT_MOST)
    near = (ka == kb) | ((F.length(ka) >= 6) & (F.length(kb) >= 6) & (far > 0)) | text.tokens_equal(text.align_tokens(a), text.align_tokens(b)) | (F.coalesce(text.token_match(text.align_tokens(a), text.align_tokens(b)), text.token_match(text.align_tokens(b), text.align_tokens(a))) == "existing-in-incoming")
    pairs = resolve.candidate_pairs(rows)
    title = lambda side: rows.select(F.col("path").alias(side), F.col("title").alias(f"{side}_title"))
    met = pairs.join(title("a"), "a").join(title("b"), "b").filter(near & resolve.merge_reason(F.col("type"), a, b, none, none).isNull())
    stem = lambda t: F.trim(F.regexp_replace(F.lower(t), r"[\s._-]*v?\d+(\.\d+)*$", ""))
    return met.agg(F.count(F.lit(1)).alias("blocked"), F.count_if((stem(a) != "") & (stem(a) == stem(b))).alias("versions"), F.count_if(text.symbol_pair(ka, kb)).alias("symbols"))


PAIRS = f"pairs AS (SELECT least(a.path, b.path) AS a, greatest(a.path, b.path) AS b FROM {_genes('a')} JOIN {_genes('b')} ON a.key < b.key AND length(a.key) >= 6 AND length(b.key) >= 6 AND levenshtein(a.key, b.key) <= 2)"


@R.query(f"{BASE}, {PAIRS}, n AS (SELECT hub, count(*) AS n FROM links GROUP BY hub), c AS (SELECT a, b, (-coalesce(x.n, 0), length(a), a) < (-coalesce(y.n, 0), length(b), b) AS f FROM pairs LEFT JOIN n x ON x.hub = a LEFT JOIN n y ON y.hub = b) SELECT a, b, CASE WHEN f THEN a ELSE b END AS keep, CASE WHEN f THEN b ELSE a END AS drop FROM c")
def canonical_choice(spark, sf):
    nodes, edges = both(spark, sf)
    links = coverage.hub_links(nodes, edges, ("Gene",)).groupBy(F.col("hub").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    return resolve.canonical(resolve.edit_pairs(hubs(spark, sf, ("Gene",))).select("a", "b"), links)


@R.query(f"{CTE}, {PAIRS}, d AS (SELECT b AS x, a AS y FROM pairs WHERE a LIKE '%r%') SELECT p.a, p.b FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM d WHERE least(x, y) = p.a AND greatest(x, y) = p.b)")
def dismissed_pairs(spark, sf):
    pairs = resolve.edit_pairs(hubs(spark, sf, ("Gene",))).select("a", "b")
    gone = pairs.filter(F.col("a").contains("r")).select(F.col("b").alias("a"), F.col("a").alias("b"))
    return integrity.without_dismissed(pairs, gone)


@R.query(f"{CTE}, {PAIRS}, i AS (SELECT 'disputed_claim' AS kind, id AS path, paper AS other, 'disputed' AS reason FROM nodes WHERE type = 'Claim' AND confidence = 'disputed' UNION ALL SELECT 'undated_paper', id, NULL, 'no date' FROM nodes WHERE type = 'Paper' AND published IS NULL AND status <> 'deprecated' UNION ALL SELECT 'near_duplicate', a, b, 'pair' FROM pairs) SELECT kind, count(*) AS n FROM i GROUP BY kind")
def review_counts(spark, sf):
    return integrity.review_counts(_review(spark, sf))


@R.query(f"{CTE}, {PAIRS}, i AS (SELECT 'disputed_claim' AS kind, id AS path, paper AS other, 'disputed' AS reason FROM nodes WHERE type = 'Claim' AND confidence = 'disputed' UNION ALL SELECT 'undated_paper', id, NULL, 'no date' FROM nodes WHERE type = 'Paper' AND published IS NULL AND status <> 'deprecated' UNION ALL SELECT 'near_duplicate', a, b, 'pair' FROM pairs), p AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY path, coalesce(other, '')) AS place, count(*) OVER (PARTITION BY kind) AS n FROM i) SELECT kind, path, other, reason, n > 40 AS truncated FROM p WHERE place <= 40")
def review_capped(spark, sf):
    return integrity.capped_review(_review(spark, sf))


@R.query(f"{CTE} SELECT 'disputed_claim' AS kind, paper, min(id) AS first, count(*) AS n FROM nodes WHERE type = 'Claim' AND confidence = 'disputed' GROUP BY paper")
def review_folded(spark, sf):
    return integrity.fold_claims(_review(spark, sf).filter("kind = 'disputed_claim'"))


def _review(spark, sf):
    pairs = resolve.edit_pairs(hubs(spark, sf, ("Gene",))).select("a", "b", F.lit("pair").alias("reason"))
    return integrity.review_items(lens.nodes(spark, sf), pairs, lens.extracts(spark, sf).select("id", "body"))


# merges -------------------------------------------------------------------------------
#: The source library holds every third order, the other all but every seventh; DOIs and bodies follow from the keys.
SOURCE = "SELECT concat('papers/o', CAST(o_orderkey AS STRING)) AS id, CASE WHEN o_orderkey % 2 = 0 THEN concat('doi:10.1/', CAST(o_orderkey AS STRING)) END AS doi, concat('Order ', CAST(o_orderkey AS STRING)) AS title, CAST(CAST(o_orderdate AS DATE) AS STRING) AS published, repeat('s', CAST(o_orderkey % 9 AS INT)) AS body FROM orders WHERE o_orderkey % 3 = 0"
DEST = "SELECT concat('papers/d', CAST(o_orderkey AS STRING)) AS id, CASE WHEN o_orderkey % 4 = 0 THEN concat('https://doi.org/10.1/', CAST(o_orderkey AS STRING)) END AS doi, concat('Order ', CAST(o_orderkey AS STRING)) AS title, CAST(CAST(o_orderdate AS DATE) AS STRING) AS published, repeat('s', CAST(o_orderkey % 5 AS INT)) AS body, o_orderkey % 11 = 0 AS verified FROM orders WHERE o_orderkey % 7 <> 0"
MERGED = f"""WITH s AS ({SOURCE}), d AS ({DEST}),
  m AS (SELECT s.id AS s_id, s.body AS s_body, coalesce(x.id, y.id) AS d_id, CASE WHEN x.id IS NOT NULL THEN 'doi' WHEN y.id IS NOT NULL THEN 'title-year' END AS matched_by
    FROM s LEFT JOIN d x ON replace(s.doi, 'doi:', '') = replace(x.doi, 'https://doi.org/', '')
    LEFT JOIN d y ON s.title = y.title AND substr(s.published, 1, 4) = substr(y.published, 1, 4)),
  r AS (SELECT s_id, d_id, matched_by, CASE WHEN d_id IS NULL THEN 'added' WHEN d.verified OR s_body = d.body THEN 'skipped' WHEN matched_by = 'doi' AND length(s_body) > length(d.body) THEN 'merged' ELSE 'conflict' END AS action FROM m LEFT JOIN d ON d.id = d_id)"""


def _libraries(spark, sf):
    return lens._sql(spark, sf, SOURCE, ("orders",)), lens._sql(spark, sf, DEST, ("orders",))


@R.query(f"{MERGED} SELECT * FROM r")
def merge_papers(spark, sf):
    return merge.merge_papers(*_libraries(spark, sf))


@R.query(f"{MERGED} SELECT action, count(*) AS n FROM r GROUP BY action")
def merge_report(spark, sf):
    return merge.merge_papers(*_libraries(spark, sf)).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@R.query(f"WITH s AS ({SOURCE}), d AS ({DEST}), j AS (SELECT coalesce(s.title, d.title) AS key, s.id AS s_id, d.id AS d_id, CASE WHEN d.id IS NULL THEN 'added' WHEN s.id IS NULL THEN 'kept' WHEN length(s.body) > length(d.body) THEN 'merged' ELSE 'skipped' END AS action FROM s FULL OUTER JOIN d ON s.title = d.title) SELECT * FROM j")
def merge_extracts(spark, sf):
    return merge.merge_keyed(*_libraries(spark, sf), F.col("title"), F.length("s.body") > F.length("d.body"))


@R.query(f"{CTE} SELECT DISTINCT CASE WHEN src LIKE 'papers/o%5' THEN replace(src, 'papers/o', 'papers/n') ELSE src END AS src, CASE WHEN dst LIKE 'papers/o%5' THEN replace(dst, 'papers/o', 'papers/n') ELSE dst END AS dst FROM edges")
def remap_ids(spark, sf):
    nodes, edges = both(spark, sf)
    old = nodes.filter((F.col("type") == "Paper") & F.col("id").endswith("5")).select(F.col("id").alias("old"))
    return merge.remap(edges, old.withColumn("new", F.regexp_replace("old", "papers/o", "papers/n")))


@R.query("SELECT concat('papers/o', CAST(o_orderkey AS STRING)) AS id, 'papers/' || lower(o_orderpriority[3:]) || CASE WHEN o_orderpriority = '1-URGENT' THEN '-' || (1 + row_number() OVER (PARTITION BY o_orderpriority ORDER BY concat('papers/o', CAST(o_orderkey AS STRING)))) WHEN row_number() OVER (PARTITION BY o_orderpriority ORDER BY concat('papers/o', CAST(o_orderkey AS STRING))) > 1 THEN '-' || row_number() OVER (PARTITION BY o_orderpriority ORDER BY concat('papers/o', CAST(o_orderkey AS STRING))) ELSE '' END || '.md' AS path FROM orders")
def unique_paths(spark, sf):
    orders = lens.table(spark, sf, "orders").select(F.concat(F.lit("papers/o"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("papers/"), F.lower(F.substring("o_orderpriority", 3, 99)), F.lit(".md")).alias("path"))
    return merge.unique_paths(orders, spark.createDataFrame([("papers/urgent.md",)], "path string"))


@R.query(f"{CTE} SELECT split_part(id, '/', 1) AS folder, count(*) AS n FROM nodes WHERE type IN ('Paper', 'Claim', {HUBS}) GROUP BY 1")
def pack_paths(spark, sf):
    files = lens.nodes(spark, sf).select(F.concat("id", F.lit(".md")).alias("path"))
    return merge.pack_paths(files).groupBy(F.split("path", "/")[0].alias("folder")).agg(F.count(F.lit(1)).alias("n"))


# citable output -----------------------------------------------------------------------
BIB = "b AS (SELECT id, title, published, substr(regexp_replace(lower(title), '[^\\p{L}\\p{N}]', '', 'g'), 1, 24) || coalesce(substr(published, 1, 4), '') AS base FROM p), f AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) AS n FROM b), k AS (SELECT id, title, published, CASE WHEN n = 1 THEN base ELSE base || substr(regexp_replace(replace(id, 'papers/', ''), '[^A-Za-z0-9]+', '', 'g'), 1, 12) END AS key FROM f), u AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id) AS n FROM k), z AS (SELECT id, title, published, CASE WHEN n = 1 THEN key ELSE key || n END AS key FROM u)"
BIB_PAPERS = "p AS (SELECT concat('papers/o', CAST(o_orderkey AS STRING)) AS id, o_orderpriority AS title, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS published FROM orders)"


def _bib_papers(spark, sf):
    rows = lens.nodes(spark, sf).filter(F.col("type") == "Paper").select("id", "published").join(lens.table(spark, sf, "orders").select(F.concat(F.lit("papers/o"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("title")), "id")
    none = F.lit(None).cast("string")
    return rows.select("id", "title", "published", none.alias("doi"), none.alias("authors"), none.alias("venue"))


@R.query(f"WITH {BIB_PAPERS}, {BIB} SELECT id, key FROM z")
def cite_keys(spark, sf):
    return survey.citation_keys(_bib_papers(spark, sf))


@R.query(f"WITH {BIB_PAPERS}, {BIB}" + " SELECT id, '@article{' || key || ',' || chr(10) || '  title = {' || title || '}' || CASE WHEN published IS NULL THEN '' ELSE ',' || chr(10) || '  year = {' || substr(published, 1, 4) || '}' END || chr(10) || '}' AS entry FROM z")
def bibtex(spark, sf):
    return survey.bibtex(_bib_papers(spark, sf))
