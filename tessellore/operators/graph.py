"""Typed-graph operators over ``nodes`` (id, type, title, status, ...) and ``edges`` (src, dst)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellore import schema
from tessellore.functions import text
from tessellore.storage import cut, sized_broadcast

def edge_list(concepts: DataFrame) -> DataFrame:
    """``src, pos, dst`` of the outgoing links of concepts, dangling targets included."""
    return concepts.select(F.col("id").alias("src"), F.posexplode("outgoing").alias("pos", "dst"))


def graph_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.filter(schema.graph_node(F.col("type"), F.col("status"), F.col("confidence")))


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n_out"))


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, n_out, n_in, degree``: all links, both directions, counted in one pass over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    counted = ends.groupBy("id").agg(F.sum("o").cast("long").alias("n_out"), F.sum(1 - F.col("o")).cast("long").alias("n_in"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return nodes.select("id").join(counted, "id", "left").select("id", zero("n_out").alias("n_out"), zero("n_in").alias("n_in"), (zero("n_out") + zero("n_in")).alias("degree"))


def backlinks(nodes: DataFrame, edges: DataFrame, target: str, kind: str | None = None) -> DataFrame:
    """Who links to a concept, by title."""
    out = nodes.join(edges.filter(F.col("dst") == target).select(F.col("src").alias("id")).distinct(), "id")
    out = out if kind is None else out.filter(F.col("type") == kind)
    return out.select("id", "title", "type", "paper").orderBy("title", "id")


def neighbors(nodes: DataFrame, edges: DataFrame, target: str) -> DataFrame:
    """Both sides of a concept's links, merged: ``id, title, type, rank, direction``."""
    near = edges.filter(F.col("src") == target).select(F.col("dst").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    near = near.unionByName(edges.filter(F.col("dst") == target).select(F.col("src").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    merged = near.groupBy("id").agg(F.max("o").alias("o"), F.max("i").alias("i"))
    way = F.when((F.col("o") == 1) & (F.col("i") == 1), "both").when(F.col("o") == 1, "out").otherwise("in")
    return nodes.join(merged, "id").select("id", "title", "type", schema.type_rank(F.col("type")).alias("rank"), way.alias("direction"))


#: Pages of a frontier that are named in a filter, which skips row groups of a stored adjacency; a larger one is joined.
FRONTIER = 1_000


def adjacency(edges: DataFrame) -> DataFrame:
    """``src, dst`` of all links from both ends, in ranges of ``src``: to be kept, so that a hop reads its frontier's rows only."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return cut(both.distinct().repartitionByRange("src").sortWithinPartitions("src", "dst"))


def _near(links: DataFrame, frontier: DataFrame, adjacent: DataFrame | None) -> DataFrame:
    """``id`` of what the frontier's pages are linked with, whichever end links."""
    if adjacent is None:
        few = sized_broadcast(frontier.select("id"))
        ahead = links.join(few.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
        return ahead.unionByName(links.join(few.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))).distinct()
    named = [r.id for r in frontier.select("id").limit(FRONTIER + 1).collect()]
    if len(named) <= FRONTIER:
        return adjacent.filter(F.col("src").isin(*named)).select(F.col("dst").alias("id")).distinct()
    return adjacent.join(sized_broadcast(frontier.select(F.col("id").alias("src"))), "src", "left_semi").select(F.col("dst").alias("id")).distinct()


def neighborhood(nodes: DataFrame, edges: DataFrame, seeds: Sequence[str], depth: int, adjacent: DataFrame | None = None) -> DataFrame:
    """``id, hops`` within ``depth`` steps in either direction, through graph nodes only.

    The frontier alone is joined with the links at each of the few steps, or looked up in a
    kept ``adjacency``.
    """
    allowed = cut(graph_nodes(nodes).select("id"))
    links = cut(edges.select("src", "dst")) if adjacent is None else edges
    seen = allowed.filter(F.col("id").isin(*seeds)).withColumn("hops", F.lit(0))
    frontier = seen
    for step in range(1, max(1, min(depth, 3)) + 1):
        met = _near(links, frontier, adjacent)
        frontier = cut(allowed.join(met, "id", "left_semi").join(seen, "id", "left_anti").withColumn("hops", F.lit(step)))
        seen = seen.unionByName(frontier)
    return seen


def walk(nodes: DataFrame, edges: DataFrame, start: str, depth: int) -> DataFrame:
    """``id, hops`` along links from ``start`` through any record; graph nodes are picked at the end."""
    ids, links = cut(nodes.select("id")), cut(edges.select("src", "dst"))
    frontier = ids.filter(F.col("id") == start).withColumn("hops", F.lit(0))
    seen = frontier
    for step in range(1, depth + 1):
        met = links.join(sized_broadcast(frontier.select(F.col("id").alias("src"))), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier = cut(ids.join(met, "id", "left_semi").join(seen, "id", "left_anti").withColumn("hops", F.lit(step)))
        seen = seen.unionByName(frontier)
    return graph_nodes(nodes).select("id", "type").join(seen, "id")


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids``."""
    ends = ids.select("id")
    return edges.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")


def fair_claims(claims: DataFrame, slots: int) -> DataFrame:
    """Claims (``id, paper, degree``) picked in turn from each paper, best degree first; groups go by their best id."""
    group = F.coalesce("paper", F.concat(F.lit("__claim:"), F.col("id")))
    turn = F.row_number().over(Window.partitionBy("grp").orderBy(F.col("degree").desc(), "id"))
    return claims.withColumn("grp", group).withColumn("turn", turn).orderBy("turn", "grp", "id").limit(slots)


def select_capped(nodes: DataFrame, edges: DataFrame, cap: int) -> DataFrame:
    """``id, type, tier`` of a graph of at most ``cap`` nodes: papers, hubs at kept papers, other hubs, claims in turn.

    Each tier is a top-k of its own, so no tier is ever sorted whole for a cap.
    """
    shown = cut(graph_nodes(nodes).select("id", "type", "paper").join(degree(nodes, edges).select("id", "degree"), "id"))
    best = [F.col("degree").desc(), F.col("id")]
    papers = cut(shown.filter(F.col("type") == "Paper").orderBy(*best).limit(cap))
    left = cap - papers.count()
    out = papers.withColumn("tier", F.lit(0))
    if left > 0:
        ids = papers.select(F.col("id").alias("p"))
        touched = edges.join(ids, F.col("src") == F.col("p"), "left_semi").select(F.col("dst").alias("id")).unionByName(edges.join(ids, F.col("dst") == F.col("p"), "left_semi").select(F.col("src").alias("id"))).distinct().withColumn("t", F.lit(1))
        hubs = shown.filter(~F.col("type").isin("Paper", "Claim")).join(touched, "id", "left").withColumn("tier", F.when(F.col("t") == 1, 1).otherwise(2)).drop("t")
        hubs = cut(hubs.orderBy("tier", *best).limit(left))
        left -= hubs.count()
        out = out.unionByName(hubs.select(out.columns))
    if left > 0:
        claims = fair_claims(shown.filter(F.col("type") == "Claim"), left)
        out = out.unionByName(claims.withColumn("tier", F.lit(3)).select(out.columns))
    return out.select("id", "type", "tier")


def shared_hubs(nodes: DataFrame, links: DataFrame, papers: Sequence[str]) -> DataFrame:
    """Hubs that at least two of the papers have: ``hub, kind, n_papers, in_all``."""
    n = len(set(papers))
    met = links.filter(F.col("paper").isin(*papers)).groupBy("hub", "kind").agg(F.count_distinct("paper").alias("n_papers"))
    return met.filter("n_papers >= 2").withColumn("in_all", F.col("n_papers") == n)


#: Characters of a card's excerpt.
CARD_CHARS = 220


def paper_cards(nodes: DataFrame, edges: DataFrame, links: DataFrame, papers: Sequence[str]) -> DataFrame:
    """``place, id, title, tags, excerpt, published, hubs, n_claims`` of the papers to be compared, in their order.

    ``links`` has ``paper, hub, kind``; ``hubs`` lists (kind, id, title), the first twelve of
    each kind by title. Only the papers' own links are read.
    """
    spark = nodes.sparkSession
    chosen = spark.createDataFrame([(i, p) for i, p in enumerate(papers)], "place int, id string")
    page = nodes.filter((F.col("type") == "Paper") & F.col("id").isin(*papers))
    have = set(nodes.columns)
    body = text.excerpt(F.coalesce("body", F.lit("")), CARD_CHARS) if "body" in have else F.lit("")
    page = page.select("id", F.coalesce("title", "id").alias("title"), "tags", body.alias("excerpt"), "published")
    own = links.filter(F.col("paper").isin(*papers)).select("paper", "hub", "kind").distinct()
    titled = own.join(nodes.select(F.col("id").alias("hub"), F.coalesce("title", "id").alias("hub_title")), "hub")
    place = F.row_number().over(Window.partitionBy("paper", "kind").orderBy("hub_title", "hub"))
    first = titled.withColumn("n", place).filter(F.col("n") <= schema.CAPS["neighbors"])
    hubs = first.groupBy(F.col("paper").alias("id")).agg(F.array_sort(F.collect_list(F.struct("kind", F.col("hub_title").alias("title"), F.col("hub").alias("id")))).alias("hubs"))
    near = edges.filter(F.col("src").isin(*papers) | F.col("dst").isin(*papers))
    mine = nodes.filter(((F.col("type") == "Claim")) | F.col("id").isin(*papers))
    counts = claim_counts(mine, near)
    none = F.array().cast("array<struct<kind:string,title:string,id:string>>")
    out = chosen.join(page, "id").join(hubs, "id", "left").join(counts, "id", "left")
    return out.select("place", "id", "title", "tags", "excerpt", "published", F.coalesce("hubs", none).alias("hubs"), F.coalesce("n_claims", F.lit(0)).alias("n_claims")).orderBy("place")


def shared_tags(nodes: DataFrame, papers: Sequence[str]) -> DataFrame:
    """``tag, n_papers, in_all`` of tags, whatever their case, that at least two of the papers have."""
    tags = nodes.filter((F.col("type") == "Paper") & F.col("id").isin(*papers)).select("id", F.explode("tags").alias("tag")).select("id", F.lower("tag").alias("tag")).distinct()
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n_papers")).filter("n_papers >= 2").withColumn("in_all", F.col("n_papers") == len(set(papers)))


def claim_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct claims of each paper: links in either direction, or the claim's own paper field."""
    claims = nodes.filter(F.col("type") == "Claim").select(F.col("id").alias("claim"), "paper")
    papers = nodes.filter(F.col("type") == "Paper").select("id")
    ends = edges.join(claims.select("claim"), F.col("src") == F.col("claim"), "left_semi").select(F.col("dst").alias("id"), F.col("src").alias("claim"))
    ends = ends.unionByName(edges.join(claims.select("claim"), F.col("dst") == F.col("claim"), "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("claim")))
    ends = ends.unionByName(claims.filter(F.col("paper").isNotNull()).select(F.col("paper").alias("id"), "claim"))
    return papers.join(ends.distinct(), "id").groupBy("id").agg(F.count(F.lit(1)).alias("n_claims"))


def issues(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``category, id`` of the library check: dead links, isolated papers, papers with claims only, unreferenced hubs."""
    real = edges.filter("src <> dst")
    kinds = nodes.select("id", F.col("type").alias("other"))
    ends = real.select(F.col("src").alias("at"), F.col("dst").alias("id"), F.lit(0).alias("i")).unionByName(real.select(F.col("dst").alias("at"), F.col("src").alias("id"), F.lit(1).alias("i")))
    seen = ends.join(kinds, "id").groupBy(F.col("at").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("other") != "Claim").alias("n_other"), F.sum("i").alias("n_in"))
    full = nodes.filter(schema.live(F.col("status"))).join(seen, "id", "left").na.fill(0, ["n", "n_other", "n_in"])
    paper, hub = F.col("type") == "Paper", F.col("type").isin(*schema.HUB_TYPES)
    category = F.when(paper & (F.col("n") == 0), "isolated-paper").when(paper & (F.col("n_other") == 0), "claim-only-paper").when(hub & (F.col("n") == 0), "isolated-concept").when(hub & (F.col("n_in") == 0), "unreferenced-concept")
    dead = edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_anti").select(F.lit("dead-link").alias("category"), F.concat_ws(" -> ", "src", "dst").alias("id"))
    return full.select(category.alias("category"), "id").filter("category is not null").unionByName(dead)


#: Nodes of a filtered graph, papers that stand for it, years and papers of its default window.
FILTER_NODES, FILTER_PAPERS, WINDOW_YEARS, WINDOW_PAPERS = 180, 80, 15, 80


def newest(papers: DataFrame, most: int) -> DataFrame:
    return papers.orderBy(F.coalesce("published", F.lit("")).desc(), "id").limit(most)


def filter_graph(nodes: DataFrame, edges: DataFrame, *, types: Sequence[str], this_year: int, low: str | None = None, high: str | None = None, seeds: DataFrame | None = None, depth: int = 1, most: int = FILTER_NODES, claim_degree: int = 0) -> tuple[DataFrame, bool]:
    """``id`` of the nodes that a view shows, and whether it was cut.

    A graph that fits is shown whole. Else it grows from seeds: the query's (``seeds``: id),
    the papers within the years, or the papers of the last fifteen years, if any, when more
    than eighty are dated. What is still too large without a query is the neighbourhood of
    its newest papers, cut by id.
    """
    every = graph_nodes(nodes)
    shown = every.filter(F.col("type").isin(*types))
    if claim_degree > 0:
        weak = degree(nodes, edges).filter(F.col("degree") < claim_degree).select("id")
        shown = shown.filter("type <> 'Claim'").unionByName(shown.filter("type = 'Claim'").join(weak, "id", "left_anti"))
    shown = cut(shown.select("id", "type", "published"))
    bounded = low is not None or high is not None
    if seeds is None and not bounded and shown.limit(most + 1).count() <= most:
        return shown.select("id"), False
    if seeds is None:
        year = F.substring("published", 1, 4)
        papers = every.filter("type = 'Paper'").select("id", "published")
        if bounded:
            papers = papers.filter(F.col("published").isNotNull() & (year >= (low or "")[:4]) & ((year <= high[:4]) if high else F.lit(True)))
        elif papers.limit(WINDOW_PAPERS + 1).count() > WINDOW_PAPERS:
            recent = papers.filter(year >= str(this_year - WINDOW_YEARS))
            papers = newest(papers, WINDOW_PAPERS) if recent.isEmpty() else recent
        seeds = papers.select("id")
        ids = cut(shown.join(reach(nodes, edges, seeds, depth), "id", "left_semi"))
        if ids.limit(most + 1).count() > most:
            kept = newest(ids.filter("type = 'Paper'"), min(FILTER_PAPERS, most)).select("id")
            return shown.join(reach(nodes, edges, kept, 1), "id", "left_semi").select("id").orderBy("id").limit(most), True
        return ids.select("id"), False
    return shown.join(reach(nodes, edges, seeds, depth), "id", "left_semi").select("id"), False


def reach(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """``id`` within ``depth`` undirected steps of seeds (``id``), through graph nodes only."""
    allowed = cut(graph_nodes(nodes).select("id"))
    links = cut(edges.select("src", "dst"))
    seen = frontier = cut(allowed.join(seeds.select("id").distinct(), "id", "left_semi"))
    for _ in range(max(1, min(depth, 3))):
        met = _near(links, frontier, None)
        frontier = cut(allowed.join(met, "id", "left_semi").join(seen, "id", "left_anti"))
        seen = seen.unionByName(frontier)
    return seen


def search_scope(nodes: DataFrame, edges: DataFrame, hits: DataFrame, links: int = schema.CAPS["links"]) -> DataFrame:
    """``id`` of the graph nodes that hits (``id``) are or link to first (``edges``: src, pos, dst)."""
    known = graph_nodes(nodes).select("id")
    near = edges.filter(F.col("pos") < links).join(F.broadcast(hits.select(F.col("id").alias("src"))), "src").select(F.col("dst").alias("id"))
    return known.join(hits.select("id").unionByName(near).distinct(), "id", "left_semi")


def tool_graph(nodes: DataFrame, edges: DataFrame, allowed: DataFrame | None, claims: bool, cap: int = schema.CAPS["graph_nodes"], edge_cap: int = schema.CAPS["graph_edges"]) -> tuple[DataFrame, DataFrame, bool]:
    """Nodes by type and id, then claims in turn from their papers; the links among them; whether the cap cut any."""
    shown = graph_nodes(nodes)
    shown = shown if allowed is None else shown.join(allowed.select("id"), "id", "left_semi")
    overview = shown.filter("type <> 'Claim'").select("id", "type", "title", "published", schema.type_rank(F.col("type")).alias("rank")).orderBy("rank", "id").limit(cap + 1)
    overview = cut(overview)
    n = overview.count()
    picked = overview.orderBy("rank", "id").limit(cap).withColumn("place", F.lit(0))
    truncated = n > cap
    if claims:
        some = cut(shown.filter("type = 'Claim'").select("id", "type", "title", "published", "paper"))
        left = max(0, cap - n)
        truncated = truncated or n + some.limit(cap + 1).count() > cap
        if left:
            fair = cut(fair_claims(some.join(degree(some, edges).select("id", "degree"), "id"), left))
            picked = picked.unionByName(fair.select("id", "type", "title", "published", F.lit(len(schema.GRAPH_TYPES)).alias("rank"), F.col("turn").alias("place")))
    picked = cut(picked)
    links = induced(edges.select("src", "dst").filter("src <> dst"), picked).distinct().orderBy("src", "dst").limit(edge_cap)
    return picked.orderBy("rank", "place", "id").drop("rank", "place"), links, truncated


def papers_from_hits(nodes: DataFrame, edges: DataFrame, hits: DataFrame) -> DataFrame:
    """``id, rank`` of the papers that hits (``id, rank``) are, belong to, or link to, in the order of hits."""
    records = nodes.select("id", "paper").join(F.broadcast(hits), "id")
    own = records.select("id", "rank", F.lit(0).alias("step")).unionByName(records.filter("paper is not null").select(F.col("paper").alias("id"), "rank", F.lit(1).alias("step")))
    near = edges.join(F.broadcast(hits.withColumnRenamed("id", "src")), "src").select(F.col("dst").alias("id"), "rank", F.lit(2).alias("step"))
    papers = nodes.filter("type = 'Paper'").select("id")
    return papers.join(own.unionByName(near).groupBy("id").agg(F.min(F.struct("rank", "step")).alias("o")), "id").select("id", F.col("o.rank").alias("rank"), F.col("o.step").alias("step"))


def client_filter(nodes: DataFrame, edges: DataFrame, types: Sequence[str], *, query: str = "", low: str | None = None, high: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a shown graph: by type, then around what a query names or the papers within years.

    One step in any direction leads from a seed; nodes of other types may lie between no two.
    """
    typed = nodes.filter(F.col("type").isin(*types))
    year = F.substring("published", 1, 4)
    if query.strip():
        q = F.lit(query.strip().lower())
        seeds = typed.filter(F.contains(F.lower("title"), q) | F.contains(F.lower("id"), q))
    elif low or high:
        seeds = typed.filter((F.col("type") == "Paper") & F.col("published").isNotNull() & (year >= (low or "")[:4]) & ((year <= high[:4]) if high else F.lit(True)))
    else:
        return typed, induced(edges, typed)
    ids = seeds.select("id")
    near = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).unionByName(edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")))
    kept = typed.join(ids.unionByName(near).distinct(), "id", "left_semi")
    return kept, induced(edges, kept)


def merge_graphs(base: DataFrame, extra: DataFrame) -> DataFrame:
    """``id, type, title, published`` of two node lists: a known type and its title win over an unknown one, the later date over none."""
    rows = base.select("id", "type", "title", "published", F.lit(0).alias("o")).unionByName(extra.select("id", "type", "title", "published", F.lit(1).alias("o")))
    known, own = F.col("type") != "unknown", F.col("o") == 0
    title_order = F.when(own & known, 0).when(~own & (F.col("title") != F.col("id")), 1).when(own, 2).otherwise(3)
    met = rows.groupBy("id").agg(
        F.coalesce(F.min_by("type", F.when(known, F.col("o"))), F.lit("unknown")).alias("type"),
        F.min_by("title", title_order).alias("title"),
        F.max_by("published", F.when(F.col("published").isNotNull(), F.col("o"))).alias("published"),
    )
    return met.select("id", "type", "title", "published")


def merge_edges(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Edges of two graphs, each once, without loops."""
    return base.select("src", "dst").unionByName(extra.select("src", "dst")).filter("src <> dst").distinct()


def pipeline_audit(state: DataFrame, files: DataFrame) -> DataFrame:
    """``path, severity, problem`` of source records (``path, status, paper, error``) against the files (``path``).

    Done records whose paper page is gone, records that aren't done, and sources that no
    record names.
    """
    papers = files.select(F.col("path").alias("paper"), F.lit(True).alias("there"))
    met = state.join(papers, "paper", "left")
    done = F.col("status") == "done"
    lost = done & F.col("paper").isNotNull() & F.col("there").isNull()
    failed = F.col("status").isin("failed", "compile_failed")
    problem = F.when(lost, F.concat(F.lit("paper is missing: "), "paper")).when(~done, F.concat_ws(" ", F.concat(F.lit("status="), "status"), F.concat(F.lit("("), "error", F.lit(")"))))
    known = met.select("path", F.when(lost | (~done & failed), "error").when(~done, "warning").alias("severity"), problem.alias("problem")).filter("problem is not null")
    sources = files.filter(F.col("path").startswith("sources/") & F.lower("path").endswith(".pdf")).join(state.select("path"), "path", "left_anti")
    return known.unionByName(sources.select("path", F.lit("warning").alias("severity"), F.lit("never ingested").alias("problem")))


def check_summary(nodes: DataFrame, edges: DataFrame, state: DataFrame, files: DataFrame) -> DataFrame:
    """One row: papers, concepts, dead links, isolated and claim-only papers, isolated and unreferenced concepts, pipeline records, those incomplete and unrecorded."""
    by = F.col("category")
    found = issues(nodes, edges).agg(*[F.count_if(by == c).alias(c.replace("-", "_")) for c in ("dead-link", "isolated-paper", "claim-only-paper", "isolated-concept", "unreferenced-concept")])
    counts = nodes.agg(F.count_if(F.col("type") == "Paper").alias("papers"), F.count(F.lit(1)).alias("concepts"))
    new = F.col("problem") == "never ingested"
    audit = pipeline_audit(state, files).agg(F.count_if(~new).alias("incomplete"), F.count_if(new).alias("unrecorded"))
    total = state.agg(F.count(F.lit(1)).alias("records"))
    return counts.join(found).join(audit).join(total)  # four rows of one row each
