"""Topic by year coverage, gaps, hotspots and the census."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellore import schema
from tessellore.functions import text
from tessellore.storage import cut, sized_broadcast


def hub_links(nodes: DataFrame, edges: DataFrame, hubs: tuple[str, ...] = schema.HUB_TYPES, papers: DataFrame | None = None) -> DataFrame:
    """``paper, hub, kind``: papers and hubs linked in either direction, each pair once.

    ``papers`` restricts them and gives its further columns. Edges that say the types of
    their ends are filtered by them before any join; hubs are few as a rule and then sent
    to all; the last distinct reuses the partitioning by paper.
    """
    papers = nodes.filter(F.col("type") == "Paper").select(F.col("id").alias("paper")) if papers is None else papers
    hub = nodes.filter(F.col("type").isin(*hubs)).select(F.col("id").alias("hub"), F.col("type").alias("kind"))
    out, back = edges, edges
    if {"src_type", "dst_type"} <= set(edges.columns):
        out = edges.filter((F.col("src_type") == "Paper") & F.col("dst_type").isin(*hubs))
        back = edges.filter((F.col("dst_type") == "Paper") & F.col("src_type").isin(*hubs))
    both = out.select(F.col("src").alias("paper"), F.col("dst").alias("hub")).unionByName(back.select(F.col("dst").alias("paper"), F.col("src").alias("hub")))
    return both.join(sized_broadcast(hub), "hub").join(papers, "paper").select("paper", "hub", "kind", *[c for c in papers.columns if c != "paper"]).distinct()


def live_papers(nodes: DataFrame) -> DataFrame:
    kept = nodes.filter((F.col("type") == "Paper") & schema.live(F.col("status")))
    return kept.select(F.col("id").alias("paper"), "title", "published", text.published_year(F.col("published")).alias("year"))


def topic_years(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``topic_id, year, n_papers, papers`` of live, dated papers."""
    dated = live_papers(nodes).filter("year is not null").select("paper", "year")
    links = hub_links(nodes, edges, ("Topic",), dated).withColumnRenamed("hub", "topic_id")
    return links.groupBy("topic_id", "year").agg(F.count(F.lit(1)).alias("n_papers"), F.array_sort(F.collect_list("paper")).alias("papers"))


def topic_year_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    dated = live_papers(nodes).filter("year is not null").select("paper", "year")
    links = hub_links(nodes, edges, ("Topic",), dated).withColumnRenamed("hub", "topic_id")
    return links.groupBy("topic_id", "year").agg(F.count(F.lit(1)).alias("n_papers"))


def topic_hubs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``topic_id, kind, hub, n_papers``: live papers, undated ones too, that have both."""
    links = cut(hub_links(nodes, edges, ("Topic", *CROSSED), live_papers(nodes).select("paper")))  # read by both sides
    topics = links.filter("kind = 'Topic'").select("paper", F.col("hub").alias("topic_id"))
    other = links.filter(F.col("kind").isin(*CROSSED))
    return topics.join(other, "paper").groupBy("topic_id", "kind", "hub").agg(F.count(F.lit(1)).alias("n_papers"))


def year_axis(nodes: DataFrame) -> DataFrame:
    """One row for each year from the first to the last of the live papers, at most a hundred."""
    span = live_papers(nodes).agg(F.min("year").cast("int").alias("a"), F.max("year").cast("int").alias("b"))
    return span.filter("a is not null").select(F.explode(F.transform(text.years_between(F.col("a"), F.col("b")), lambda y: y.cast("string"))).alias("year"))


CROSSED = ("Method", "Dataset", "Gene", "Pathway")


def dated_links(nodes: DataFrame, edges: DataFrame, hubs: tuple[str, ...]) -> DataFrame:
    """``paper, hub, kind, year`` of live papers."""
    return hub_links(nodes, edges, hubs, live_papers(nodes).select("paper", "year"))


def _missing_years(nodes: DataFrame, links: DataFrame) -> DataFrame:
    cells = links.filter("kind = 'Topic' and year is not null").select(F.col("hub").alias("topic_id"), "year").distinct()
    years = year_axis(nodes).agg(F.collect_set("year").alias("years"))  # at most a hundred values, one row
    full = cells.select("topic_id").distinct().join(F.broadcast(years)).select("topic_id", F.explode("years").alias("year"))
    return full.join(cells, ["topic_id", "year"], "left_anti")


def _missing_hubs(links: DataFrame, topic: str) -> DataFrame:
    papers = links.filter(F.col("hub") == topic).select("paper")
    other = links.filter(F.col("kind").isin(*CROSSED))
    met = other.join(papers, "paper", "left_semi").select("hub").distinct()
    return other.select("kind", "hub").distinct().join(met, "hub", "left_anti").select(F.lit(topic).alias("topic_id"), "kind", "hub")


def missing_years(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``topic_id, year`` without a paper, for topics that have any."""
    return _missing_years(nodes, dated_links(nodes, edges, ("Topic",)))


def missing_hubs(nodes: DataFrame, edges: DataFrame, topic: str) -> DataFrame:
    """``topic_id, kind, hub``: hubs that some live paper uses but none of the topic's."""
    return _missing_hubs(cut(dated_links(nodes, edges, ("Topic", *CROSSED))), topic)


def undated(nodes: DataFrame) -> DataFrame:
    return live_papers(nodes).filter("year is null").select("paper")


def gaps(nodes: DataFrame, edges: DataFrame, topic: str) -> DataFrame:
    """``gap_id, kind`` of all gaps of one topic and the undated papers; the links are made once."""
    links = cut(dated_links(nodes, edges, ("Topic", *CROSSED)))
    years = _missing_years(nodes, links.filter(F.col("hub") == topic)).select(F.concat_ws(":", F.lit("year"), "topic_id", "year").alias("gap_id"), F.lit("missing-year").alias("kind"))
    hubs = _missing_hubs(links, topic).select(F.concat_ws(":", F.lower("kind"), "topic_id", "hub").alias("gap_id"), F.concat(F.lit("missing-"), F.lower("kind")).alias("kind"))
    bare = undated(nodes).select(F.concat_ws(":", F.lit("undated"), "paper").alias("gap_id"), F.lit("undated").alias("kind"))
    return years.unionByName(hubs).unionByName(bare)


def hotspots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``year, topic_id, n_papers, rank``: dated papers of any status, most first."""
    dated = nodes.filter((F.col("type") == "Paper") & F.col("published").isNotNull()).select(F.col("id").alias("paper"), text.published_year(F.col("published")).alias("year"))
    counted = hub_links(nodes, edges, ("Topic",), dated).groupBy("year", F.col("hub").alias("topic_id")).agg(F.count(F.lit(1)).alias("n_papers"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("year").orderBy(F.col("n_papers").desc(), "topic_id")))


def census(nodes: DataFrame) -> DataFrame:
    return nodes.filter(schema.live(F.col("status"))).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def papers_by_year(nodes: DataFrame) -> DataFrame:
    return live_papers(nodes).filter("year is not null").groupBy("year").agg(F.count(F.lit(1)).alias("n"))


def tag_census(nodes: DataFrame, most: int = schema.CAPS["stats"]) -> DataFrame:
    tagged = nodes.filter((F.col("type") == "Paper") & schema.live(F.col("status"))).select("id", F.explode("tags").alias("tag")).select("id", F.lower("tag").alias("tag")).distinct()
    return tagged.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "tag").limit(most)


def hub_ranking(nodes: DataFrame, edges: DataFrame, most: int = schema.CAPS["stats"]) -> DataFrame:
    """The hubs of each kind with most papers, whatever their status."""
    counted = hub_links(nodes, edges).groupBy("kind", "hub").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.col("n").desc(), "hub"))
    return counted.withColumn("rank", place).filter(F.col("rank") <= most)


def heatmap(nodes: DataFrame, edges: DataFrame, years: list[str]) -> DataFrame:
    """The matrix as a pivot with a column for each given year."""
    return topic_year_counts(nodes, edges).groupBy("topic_id").pivot("year", years).agg(F.first("n_papers")).na.fill(0)


def answered_questions(nodes: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """``topic_id, n_reviewed, answered``: reviewed claims on the papers of a topic."""
    links = hub_links(nodes, edges, ("Topic",)).select("paper", F.col("hub").alias("topic_id"))
    claims = nodes.filter((F.col("type") == "Claim") & (F.col("confidence") == "reviewed")).groupBy("paper").agg(F.count(F.lit(1)).alias("c"))
    counted = links.join(claims, "paper", "left").groupBy("topic_id").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_reviewed"))
    return counted.withColumn("answered", F.col("n_reviewed") >= least)


def survey_buckets(nodes: DataFrame, edges: DataFrame, topic: str, featured: int = schema.CAPS["featured"]) -> DataFrame:
    """``year, paper, place`` of a topic's newest papers in each year."""
    links = hub_links(nodes, edges, ("Topic",)).filter(F.col("hub") == topic).select("paper")
    dated = live_papers(nodes).filter("year is not null").join(links, "paper", "left_semi")
    place = F.row_number().over(Window.partitionBy("year").orderBy(F.col("published").desc(), "paper"))
    return dated.withColumn("place", place).filter(F.col("place") <= featured).select("year", "paper", "published", "place")


def draft_questions(gap_list: DataFrame, existing: DataFrame, most: int = schema.CAPS["questions"]) -> DataFrame:
    """``id, kind, gap_id`` of questions for gaps that have none yet, the first by gap."""
    made = gap_list.select(F.concat(F.lit("questions/"), text.slug(F.regexp_replace("gap_id", "[:/]", " "))).alias("id"), "kind", "gap_id")
    return made.join(existing.select("id"), "id", "left_anti").orderBy("gap_id").limit(most)


def appendix(topic: str, papers: DataFrame, undated_papers: DataFrame, claims: DataFrame, missing: list[str], gap_titles: list[str]) -> str:
    """The coverage appendix of a survey: counts, years without papers, the papers in scope, gaps; a survey's scope bounds what is collected."""
    dated, bare = (f.select("id", "title", "path").orderBy("id").collect() for f in (papers, undated_papers))
    n = claims.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") == "reviewed").alias("reviewed")).first()
    item = lambda r: f"- [{r.title or r.id}](/{r.path})"
    lines = ["## Coverage appendix", "", f"What this library holds on {topic}, not what a field does.", "", f"- Papers in scope (dated): {len(dated)}", f"- Undated papers: {len(bare)}", f"- Claims in scope: {n.n} ({n.reviewed} reviewed)"]
    lines += [f"- Missing years: {', '.join(sorted(missing)) or 'none in this window'}", "", "### In-scope papers", "", *(map(item, dated) if dated else ["- None"]), "", "### Undated", "", *(map(item, bare) if bare else ["- None"])]
    return "\n".join([*lines, *(["", "### Gaps", "", *[f"- {g}" for g in gap_titles[:40]]] if gap_titles else [])])


def survey_scope(nodes: DataFrame, edges: DataFrame, *, topics: list[str] = (), methods: list[str] = (), low: str | None = None, high: str | None = None) -> DataFrame:
    """``paper, published, year, dated``: live papers linked with any of the topics, either way, and to any of the methods, within years; undated ones are kept apart."""
    kept = live_papers(nodes)
    if topics:
        kept = kept.join(hub_links(nodes, edges, ("Topic",)).filter(F.col("hub").isin(*topics)).select("paper").distinct(), "paper", "left_semi")
    if methods:
        kept = kept.join(edges.filter(F.col("dst").isin(*methods)).select(F.col("src").alias("paper")).distinct(), "paper", "left_semi")
    inside = F.lit(True) if low is None else F.col("year") >= low[:4]
    inside = inside if high is None else inside & (F.col("year") <= high[:4])
    return kept.filter(F.col("year").isNull() | inside).select("paper", "published", "year", F.col("year").isNotNull().alias("dated"))


def survey_claims(nodes: DataFrame, papers: DataFrame, most: int = schema.CAPS["survey_claims"]) -> DataFrame:
    """``id, paper, part, place``: the first reviewed claims of papers in scope, and the first of all others."""
    claims = nodes.filter("type = 'Claim'").join(papers.select("paper"), "paper", "left_semi").select("id", "paper", (F.col("confidence") == "reviewed").alias("reviewed"))
    rows = [claims.filter(c).orderBy("id").limit(most).withColumn("part", F.lit(p)) for p, c in (("reviewed", F.col("reviewed")), ("extracted", ~F.coalesce("reviewed", F.lit(False))))]
    both = rows[0].unionByName(rows[1])
    return both.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("id"))).select("id", "paper", "part", "place")


def allowed_ids(papers: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id`` of everything that a survey over papers in scope (``paper, dated``) may cite: all of them and the claims of dated ones."""
    claims = nodes.filter("type = 'Claim'").join(papers.filter("dated").select("paper"), "paper", "left_semi").select("id")
    return papers.select(F.col("paper").alias("id")).unionByName(claims)


def gap_report(cells: DataFrame, years: list[str]) -> DataFrame:
    """``topic_id, line`` of the heatmap (``topic_id`` and a column a year): counts in columns of four."""
    return cells.select("topic_id", F.concat(F.rpad("topic_id", 32, " "), *[F.lpad(F.col(f"`{y}`").cast("string"), 4, " ") for y in years]).alias("line"))
