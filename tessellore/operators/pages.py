"""Pages as a reader lists and opens them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellore import schema
from tessellore.functions import text
from tessellore.operators import search

#: Characters of a page that is opened and of a card's excerpt, and links of each.
PAGE_CHARS, CARD_CHARS, PAGE_LINKS, CARD_LINKS = 80_000, 220, 24, 12
CARDS = ("Note", "Question", "Survey")
SEALED = ("sources/", ".okf/", ".cache/")


def sealed(path: str) -> bool:
    """Whether a path is never served: source files, caches, and what leaves the library."""
    bare = path.strip().lstrip("/")
    return bare.startswith(SEALED) or ".." in bare.split("/")


def paper_filter(papers: DataFrame, low: str | None = None, high: str | None = None, query: str = "") -> DataFrame:
    """Papers within dates whose title, id or some tag contains the query, whatever its case."""
    q = F.lit(query.strip().lower())
    hit = F.contains(F.lower("title"), q) | F.contains(F.lower("id"), q) | F.exists("tags", lambda t: F.contains(F.lower(t), q))
    return papers.filter(search.within(F.col("published"), low, high) & (hit if query.strip() else F.lit(True)))


def in_range(papers: DataFrame, low: str | None = None, high: str | None = None) -> DataFrame:
    """Papers whose date is within bounds; without any bound all, undated ones too."""
    return papers.filter(search.within(F.col("published"), low, high))


def workbench_order() -> list[Column]:
    """Newest first, undated ones as the oldest, then by title."""
    return [F.coalesce("published", F.lit("")).desc(), F.coalesce("title", "id"), F.col("id")]


def cards(concepts: DataFrame) -> DataFrame:
    """``type, id, path, title, status, excerpt, links`` of notes, questions and surveys."""
    kept = concepts.filter(F.col("type").isin(*CARDS) & F.col("path").rlike("^(notes|questions|surveys)/"))
    return kept.select("type", "id", "path", F.coalesce("title", "id").alias("title"), "status", text.excerpt(F.coalesce("body", F.lit("")), CARD_CHARS).alias("excerpt"), F.slice("outgoing", 1, CARD_LINKS).alias("links"))


def open_page(concepts: DataFrame, page: str) -> DataFrame:
    """One page with its body cut to what a reader opens; raises for paths that are never served."""
    if not page.strip() or sealed(page):
        raise ValueError("this path is not served")
    bare = page.strip().lstrip("/").removesuffix(".md")
    cut = F.length("body") > PAGE_CHARS
    body = F.when(cut, F.concat(F.substring("body", 1, PAGE_CHARS), F.lit("\n\n… truncated"))).otherwise(F.col("body"))
    return concepts.filter(F.col("id") == bare).select("id", "path", "type", "title", "status", body.alias("body"), F.coalesce(cut, F.lit(False)).alias("truncated"), F.slice("outgoing", 1, PAGE_LINKS).alias("outgoing"))


def root_page(concepts: DataFrame) -> str:
    """The root page's text: a count for each kind of page and the topics with most paper links; a dozen rows are collected."""
    counts = {r.type: r.n for r in concepts.groupBy("type").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a type
    papers = F.size(F.filter("outgoing", lambda x: x.startswith("papers/")))
    top = concepts.filter("type = 'Topic'").select("path", papers.alias("n")).orderBy(F.col("n").desc(), "path").limit(12).collect()
    kinds = ("Paper", "Topic", "Method", "Entity", "Dataset", "Gene", "Pathway", "Claim", "Note", "Question", "Survey")
    plural = {"Entity": "Entities"}
    lines = ["---", "type: Index", "title: Library", "---", "", "# Library", "", "## Counts", "", *[f"- {plural.get(k, k + 's')}: {counts.get(k, 0)}" for k in kinds], "", "## Top topics", ""]
    return "\n".join([*lines, *([f"- [{r.path}](/{r.path}) ({r.n} papers)" for r in top] or ["- None yet."]), ""])
