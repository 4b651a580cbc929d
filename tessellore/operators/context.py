"""What a model is given to answer from: the best passages, papers and claims of a question, as one bounded text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellore import schema
from tessellore.functions import text, udf
from tessellore.operators import search

#: How much of each kind a context holds, in characters or rows.
CONTEXT_CHARS, DIGEST_CHARS, LINK_CHARS, QUOTE_CHARS = 24_000, 800, 240, 400
EXTRACTS, PAPERS, CLAIMS, GAPS, TITLES, LINKS = 6, 3, 8, 12, 40, 12
MODES = {
    "ask": "",
    "compare": "Mode: compare. Set claims of the given papers against each other and say what is quoted and what is inferred.",
    "gap": "Mode: gap. Coverage describes this library only, never a whole field.",
    "survey-outline": "Mode: survey-outline. Draft headings and points; every causal sentence names a claim id; no paper is invented.",
    "cite": "Mode: cite. Every mention names a paper or claim id of this set; say so where the set lacks the fact.",
}
HEADER = (
    "You answer questions about a local library of papers.",
    "Use only the passages, claims and digests below and cite page ids such as `papers/...` and `claims/...`.",
    "Quote only what is quoted below. Never invent a paper, a claim or a citation.",
    "Where a passage has no paper page, say that the page is missing.",
)


def union_hits(first: DataFrame, second: DataFrame) -> DataFrame:
    """``id, rank`` of two ranked lists (``id, rank``): the first list, then what only the second has."""
    rows = first.select("id", F.lit(0).alias("list"), "rank").unionByName(second.select("id", F.lit(1).alias("list"), "rank"))
    best = rows.groupBy("id").agg(F.min(F.struct("list", "rank")).alias("b"))
    return best.withColumn("rank", F.row_number().over(Window.orderBy("b", "id")) - 1).select("id", "rank")  # two cut lists


def latin_query(question: str) -> str:
    return " ".join(re.findall(r"[A-Za-z][A-Za-z0-9+-]+", question))


def select_passages(extracts: DataFrame, question: str, most: int = schema.CAPS["passages"]) -> DataFrame:
    """``id, paper, ordinal, passage, score`` of the best passages over some extracts (``id, paper, body``), each text once.

    Each extract gives its ``most`` best passages, or its first ones if none has a term of
    the question; of those the best ``most`` stay. Extracts are few: a cut list of hits.
    """
    terms = text.passage_terms(F.lit(question))
    cut = extracts.select("id", "paper", F.posexplode(udf.passages_column(F.col("body"))).alias("ordinal", "passage"))
    scored = cut.withColumn("score", text.score_passage(F.col("passage"), terms))
    by_id = Window.partitionBy("id")
    placed = scored.withColumn("top", F.max("score").over(by_id)).withColumn("place", F.row_number().over(by_id.orderBy(F.col("score").desc(), "ordinal")))
    kept = placed.filter((F.col("place") <= most) & ((F.col("score") > 0) | (F.col("top") == 0)))
    once = kept.groupBy("passage").agg(F.min(F.struct((-F.col("score")).alias("s"), "id", "ordinal", "paper")).alias("b"))
    return once.select("b.id", "b.paper", "b.ordinal", "passage", (-F.col("b.s")).alias("score")).orderBy(F.col("score").desc(), "id", "ordinal").limit(most)


def bound_extracts(hits: DataFrame, concepts: DataFrame, bodies: DataFrame) -> DataFrame:
    """``id, paper, body`` of the extracts that hits (``id, rank``) mean: the first extracts hit, and each paper's first extract."""
    met = concepts.join(F.broadcast(hits), "id")
    direct = met.filter("type = 'TextExtract'").orderBy("rank", "id").limit(EXTRACTS).select("id", "paper")
    papers = met.filter("type = 'Paper'").select(F.col("id").alias("paper"))
    of_papers = concepts.filter("type = 'TextExtract'").join(F.broadcast(papers), "paper").groupBy("paper").agg(F.min("id").alias("id")).select("id", "paper")
    ids = direct.unionByName(of_papers).distinct()
    return bodies.select("id", "body").join(F.broadcast(ids), "id").select("id", "paper", "body")


def claims_for(hits: DataFrame, concepts: DataFrame, papers: DataFrame, most: int = CLAIMS) -> DataFrame:
    """``id, title, paper, stance, confidence, body`` of the claims hit, then of the stable claims of ``papers`` (``id``); disputed ones stay out."""
    claims = concepts.filter((F.col("type") == "Claim") & (F.coalesce("confidence", F.lit("")) != "disputed"))
    hit = claims.join(F.broadcast(hits), "id").withColumn("list", F.lit(0))
    own = claims.filter("status = 'stable'").join(F.broadcast(papers.select(F.col("id").alias("paper"))), "paper", "left_semi").withColumn("rank", F.lit(0)).withColumn("list", F.lit(1))
    columns = ["id", "title", "paper", "stance", "confidence", "body"]
    rows = hit.select(*columns, "list", "rank").unionByName(own.select(*columns, "list", "rank"))
    first = rows.groupBy("id").agg(F.min_by(F.struct(*columns[1:]), F.struct("list", "rank")).alias("c"), F.min(F.struct("list", "rank")).alias("o"))
    return first.orderBy("o", "id").limit(most).select("id", "c.*")


def retrieval(library, question: str) -> dict[str, DataFrame]:
    """Passages, papers and claims of a question, each cut to its cap."""
    def found(kind: str) -> DataFrame:
        lists = [search.ranked(library.ranked_of_type(q, kind)) for q in dict.fromkeys(filter(None, (question, latin_query(question))))]
        return lists[0] if len(lists) == 1 else union_hits(*lists)

    paper_hits = found("Paper")
    passages = select_passages(bound_extracts(found("TextExtract").unionByName(paper_hits), library.concepts, library.texts), question)
    of_passages = passages.filter("paper is not null").groupBy(F.col("paper").alias("id")).agg(F.min(F.struct(F.lit(0).alias("list"), (-F.col("score")).alias("rank"))).alias("o"))
    first = paper_hits.orderBy("rank").limit(PAPERS).select("id", F.struct(F.lit(1).alias("list"), F.col("rank").cast("int").alias("rank")).alias("o"))
    order = of_passages.unionByName(first).groupBy("id").agg(F.min("o").alias("o"))
    papers = library.papers.join(F.broadcast(order), "id").orderBy("o", "id").select("id", "title", "published", "doi", "tags", "outgoing", "body")
    return {"passages": passages, "papers": papers, "claims": claims_for(found("Claim"), library.concepts, papers)}


def cite_ids(library, question: str) -> dict[str, list[str]]:
    """The ids that an answer to a question may cite; the caps bound what is collected."""
    got = retrieval(library, question)
    return {k: [r.id for r in got[k].select("id").collect()] for k in ("papers", "claims")}


def _flat(value: str | None, most: int) -> str:
    return " ".join((value or "").split())[:most]


def assemble(question: str, got: dict[str, DataFrame], mode: str = "ask", gaps: list[str] | None = None, titles: list[str] = ()) -> str:
    """The context's text. Everything collected here has been cut to its cap."""
    lines = [*HEADER, *filter(None, [MODES[mode]])]
    passages, papers, claims = (got[k].collect() for k in ("passages", "papers", "claims"))
    if passages:
        lines += ["", "## Retrieved passages"]
        for n, p in enumerate(passages, 1):
            lines += [f"### Passage {n}", f"paper: {p.paper or '(the paper page is missing)'}", f"extract: {p.id}", p.passage]
        lines += ["", "## Paper digests"]
        for p in papers:
            extra = [f"published={p.published}" if p.published else "", f"doi={p.doi}" if p.doi else "", f"tags={','.join(p.tags)}" if p.tags else "", f"links={','.join(p.outgoing[:LINKS])}" if p.outgoing else ""]
            lines.append(" ".join(filter(None, [f"- {p.id} {p.title or p.id}", *extra])))
            lines += [f"  {body}"] if (body := _flat(p.body, DIGEST_CHARS)) else []
    else:
        lines += ["No extract matches this question; only titles are known.", "", "## Paper titles", *(titles[:TITLES] or ["(no papers yet)"])]
    lines += ["", "## Claims"]
    for c in claims:
        extra = [f"{k}={v}" for k, v in (("paper", c.paper), ("stance", c.stance), ("confidence", c.confidence)) if v]
        lines.append(" ".join([f"- {c.id} {c.title or c.id}", *extra]))
        lines += [f"  quote: {quote}"] if (quote := _flat(re.sub(r"(?m)^>\s*", "", c.body or "", count=1), QUOTE_CHARS)) else []
    lines += [] if claims else ["(no stable claims)"]
    if gaps is not None:
        lines += ["", "## Coverage gaps (this library only)", *([f"- {g}" for g in gaps[:GAPS]] or ["(none in this window)"])]
    out = "\n".join(lines)
    return out if len(out) <= CONTEXT_CHARS else f"{out[:CONTEXT_CHARS]}\n... [cut at {CONTEXT_CHARS} characters]"
