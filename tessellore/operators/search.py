"""Full-text and vector retrieval, fusion, filters and promotion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellore import schema
from tessellore.functions import text
from tessellore.storage import cut, sized_broadcast

RRF_K = 60


def _postings(docs: DataFrame, keep=None) -> DataFrame:
    """A row for each token of a document that ``keep`` (of a token) lets through; the title's tokens first.

    One pass: title tokens and the others are two disjoint arrays, so no token is looked up
    in the title and no row is made that a search would drop.
    """
    head, full = text.fts_tokens(F.coalesce("title", F.lit(""))), text.fts_tokens(F.concat_ws("\n", "title", "body"))
    if keep is not None:
        head, full = F.filter(head, keep), F.filter(full, keep)
    flag = lambda tokens, there: F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lit(there).alias("in_title")))
    both = docs.select("id", head.alias("head"), full.alias("full"))
    spread = both.select("id", F.explode(F.concat(flag(F.col("head"), True), flag(F.array_except("full", "head"), False))).alias("p"))
    return spread.select("p.token", "id", "p.in_title")


def build_postings(docs: DataFrame) -> DataFrame:
    """``token, id, in_title`` of ``id, title, body``; one row for each token of a document."""
    return _postings(docs)


def postings_for(docs: DataFrame, query: str) -> DataFrame:
    """The postings of documents that a query meets, without an index: tokens are dropped before they are rows."""
    return _postings(docs, lambda t: _begins(t, query))


def _begins(token: Column, query: str) -> Column:
    keep = F.lit(False)
    for t in sorted(set(_query_tokens(query))):
        keep = keep | token.startswith(t)
    return keep


def token_stats(postings: DataFrame, n_docs: int) -> DataFrame:
    """``token, df, idf`` with idf = ln((N + 1) / (df + 1)) + 1."""
    return postings.groupBy("token").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log((F.lit(n_docs) + 1) / (F.col("df") + 1)) + 1)


def matched_postings(postings: DataFrame, query: str) -> DataFrame:
    """Postings whose token is, or begins with, a token of the query; each once.

    The condition is an OR of literals, so it prunes the scan and needs no join.
    """
    return postings.filter(_begins(F.col("token"), query))


def _query_tokens(query: str) -> list[str]:
    import re

    han = re.findall(r"[㐀-鿿豈-﫿]", query)
    return re.findall(r"[a-z0-9][a-z0-9+-]+", query.lower()) + [c for c in han if c not in text.HAN_STOPS] + [a + b for a, b in zip(han, han[1:], strict=False)]


def fts_scores(postings: DataFrame, n_docs: int, query: str) -> DataFrame:
    """``id, score``: the sum over matched tokens of length weight, idf and title boost."""
    met = cut(matched_postings(postings, query))  # slim, and read twice
    stats = sized_broadcast(token_stats(met, n_docs))  # every posting of a matched token is matched
    weight = F.when(F.length("token") >= 2, 2).otherwise(1) * F.coalesce("idf", F.lit(1.0)) * F.when(F.col("in_title"), 3).otherwise(1)
    return met.join(stats, "token").groupBy("id").agg(F.sum(weight).alias("score"))


def fts_search(postings: DataFrame, n_docs: int, query: str, most: int = schema.CAPS["index_hits"]) -> DataFrame:
    """The best hits; ids break ties."""
    return fts_scores(postings, n_docs, query).orderBy(F.round("score", 6).desc(), "id").limit(most)


def vector_search(chunks: DataFrame, query: Sequence[float], most: int = schema.CAPS["index_hits"]) -> DataFrame:
    """``id, score``: each source by the largest similarity of its chunks (``source_id, embedding``)."""
    asked = F.array(*[F.lit(float(x)) for x in query])
    scored = chunks.select(F.col("source_id").alias("id"), text.cosine(F.col("embedding").cast("array<double>"), asked).alias("s"))
    return scored.groupBy("id").agg(F.max("s").alias("score")).orderBy(F.round("score", 6).desc(), "id").limit(most)


def ranked(hits: DataFrame) -> DataFrame:
    """Hits (few rows, already cut) with their rank from 0."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.round("score", 6).desc(), "id")) - 1).select("id", "rank")


def fuse(*lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ``id, rank`` lists."""
    rows = lists[0]
    for other in lists[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank") + 1)).alias("score")).orderBy(F.round("score", 9).desc(), "id")


def inherit(records: DataFrame, papers: DataFrame) -> DataFrame:
    """Published date and tags of the owning paper where a record has none of its own."""
    own = papers.select(F.col("id").alias("paper"), F.col("published").alias("p_published"), F.col("tags").alias("p_tags"), F.col("title").alias("p_title"))
    joined = records.join(own, "paper", "left")
    tags = F.when(F.size("tags") > 0, F.col("tags")).otherwise(F.coalesce("p_tags", F.array().cast("array<string>")))
    return joined.withColumn("published", F.coalesce("published", "p_published")).withColumn("tags", tags).drop("p_published", "p_tags")


def within(published: Column, low: str | None, high: str | None, *, inclusive_year: bool = False) -> Column:
    """Dates compare as strings: the upper bound "2024" excludes "2024-05-01" unless ``inclusive_year``."""
    keep = F.lit(True) if low is None and high is None else published.isNotNull()
    if low is not None:
        keep = keep & (published >= low)
    if high is not None:
        keep = keep & ((F.substring(published, 1, len(high)) if inclusive_year else published) <= high)
    return keep


def retrieve(records: DataFrame, *, kind: str | None = None, low: str | None = None, high: str | None = None, tags: Sequence[str] = (), stable: bool = True) -> DataFrame:
    """The conjunctive filter that follows the ranked cut."""
    keep = within(F.col("published"), low, high)
    keep = keep & schema.stable_only(F.col("status")) if stable else keep
    keep = keep & (F.col("type") == kind) if kind else keep
    for t in tags:
        keep = keep & F.array_contains("tags", t)
    return records.filter(keep)


def promote(hits: DataFrame, records: DataFrame, papers: DataFrame, most: int = schema.CAPS["search_hits"]) -> DataFrame:
    """Ranked hits (``id, rank``) as pages: an extract stands for its paper, the first hit of a page counts."""
    met = hits.join(records.select("id", "type", "paper"), "id")
    target = met.withColumn("target", F.when(F.col("type") == "TextExtract", F.col("paper")).otherwise(F.col("id")))
    found = target.join(papers.select(F.col("id").alias("target"), "title", "status", "published"), "target")
    first = F.row_number().over(Window.partitionBy("target").orderBy("rank"))
    return found.withColumn("n", first).filter("n = 1").orderBy("rank").limit(most).select(F.col("target").alias("id"), "title", "status", "published", "rank")


def evidence(claims: DataFrame, scored: DataFrame, most: int = schema.CAPS["evidence"]) -> DataFrame:
    """The best claims of a query with their papers."""
    return claims.join(scored, "id").orderBy(F.round("score", 6).desc(), "id").limit(most)


def best_passages(docs: DataFrame, query: str, most: int = schema.CAPS["passages"]) -> DataFrame:
    """``id, ordinal, score, place``: each document's passages with most query terms; its first ones if none has any.

    Passages are paragraphs as ``udf.passages_column`` joins and cuts them; an empty document has none.
    """
    from tessellore.functions import udf

    terms = text.passage_terms(F.lit(query))
    cut = docs.select("id", F.posexplode(udf.passages_column(F.col("body"))).alias("ordinal", "passage"))
    scored = cut.select("id", "ordinal", text.score_passage(F.col("passage"), terms).alias("score"))
    by_id = Window.partitionBy("id")
    placed = scored.withColumn("top", F.max("score").over(by_id)).withColumn("place", F.row_number().over(by_id.orderBy(F.col("score").desc(), "ordinal")))
    return placed.filter((F.col("place") <= most) & ((F.col("score") > 0) | (F.col("top") == 0))).select("id", "ordinal", "score", "place")


def chunks(records: DataFrame, bodies: DataFrame, most: int = schema.CAPS["chunks"]) -> DataFrame:
    """``chunk_id, source_id, kind, ordinal, text`` that are embedded: the first passages of extracts (``bodies``: id, body), and claims with their quotes."""
    from tessellore.functions import udf

    extracts = records.filter("type = 'TextExtract'").select("id").join(bodies.select("id", "body"), "id")
    cut_ = extracts.select("id", F.posexplode(F.slice(udf.passages_column(F.col("body")), 1, most)).alias("ordinal", "text"))
    passages = cut_.select(F.concat("id", F.lit("#p"), F.col("ordinal").cast("string")).alias("chunk_id"), F.col("id").alias("source_id"), F.lit("extract").alias("kind"), "ordinal", "text")
    quote = text.strip(F.regexp_replace(F.coalesce("body", F.lit("")), r"(?m)^>\s*", ""))
    claims = records.filter("type = 'Claim'").select("id", F.concat_ws("\n", F.nullif(F.trim("title"), F.lit("")), F.nullif(quote, F.lit(""))).alias("text")).filter("text <> ''")
    return passages.unionByName(claims.select(F.concat("id", F.lit("#quote")).alias("chunk_id"), F.col("id").alias("source_id"), F.lit("claim").alias("kind"), F.lit(0).alias("ordinal"), "text"))


def evidence_papers(found: DataFrame, papers: DataFrame) -> DataFrame:
    """``id, title, n`` of the papers of claims found (``paper``), most claims first."""
    counted = found.filter("paper is not null").groupBy(F.col("paper").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(papers.select("id", "title"), "id").select("id", "title", "n").orderBy(F.col("n").desc(), "id")
