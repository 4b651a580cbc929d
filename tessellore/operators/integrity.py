"""Evidence and link integrity: citations, dead links, claims against their extracts, the review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellore import schema
from tessellore.functions import text, udf


def dead_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """``target, scope``: link targets (``scope, target``) that no file has; the first scope of each."""
    return links.join(files.select(F.col("path").alias("target")), "target", "left_anti").groupBy("target").agg(F.min("scope").alias("scope"))


def cite_check(bodies: DataFrame, records: DataFrame) -> DataFrame:
    """``id, cited, legal``: ids cited in bodies and whether they are papers or claims of the library."""
    cited = bodies.select("id", F.explode(text.cite_ids(F.col("body"))).alias("cited"))
    allowed = records.filter(F.col("type").isin("Paper", "Claim")).select(F.col("id").alias("cited"), F.lit(True).alias("ok"))
    return cited.join(allowed, "cited", "left").select("id", "cited", F.coalesce("ok", F.lit(False)).alias("legal"))


def first_extracts(extracts: DataFrame) -> DataFrame:
    """The extract with the least path of each paper."""
    return extracts.groupBy("paper").agg(F.min_by("body", "id").alias("extract"), F.min("id").alias("extract_id"))


def prune_claims(claims: DataFrame, extracts: DataFrame, snap=None) -> DataFrame:
    """``id, verdict``: kept when reviewed or quoted, healed when the quote can be snapped, else pruned.

    ``snap`` maps quote and extract columns to a verbatim span or null. Texts compare in NFKC.
    """
    met = claims.join(first_extracts(extracts), "paper", "left").withColumns({c: udf.nfkc_column(F.col(c)) for c in ("quote", "extract")})
    found = text.quote_in_extract(F.col("quote"), F.col("extract"))
    healed = F.lit(False) if snap is None else snap(F.col("quote"), F.col("extract")).isNotNull()
    verdict = F.when(F.col("confidence") == "reviewed", "kept").when(F.col("extract").isNull(), "kept").when(found, "kept").when(healed, "healed").otherwise("pruned")
    return met.select("id", "paper", verdict.alias("verdict"))


def review_items(nodes: DataFrame, pairs: DataFrame, extracts: DataFrame) -> DataFrame:
    """``kind, path, other, reason`` of everything a reviewer should see."""
    row = lambda frame, kind, reason, other=None: frame.select(F.lit(kind).alias("kind"), F.col("id").alias("path"), (F.lit(None).cast("string") if other is None else other).alias("other"), F.lit(reason).alias("reason"))
    papers = nodes.filter(F.col("type") == "Paper")
    out = row(nodes.filter((F.col("type") == "Claim") & (F.col("confidence") == "disputed")), "disputed_claim", "disputed", F.col("paper"))
    out = out.unionByName(row(papers.filter(F.col("published").isNull() & schema.live(F.col("status"))), "undated_paper", "no date"))
    out = out.unionByName(row(nodes.filter((F.col("status") == "draft") & (F.col("type") != "Paper")), "draft", "draft"))
    out = out.unionByName(row(extracts.filter(text.broken_words(F.col("body")) >= text.BROKEN_WORD_THRESHOLD), "broken_extract", "broken words"))
    return out.unionByName(pairs.select(F.lit("near_duplicate").alias("kind"), F.col("a").alias("path"), F.col("b").alias("other"), "reason"))


def capped_review(items: DataFrame, most: int = schema.CAPS["review"]) -> DataFrame:
    """At most ``most`` items of each kind, and whether that cut any.

    The window alone limits its groups before they are shuffled; sizes are counted apart.
    """
    place = F.row_number().over(Window.partitionBy("kind").orderBy("path", F.coalesce("other", F.lit(""))))
    first = items.withColumn("place", place).filter(F.col("place") <= most)
    sizes = items.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))  # a row a kind
    return first.join(F.broadcast(sizes), "kind").select("kind", "path", "other", "reason", (F.col("n") > most).alias("truncated"))


def review_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def fold_claims(items: DataFrame) -> DataFrame:
    """Claim items of one kind and paper folded into a row."""
    return items.groupBy("kind", F.col("other").alias("paper")).agg(F.min("path").alias("first"), F.count(F.lit(1)).alias("n"))


def without_dismissed(pairs: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Pairs whose order-free key nobody dismissed (``a, b`` in any order)."""
    key = lambda: F.array_join(F.array_sort(F.array("a", "b")), "\t")
    return pairs.withColumn("pair", key()).join(dismissed.select(key().alias("pair")).distinct(), "pair", "left_anti").drop("pair")


#: Kinds of review items in their order, and those that ask for a decision.
REVIEW_KINDS = ("missing_published", "missing_doi", "low_confidence_biblio", "disputed_claim", "near_duplicate", "merge_conflict", "draft")
ACTION_KINDS = ("merge_conflict", "near_duplicate", "missing_published", "missing_doi", "low_confidence_biblio")


def review_queue(records: DataFrame, pairs: DataFrame, extracts: DataFrame, conflicts: DataFrame) -> DataFrame:
    """``kind, path, other, paper, reason`` of all seven kinds of review items.

    ``records`` has ``path, type, status, published, doi, biblio, confidence, paper, quote``;
    ``pairs`` ``a, b, reason``; ``extracts`` ``id, paper, body``; ``conflicts`` ``path,
    reason``. A claim is disputed by its confidence or as its quote is not in the first
    extract of its paper; a draft that is queued as such a claim is not queued twice. All
    checks of a record are one pass over it.
    """
    live = schema.live(F.col("status"))
    paper, claim = F.col("type") == "Paper", F.col("type") == "Claim"
    quotes = records.filter(claim & live & F.col("paper").isNotNull() & (F.coalesce("quote", F.lit("")) != "")).select("path", "paper", "quote")
    held = quotes.join(first_extracts(extracts).select("paper", "extract"), "paper").filter(F.col("extract") != "")
    lost = held.filter(~text.quote_in_extract(F.col("quote"), F.col("extract"))).select("path", F.lit(True).alias("lost"))
    met = records.filter(F.col("type") != "TextExtract").join(lost, "path", "left").withColumn("lost", F.coalesce("lost", F.lit(False)))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    disputed = claim & live & (F.col("lost") | F.coalesce(F.col("confidence") == "disputed", F.lit(False)))
    item = lambda when, kind, reason: F.when(when, F.struct(F.lit(kind).alias("kind"), reason.alias("reason")))
    found = F.array_compact(
        F.array(
            item(paper & live & empty("published"), "missing_published", F.lit("no date")),
            item(paper & live & empty("doi"), "missing_doi", F.lit("no DOI")),
            item(paper & live & F.coalesce(F.col("biblio") == "suggested", F.lit(False)), "low_confidence_biblio", F.lit("a bibliography hit waits")),
            item(disputed, "disputed_claim", F.when(F.col("lost"), "quote not in extract").otherwise("disputed")),
            item((F.col("status") == "draft") & ~disputed, "draft", F.lit("draft")),
        )
    )
    none = F.lit(None).cast("string")
    out = met.select("path", "paper", F.explode(found).alias("i")).select("i.kind", "path", none.alias("other"), F.when(F.col("i.kind") == "disputed_claim", F.col("paper")).alias("paper"), "i.reason")
    out = out.unionByName(pairs.select(F.lit("near_duplicate").alias("kind"), F.col("a").alias("path"), F.col("b").alias("other"), none.alias("paper"), "reason"))
    return out.unionByName(conflicts.select(F.lit("merge_conflict").alias("kind"), "path", none.alias("other"), none.alias("paper"), "reason"))


def review_order(items: DataFrame) -> DataFrame:
    """Items by kind, path and other path."""
    rank = F.array_position(F.array(*map(F.lit, REVIEW_KINDS)), F.col("kind"))
    return items.orderBy(rank, "path", F.coalesce("other", F.lit("")))


def review_totals(items: DataFrame) -> DataFrame:
    """One row: items that ask for a decision, and those that are inventory."""
    action = F.col("kind").isin(*ACTION_KINDS)
    return items.agg(F.count_if(action).alias("actions"), F.count_if(~action).alias("backlog"))
