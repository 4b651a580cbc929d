"""Citable output: citation keys, BibTeX, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellore import schema
from tessellore.functions import text
from tessellore.operators.names import unique_names


def citation_keys(papers: DataFrame) -> DataFrame:
    """``id, key``: the first paper of a key keeps it, others add their id's slug; what still repeats is numbered until no key does."""
    base = papers.select("id", text.citation_key(F.coalesce(F.nullif(F.trim("title"), F.lit("")), "id"), F.col("published")).alias("base"))
    slug = F.substring(F.regexp_replace(F.regexp_replace("id", "^papers/", ""), "[^A-Za-z0-9]+", ""), 1, 12)
    first = base.groupBy("base").agg(F.min("id").alias("first"))
    tried = base.join(first, "base").select("id", F.when(F.col("id") == F.col("first"), F.col("base")).otherwise(F.concat("base", slug)).alias("base"))
    none = papers.sparkSession.createDataFrame([], "name string")
    return unique_names(tried, none, glue="").select("id", F.col("name").alias("key"))


def bibtex(papers: DataFrame) -> DataFrame:
    """``id, entry`` of papers (``id, title, published, doi, authors, venue``)."""
    field = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"  {name} = {{"), value, F.lit("}")))
    keyed = papers.join(citation_keys(papers), "id")
    fields = F.array_compact(
        F.array(
            field("title", text.escape_bib(F.coalesce("title", "id"))),
            field("author", text.escape_bib(F.col("authors"))),
            field("year", text.published_year(F.col("published"))),
            field("journal", text.escape_bib(F.col("venue"))),
            field("doi", text.escape_bib(F.col("doi"))),
        )
    )
    return keyed.select("id", F.concat(F.lit("@article{"), "key", F.lit(",\n"), F.array_join(fields, ",\n"), F.lit("\n}")).alias("entry"))


def prune_sessions(sessions: DataFrame, most: int = schema.CAPS["sessions"]) -> DataFrame:
    """Sessions (``workspace, id, updated, n_turns``) that stay: empty ones go first, then the oldest."""
    order = Window.partitionBy("workspace").orderBy((F.col("n_turns") == 0), F.col("updated").desc(), "id")
    return sessions.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).drop("n")


def manuscript(surveys: DataFrame, keys: DataFrame, style: str = "md") -> DataFrame:
    """``id, text`` of surveys (``id, body``): links to papers become citations by key, links to other pages their labels; links out of the library stay.

    Links are exploded, joined with the keys and put back in place, so no pattern is made
    of the keys and no body is matched against all of them.
    """
    pattern = r"\[([^\]]*)\]\(/?([^)\s]+?)(?:\.md)?\)"
    cite = {"md": lambda k: F.concat(F.lit("[@"), k, F.lit("]")), "tex": lambda k: F.concat(F.lit(r"\cite{"), k, F.lit("}")), "tex-body": lambda k: F.concat(F.lit(r"~\cite{"), k, F.lit("}"))}[style]
    plain = text.escape_latex if style == "tex" else (lambda x: x)
    parts = surveys.select(
        "id",
        F.split("body", r"\[[^\]]*\]\(/?[^)\s]+?(?:\.md)?\)", -1).alias("between"),
        F.regexp_extract_all("body", F.lit(pattern), F.lit(1)).alias("labels"),
        F.regexp_extract_all("body", F.lit(pattern), F.lit(2)).alias("targets"),
        F.regexp_extract_all("body", F.lit(r"(\[[^\]]*\]\(/?[^)\s]+?(?:\.md)?\))"), F.lit(1)).alias("wholes"),
    )
    links = parts.select("id", F.posexplode(F.arrays_zip("labels", "targets", "wholes")).alias("pos", "link")).select("id", "pos", F.col("link.labels").alias("label"), F.col("link.targets").alias("target"), F.col("link.wholes").alias("whole"))
    met = links.join(keys.select(F.col("id").alias("target"), "key"), "target", "left")
    shown = met.select("id", F.struct("pos", F.when(F.col("key").isNotNull(), cite(F.col("key"))).when(F.col("target").rlike(r"://|^#|^(?i)mailto:"), F.col("whole")).otherwise(plain(F.col("label"))).alias("t")).alias("l"))
    texts = shown.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("l")), lambda x: x.t).alias("links"))
    whole = parts.select("id", "between").join(texts, "id", "left").withColumn("links", F.coalesce("links", F.array().cast("array<string>")))
    woven = F.array_join(F.transform("between", lambda b, i: F.concat(plain(b), F.coalesce(F.get("links", i), F.lit("")))), "")
    return whole.select("id", woven.alias("text"))


def coverage_block(papers: DataFrame, cited: DataFrame, years: DataFrame) -> DataFrame:
    """One row: papers in scope (``paper, year``), cited ones, and the years (``year``) without a paper."""
    one = papers.agg(F.count(F.lit(1)).alias("n_scope"), F.collect_set("year").alias("have"))
    n = papers.join(cited.select("paper").distinct(), "paper", "left_semi").agg(F.count(F.lit(1)).alias("n_cited"))
    axis = years.agg(F.collect_set("year").alias("axis"))  # at most a hundred years
    row = one.withColumn("k", F.lit(1)).join(n.withColumn("k", F.lit(1)), "k").join(axis.withColumn("k", F.lit(1)), "k")
    return row.select("n_scope", "n_cited", F.array_sort(F.array_except("axis", "have")).alias("missing_years"))
