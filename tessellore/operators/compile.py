"""The write path: sources bound to papers, outputs of segments merged, pages upserted, claims written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellore import schema
from tessellore.functions import text, udf
from tessellore.operators.links import LINK, bundle_href

NONE = "array<string>"


def _first(frame: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the first by an order, without a sort: a pre-aggregated minimum."""
    kept = [c for c in frame.columns if c not in (key, order)]
    return frame.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*kept), order).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in kept])


# binding ------------------------------------------------------------------------------
def bind_extracts(extracts: DataFrame, papers: DataFrame, state: DataFrame) -> DataFrame:
    """``path, paper, doi, bound_by, changed`` of extracts (``path, paper, resource, doi``).

    The paper is, in this order, the one that the extract names, the one that the pipeline's
    ``state`` (``extract, paper``) recorded, the one with its resource (``resources`` of
    ``papers``: id, doi, resources), the one with its DOI. Of several the last path counts.
    """
    ids = papers.select(F.col("id").alias("k_id"), F.col("doi").alias("doi_id"))
    recorded = state.filter("extract is not null and paper is not null").select(F.regexp_replace("extract", "^/+", "").alias("k_path"), text.concept_id(F.col("paper")).alias("by_state"))
    recorded = recorded.groupBy("k_path").agg(F.max("by_state").alias("by_state"))
    resources = papers.select(F.explode("resources").alias("k_resource"), "id").groupBy("k_resource").agg(F.max("id").alias("by_resource"))
    dois = papers.select(text.normalize_doi(F.col("doi")).alias("k_doi"), "id").filter("k_doi is not null").groupBy("k_doi").agg(F.max("id").alias("by_doi"))
    own = text.concept_id(F.col("paper"))
    keyed = extracts.select("path", own.alias("own"), F.col("resource").alias("e_resource"), F.col("doi").alias("e_doi"), text.normalize_doi(F.col("doi")).alias("e_key"))
    met = keyed.join(ids.select(F.col("k_id").alias("by_own")), F.col("own") == F.col("by_own"), "left").join(recorded, F.col("path") == F.col("k_path"), "left")
    met = met.join(resources, F.col("e_resource") == F.col("k_resource"), "left").join(dois, F.col("e_key") == F.col("k_doi"), "left")
    by = F.when(F.col("by_own").isNotNull(), "paper").when(F.col("by_state").isNotNull(), "pipeline").when(F.col("by_resource").isNotNull(), "resource").when(F.col("by_doi").isNotNull(), "doi")
    found = met.withColumn("bound", F.coalesce("by_own", "by_state", "by_resource", "by_doi")).withColumn("bound_by", by).join(ids, F.col("bound") == F.col("k_id"), "left")
    doi = F.coalesce("doi_id", "e_doi")
    changed = F.col("bound").isNotNull() & (~F.col("own").eqNullSafe(F.col("bound")) | (F.col("doi_id").isNotNull() & ~F.col("e_doi").eqNullSafe(F.col("doi_id"))))
    return found.select("path", F.coalesce("bound", "own").alias("paper"), doi.alias("doi"), "bound_by", changed.alias("changed"))


def compile_targets(targets: DataFrame, selector: str, papers: DataFrame, state: DataFrame) -> DataFrame:
    """``extract, paper, matched_by`` of the targets (``extract, source, title, paper``) that a selector names.

    Kinds of match, the first that has any counts: extract path, source file, bound paper,
    pipeline record, resource of the paper, the paper's title and at last the slug; the last
    two only if exactly one target fits. All kinds are one scan of the targets.
    """
    raw = selector.lstrip("/")
    dotted = raw if raw.endswith(".md") else f"{raw}.md"
    name = raw.rsplit("/", 1)[-1].lower()
    want = raw.removesuffix(".md") if raw.startswith("papers/") else f"papers/{raw.removesuffix('.md')}"
    paper = papers.filter(F.col("id") == want).select(F.lit(True).alias("known"), F.col("resources").alias("p_resources"), text.slug(F.coalesce("title", F.lit(""))).alias("p_slug"))
    recorded = state.filter(text.concept_id(F.col("paper")) == want).agg(F.max(F.regexp_replace("extract", "^/+", "")).alias("r_extract"))
    one = targets.sparkSession.range(1).select().join(recorded).join(paper, how="left")  # one row: the paper's side, at most
    file = F.lower(F.element_at(F.split("source", "/"), -1))
    stem = F.regexp_replace(file, r"\.[^./]+$", "")
    title = text.slug(F.coalesce("title", F.lit("")))
    tests = {
        "extract": F.col("extract").isin(dotted, f"extracts/{dotted}", raw if raw.startswith("extracts/") else dotted),
        "source": (F.col("source") == raw) | (file == name if "." in name else F.lit(False)),
        "paper": F.coalesce(text.concept_id(F.col("paper")) == want, F.lit(False)),
        "pipeline": F.coalesce(F.col("extract") == F.col("r_extract"), F.lit(False)),
        "resource": F.coalesce(F.array_contains("p_resources", F.col("source")), F.lit(False)),
        "title": F.coalesce(text.akin(title, F.col("p_slug"), "target"), F.lit(False)),
        "slug": text.akin(title, F.lit(want.removeprefix("papers/")), "target") | text.akin(text.slug(stem), F.lit(want.removeprefix("papers/")), "target"),
    }
    met = targets.join(F.broadcast(one)).select("extract", "paper", F.coalesce("known", F.lit(False)).alias("known"), F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]).alias("kinds"))
    spread = met.select("extract", "paper", "known", F.posexplode(F.array(*[F.get("kinds", F.lit(i)) for i in range(len(tests))])).alias("order", "matched_by")).filter("matched_by is not null")
    counts = spread.groupBy("order", "matched_by").agg(F.count(F.lit(1)).alias("n"))  # a row a kind, seven at most
    best = counts.filter(F.col("n").isNotNull() & (~F.col("matched_by").isin("title", "slug") | (F.col("n") == 1))).agg(F.min("order").alias("best"))
    out = spread.join(F.broadcast(best), F.col("order") == F.col("best"))
    single = F.col("matched_by").isin("extract", "source")
    first = F.row_number().over(Window.partitionBy("order").orderBy("extract"))  # the hits of one selector
    given = F.when(~F.col("matched_by").isin("extract", "source", "paper") & ((F.col("matched_by") != "slug") | F.col("known")), F.lit(f"{want}.md"))
    return out.withColumn("n", first).filter(~single | (F.col("n") == 1)).select("extract", F.coalesce("paper", given).alias("paper"), "matched_by")


# outputs of segments ------------------------------------------------------------------
def joined_bodies(bodies: Column) -> Column:
    """Bodies in order, each appended unless what is there holds it."""
    def step(got: Column, more: Column) -> Column:
        extra = F.trim(more)
        return F.when(got.isNull(), more).when((extra == "") | F.contains(got, extra), got).otherwise(F.concat(F.rtrim(got), F.lit("\n\n"), extra))

    return F.aggregate(bodies, F.lit(None).cast("string"), step)


def merge_segment_concepts(items: DataFrame) -> DataFrame:
    """``doc, kind, key, title, tags, body`` of concepts (``doc, segment, pos, kind, title, tags, body``): one for each aligned title.

    The first item gives the title, tags unite in order, bodies are appended unless held. A
    key's items meet in one row, which the segments of one document bound.
    """
    key = text.align_key(F.col("title"))
    keyed = items.withColumn("key", F.when(key == "", F.lower(F.trim("title"))).otherwise(key))
    rows = F.array_sort(F.collect_list(F.struct("segment", "pos", "title", "tags", "body")))
    met = keyed.groupBy("doc", "kind", "key").agg(rows.alias("r"))
    tags = F.array_distinct(F.flatten(F.transform("r", lambda x: F.coalesce(x.tags, F.array().cast(NONE)))))
    return met.select("doc", "kind", "key", F.get("r", F.lit(0)).title.alias("title"), tags.alias("tags"), joined_bodies(F.transform("r", lambda x: x.body)).alias("body"))


def merge_segment_claims(claims: DataFrame) -> DataFrame:
    """``doc, key, title, quote`` of claims (``doc, segment, pos, title, quote``): the first for each quote, else title."""
    print_ = F.trim(text.quote_fingerprint(F.coalesce("quote", F.lit(""))))
    keyed = claims.withColumn("key", F.when(print_ != "", print_).otherwise(F.lower(F.trim(F.coalesce("title", F.lit("")))))).filter("key <> ''")
    return keyed.groupBy("doc", "key").agg(F.min_by(F.struct("title", "quote"), F.struct("segment", "pos")).alias("c")).select("doc", "key", "c.title", "c.quote")


def merge_additions(heads: DataFrame, tails: DataFrame) -> DataFrame:
    """``doc, body`` of papers (``doc, body``) with what later segments (``doc, segment, additions``) add."""
    more = tails.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("segment", "additions"))), lambda x: x.additions).alias("more"))
    return heads.join(more, "doc", "left").select("doc", joined_bodies(F.concat(F.array("body"), F.coalesce("more", F.array().cast(NONE)))).alias("body"))


# pages --------------------------------------------------------------------------------
def _papers_of(existing: Column) -> Column:
    """``label, href`` of the links to papers in a body, in order."""
    pairs = F.arrays_zip(F.regexp_extract_all(existing, F.lit(LINK), F.lit(1)).alias("label"), F.regexp_extract_all(existing, F.lit(LINK), F.lit(2)).alias("href"))
    papers = F.filter(F.transform(pairs, lambda p: F.struct(F.trim(p.label).alias("label"), bundle_href(p.href).alias("href"))), lambda p: p.href.startswith("/papers/") & p.href.endswith(".md"))
    return F.transform(papers, lambda p: F.struct(F.when(p.label == "", F.lit("Paper")).otherwise(p.label).alias("label"), p.href.alias("href")))


def paper_links(existing: Column, incoming: Column) -> Column:
    """The incoming body with the paper links of the existing one that it lacks."""
    return F.aggregate(_papers_of(existing), incoming, lambda body, p: text.ensure_href(body, p.label, p.href))


def _with_links(body: Column, labels: Column, hrefs: Column) -> Column:
    return udf.links_column(body, F.regexp_replace(body, r"\s+$", ""), labels, hrefs)


def united_aliases(existing: Column, title: Column, incoming_titles: Column) -> Column:
    """Aliases and, unless they align with the title, the incoming titles and what all these titles have in parentheses."""
    differs = lambda a: text.align_key(a) != text.align_key(title)
    own = F.filter(F.transform(incoming_titles, F.trim), lambda t: (t != "") & differs(t))
    more = F.filter(F.concat(text.parentheticals(title), F.flatten(F.transform(incoming_titles, text.parentheticals))), differs)
    return F.array_distinct(F.concat(F.coalesce(existing, F.array().cast(NONE)), own, more))


def upsert_pages(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """``path, action, title, tags, aliases, body`` of hub pages that a compile writes.

    ``incoming`` has ``path, title, incoming_title, tags, body, paper_title, paper_href``;
    ``existing`` has ``path, title, tags, aliases, body, verified``. Several items may go to
    one path, also of several papers: in the order of papers and titles, their bodies are
    appended unless held, their tags and titles unite and every paper gets its link. What
    meets in one row is what one page will hold. A page that a human verified keeps its body
    and gets only links and aliases ("skipped").
    """
    rows = F.array_sort(F.collect_list(F.struct("paper_href", "incoming_title", "body", "paper_title", "title", "tags")))
    items = incoming.groupBy("path").agg(rows.alias("r")).withColumn("made", udf.join_column(F.transform("r", lambda x: F.coalesce(x.body, F.lit("")))))
    old = existing.select(F.col("path").alias("o_path"), F.col("title").alias("o_title"), F.col("tags").alias("o_tags"), F.col("aliases").alias("o_aliases"), F.col("body").alias("o_body"), "verified")
    met = items.join(old, F.col("path") == F.col("o_path"), "left")
    there, verified = F.col("o_path").isNotNull(), F.coalesce("verified", F.lit(False))
    title = F.coalesce("o_title", F.get("r", F.lit(0)).title)
    none = F.array().cast(NONE)
    start = F.when(verified, F.coalesce("o_body", F.lit(""))).otherwise(F.coalesce("made", F.lit("")))
    met = met.withColumn("linked", _with_links(start, F.transform("r", lambda x: x.paper_title), F.transform("r", lambda x: x.paper_href)))
    kept = _papers_of(F.when(there & ~verified, F.coalesce("o_body", F.lit(""))).otherwise(""))
    body = _with_links(F.col("linked"), F.transform(kept, lambda p: p.label), F.transform(kept, lambda p: p.href))
    given = F.flatten(F.transform("r", lambda x: F.coalesce(x.tags, none)))
    tags = F.when(verified, F.col("o_tags")).otherwise(F.array_distinct(F.concat(F.coalesce("o_tags", none), given)))
    action = F.when(verified, "skipped").when(there, "updated").otherwise("written")
    titles = F.array_distinct(F.transform("r", lambda x: x.incoming_title))
    return met.select("path", action.alias("action"), title.alias("title"), tags.alias("tags"), united_aliases(F.col("o_aliases"), title, titles).alias("aliases"), body.alias("body"))


def upsert_papers(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """``path, action, body``: a paper page that a human verified is skipped, all others are written."""
    old = existing.filter("verified").select("path", F.lit(True).alias("v"))
    return incoming.join(old, "path", "left").select("path", F.when(F.col("v"), "skipped").otherwise("written").alias("action"), "body")


def published_of(model: Column, filename: Column, created: Column) -> Column:
    """The date that the model gave, if valid, else a year in the file's name, else the document's creation date."""
    year = lambda value, pattern, group: text.normalize_published(F.nullif(F.regexp_extract(value, pattern, group), F.lit("")))
    return F.coalesce(text.normalize_published(model), year(filename, r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)", 1), year(created, r"(?:19|20)[0-9]{2}", 0))


# claims -------------------------------------------------------------------------------
def claim_path(paper: Column, title: Column) -> Column:
    return F.concat(F.lit("claims/"), F.regexp_replace(text.concept_id(paper), "^papers/", ""), F.lit("--"), text.slug(title), F.lit(".md"))


def write_claims(claims: DataFrame, texts: DataFrame, existing: DataFrame) -> DataFrame:
    """``path, action, quote, body`` of claims (``paper, paper_title, title, quote, note``).

    The quote is replaced by the span of the paper's text (``paper, extract``) that it snaps
    to; a claim whose quote has none is omitted, a page (``path, verified, confidence``) that
    a human verified or reviewed is skipped, all others are written. Claims without title or
    quote don't count; of two of one path the last by title and quote is written.
    """
    clean = claims.select("paper", "paper_title", F.trim("title").alias("title"), F.trim("quote").alias("quote"), F.trim(F.coalesce("note", F.lit(""))).alias("note")).filter("title <> '' and quote <> ''")
    met = clean.join(texts, "paper", "left").select("paper", "paper_title", "title", "note", udf.snap_column(F.col("quote"), F.coalesce("extract", F.lit(""))).alias("span"), claim_path(F.col("paper"), F.col("title")).alias("path"))
    one = met.groupBy("path").agg(F.max_by(F.struct("paper", "paper_title", "note", "span"), F.struct(F.col("span").isNotNull(), "title", "span")).alias("c")).select("path", "c.*")
    kept = existing.filter(F.coalesce("verified", F.lit(False)) | F.coalesce(F.col("confidence") == "reviewed", F.lit(False))).select("path", F.lit(True).alias("held"))
    out = one.join(kept, "path", "left")
    action = F.when(F.col("span").isNull(), "omitted").when(F.col("held"), "skipped").otherwise("written")
    body = F.concat_ws("\n\n", F.concat(F.lit("> "), "span"), F.nullif(F.col("note"), F.lit("")))
    body = text.ensure_href(body, F.col("paper_title"), F.concat(F.lit("/"), text.concept_path(F.col("paper"))))
    return out.select("path", action.alias("action"), F.col("span").alias("quote"), F.when(action == "written", body).alias("body"))


def claims_of(concepts: DataFrame, paper: str) -> DataFrame:
    """``path, title, confidence`` of a paper's claims: by their paper field or, without one, by their path."""
    prefix = f"claims/{paper.removeprefix('papers/')}--"
    own = F.when(F.col("paper").isNotNull(), text.concept_id(F.col("paper")) == paper).otherwise(F.col("path").startswith(prefix))
    return concepts.filter((F.col("type") == "Claim") & own).select("path", F.coalesce("title", "path").alias("title"), F.coalesce("confidence", F.lit("extracted")).alias("confidence")).orderBy("path")


# saved pages --------------------------------------------------------------------------
def save_page(concepts: DataFrame, kind: str, title: str, body: str, *, verified: bool = False) -> DataFrame:
    """``path, type, title, body, action`` of a note or survey to be saved, one row.

    Title and body must not be empty and every cited paper and claim must be in the library;
    a survey that a human verified keeps its text and gets only its generated blocks renewed.
    """
    if kind not in ("Note", "Survey", "Question") or not title.strip() or not body.strip():
        raise ValueError("a page needs a known kind, a title and a body")
    spark = concepts.sparkSession
    made = spark.createDataFrame([(title.strip(), body)], "title string, body string").withColumn("path", F.concat(F.lit(f"{schema.DIRECTORIES[kind]}/"), text.slug(F.col("title")), F.lit(".md")))
    cited = made.select(F.explode(text.cite_ids(F.col("body"))).alias("id")).filter(F.col("id").rlike("^(papers|claims)/"))
    missing = cited.join(concepts.select("id"), "id", "left_anti").limit(20).collect()  # the message's own cap
    if missing:
        raise ValueError("cited pages are not in the library: " + ", ".join(sorted(r.id for r in missing)))
    old = concepts.select("path", F.col("body").alias("o_body"), F.col("verified_human").alias("held"))
    met = made.join(old, "path", "left")
    renewed = text.merged_generated(F.col("o_body"), F.col("body"))
    held = F.coalesce("held", F.lit(False))
    body_column = F.when(held & F.lit(kind == "Survey"), renewed).when(held, F.col("o_body")).otherwise(F.col("body"))
    action = F.when(held & F.lit(kind == "Survey"), "blocks").when(held, "skipped").when(F.col("o_body").isNotNull(), "updated").otherwise("written")
    return met.select("path", F.lit(kind).alias("type"), "title", body_column.alias("body"), action.alias("action"))
