"""Links in page bodies: taken apart, decided by joins and put back in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellore import schema
from tessellore.functions import text
from tessellore.operators import align

#: The form of a link, its label and its target.
LINK = r'\[([^\]]*)\]\(([^)\s]+)(?:\s+"[^"]*")?\)'
_BETWEEN = r'\[[^\]]*\]\([^)\s]+(?:\s+"[^"]*")?\)'
_WHOLE = f"({_BETWEEN})"
#: The folders of hub pages by type.
HUB_FOLDERS = {schema.DIRECTORIES[k]: k for k in schema.HUB_TYPES}


def bundle_href(href: Column) -> Column:
    """A link's target as a path from the root: without its fragment, with one slash."""
    return F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(href, "#.*$", ""), "^/+", ""))


def body_links(bodies: DataFrame) -> DataFrame:
    """``id, pos, label, target`` of all links to pages (``id, body``); targets are paths without the slash."""
    pairs = F.arrays_zip(F.regexp_extract_all("body", F.lit(LINK), F.lit(1)).alias("label"), F.regexp_extract_all("body", F.lit(LINK), F.lit(2)).alias("href"))
    found = bodies.select("id", F.posexplode(pairs).alias("pos", "l")).select("id", "pos", F.trim("l.label").alias("label"), F.col("l.href").alias("href"))
    inside = ~F.contains("href", F.lit("://")) & ~F.col("href").startswith("#")
    return found.filter(inside).select("id", "pos", "label", F.substring(bundle_href(F.col("href")), 2, 1 << 20).alias("target")).filter(F.col("target").endswith(".md"))


def weave(bodies: DataFrame, decided: DataFrame) -> DataFrame:
    """``id, body`` with the links at some places (``id, pos, text``) replaced; all others stay as they are.

    A body is split at its links, so no pattern is made of targets; a page's replacements
    meet in one row, which the page's own links bound.
    """
    made = decided.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "text"))).alias("by_pos"))
    parts = bodies.join(made, "id", "left")
    between, whole = F.split("body", _BETWEEN, -1), F.regexp_extract_all("body", F.lit(_WHOLE), F.lit(1))
    chosen = F.transform(whole, lambda w, i: F.coalesce(F.try_element_at("by_pos", i), w))
    woven = F.array_join(F.flatten(F.transform(F.arrays_zip(between.alias("b"), chosen.alias("c")), lambda x: F.array(F.coalesce(x.b, F.lit("")), F.coalesce(x.c, F.lit(""))))), "")
    return parts.select("id", F.when(F.col("by_pos").isNull(), F.col("body")).otherwise(woven).alias("body"))


def link_text(label: Column, path: Column) -> Column:
    return F.concat(F.lit("["), label, F.lit("](/"), path, F.lit(")"))


def rewrite_links(bodies: DataFrame, moves: DataFrame) -> DataFrame:
    """``id, body`` after pages moved (``old, new`` ids): links to an old page point to the new one."""
    found = body_links(bodies)
    moved = moves.select(F.concat("old", F.lit(".md")).alias("target"), F.concat("new", F.lit(".md")).alias("into"))
    return weave(bodies, found.join(moved, "target").select("id", "pos", link_text(F.col("label"), F.col("into")).alias("text")))


def strip_illegal_cites(bodies: DataFrame, allowed: DataFrame) -> DataFrame:
    """``id, body`` in which links to papers and claims that are not ``allowed`` (``id``) are their labels."""
    found = body_links(bodies).filter(F.col("target").rlike("^(papers|claims)/")).withColumn("cited", F.regexp_replace("target", r"\.md$", ""))
    return weave(bodies, found.join(allowed.select(F.col("id").alias("cited")), "cited", "left_anti").select("id", "pos", F.col("label").alias("text")))


def _slug(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.md$", "")


def means_paper(label: Column, target: Column, paper: Column) -> Column:
    """Whether a link with an invented target means a paper, by its label or, without one, by its file name."""
    said = F.when(label != "", label).otherwise(_slug(target))
    letters = F.regexp_replace(F.lower(said), "[^a-z0-9]+", "-")
    return text.akin(F.btrim(letters, F.lit("-")), F.lower(_slug(paper)), "link")


def sanitize_links(links: DataFrame, files: DataFrame, papers: DataFrame) -> DataFrame:
    """``id, pos, label, target, action, into`` of body links; ``papers`` (``id, paper``) names the paper path of each body.

    What exists (``files``: path) is kept, as is the body's own paper; ``paper(s)/`` links
    whose label means that paper go to it; a hub link whose slug is the beginning of one
    page's slug in its folder goes to that page; all others are unlinked.
    """
    there = files.select(F.col("path").alias("target"), F.lit(True).alias("there")).distinct()
    met = links.join(papers.select("id", "paper"), "id", "left").join(there, "target", "left")
    keep = F.coalesce("there", F.lit(False)) | F.coalesce(F.col("target") == F.col("paper"), F.lit(False))
    folder = F.regexp_extract("target", "^([^/]*)/", 1)
    met = met.withColumn("keep", keep).withColumn("folder", folder)
    # dead hub links against the pages of their folder, met by the first letter of the slug
    dead = met.filter(~F.col("keep") & F.col("folder").isin(*HUB_FOLDERS)).select("target", "folder", _slug(F.col("target")).alias("begin")).filter("begin <> ''").distinct()
    pages = files.filter(F.col("path").endswith(".md")).select(F.regexp_extract("path", "^([^/]*)/", 1).alias("folder"), F.col("path").alias("page"), _slug(F.col("path")).alias("slug"))
    initial = lambda c: F.substring(c, 1, 1)
    near = dead.withColumn("initial", initial("begin")).join(pages.withColumn("initial", initial("slug")), ["folder", "initial"]).filter(F.col("slug").startswith(F.col("begin")))
    one = near.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("page")).filter("n = 1").select("target", "page")
    met = met.join(one, "target", "left")
    means = F.col("folder").isin("paper", "papers") & F.coalesce(means_paper(F.col("label"), F.col("target"), F.col("paper")), F.lit(False))
    action = F.when(F.col("keep"), "keep").when(means, "paper").when(F.col("page").isNotNull(), "align").otherwise("unlink")
    into = F.when(F.col("keep"), F.col("target")).when(means, F.col("paper")).otherwise(F.col("page"))
    return met.select("id", "pos", "label", "target", action.alias("action"), into.alias("into"))


def sanitize_bodies(bodies: DataFrame, files: DataFrame) -> DataFrame:
    """``id, body`` of generated bodies (``id, body, paper``) in which every page link leads to a page."""
    decided = sanitize_links(body_links(bodies), files, bodies).filter("action <> 'keep'")
    return weave(bodies.select("id", "body"), decided.select("id", "pos", F.when(F.col("action") == "unlink", F.col("label")).otherwise(link_text(F.col("label"), F.col("into"))).alias("text")))


def guard_links(links: DataFrame, files: DataFrame, hubs: DataFrame) -> DataFrame:
    """``id, pos, label, target, action, into, type, title`` of body links that lead nowhere.

    A hub link is aligned with the hub (``type, path, title, aliases``) that its label names,
    else its page is to be made as a stub; a link to any other folder is an error.
    """
    dead = links.join(files.select(F.col("path").alias("target")), "target", "left_anti")
    kinds = F.create_map(*[F.lit(x) for pair in HUB_FOLDERS.items() for x in pair])
    dead = dead.withColumn("type", F.try_element_at(kinds, F.regexp_extract("target", "^([^/]*)/", 1)))
    probes = dead.filter("type is not null and label <> ''").select(F.concat_ws("\x1f", "type", "label").alias("probe"), "type", F.col("label").alias("title")).distinct()
    found = align.lookup(align.index(hubs), probes).select("probe", F.col("path").alias("into"))
    met = dead.join(found, F.concat_ws("\x1f", "type", "label") == F.col("probe"), "left")
    aligned = F.col("into").isNotNull() & (F.col("into") != F.col("target"))
    action = F.when(F.col("type").isNull(), "error").when(aligned, "align").otherwise("stub")
    title = F.when(F.col("label") != "", F.col("label")).otherwise(F.trim(F.regexp_replace(_slug(F.col("target")), "[-_]+", " ")))
    return met.select("id", "pos", "label", "target", action.alias("action"), F.when(aligned, F.col("into")).alias("into"), "type", title.alias("title"))


def stub_pages(guarded: DataFrame, papers: DataFrame) -> DataFrame:
    """``path, type, title, body`` of the pages to be made, each once; ``papers`` (``id, paper, paper_title``) names who refers to them."""
    first = guarded.filter("action = 'stub'").join(papers, "id").groupBy("target").agg(F.min(F.struct("id", "pos", "type", "title", "paper", "paper_title")).alias("s"))
    body = F.concat(F.lit("Referenced from "), link_text(F.col("s.paper_title"), F.col("s.paper")), F.lit(", which has no page of its own yet; somebody should write it."))
    return first.select(F.col("target").alias("path"), "s.type", "s.title", body.alias("body"))


def guarded_bodies(bodies: DataFrame, guarded: DataFrame) -> DataFrame:
    """Bodies after the guard; raises if a link leads to a page that can't be made."""
    bad = guarded.filter("action = 'error'").select("target").distinct().limit(20).collect()  # the message's own cap
    if bad:
        raise ValueError("links lead nowhere: " + ", ".join(sorted(r.target for r in bad)))
    return weave(bodies, guarded.filter("action = 'align'").select("id", "pos", link_text(F.col("label"), F.col("into")).alias("text")))
