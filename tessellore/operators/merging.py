"""Merges of hubs as joins: the greedy choice in rounds, redirects to their ends, pages after them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellore.functions import text
from tessellore.operators import compile as compiling
from tessellore.operators import links
from tessellore.storage import cut


def consolidate(pairs: DataFrame, verified: DataFrame | None = None) -> DataFrame:
    """``gone, into, place`` of the merges that going through ``pairs`` (``place, keep, drop``) in order would make.

    A page merged away joins no later pair; a verified page (``id``) is never dropped: its
    pair turns round, and one of two verified pages is left out. A pair waits only for
    earlier ones that could drop one of its pages, so each round settles all pairs that wait
    for none; the least open pair never waits, so the rounds end.
    """
    order = F.struct("place", "keep", "drop")
    held = pairs.select("place", "keep", "drop").distinct()
    if verified is not None:
        ids = verified.select("id").distinct()
        known = lambda c: ids.select(F.col("id").alias(c), F.lit(True).alias(f"{c}_held"))
        held = held.join(known("keep"), "keep", "left").join(known("drop"), "drop", "left").filter(F.col("keep_held").isNull() | F.col("drop_held").isNull())
        turned = F.col("drop_held").isNotNull()
        held = held.select("place", F.when(turned, F.col("drop")).otherwise(F.col("keep")).alias("keep"), F.when(turned, F.col("keep")).otherwise(F.col("drop")).alias("drop"))
    open_ = cut(held.filter("keep <> drop").select(order.alias("o")))
    done = None
    while not open_.isEmpty():
        ends = open_.select("o", F.explode(F.array("o.keep", "o.drop")).alias("page"))
        first = open_.groupBy(F.col("o.drop").alias("page")).agg(F.min("o").alias("first"))
        waits = ends.join(first, "page").filter("first < o").select("o").distinct()
        ready = cut(open_.join(waits, "o", "left_anti"))
        done = ready if done is None else done.unionByName(ready)
        gone = ready.select(F.col("o.drop").alias("page"), F.col("o").alias("at"))
        late = ends.join(gone, "page").filter("at <= o").select("o").distinct()  # the merge itself, and later pairs of its page
        open_ = cut(open_.join(late, "o", "left_anti"))
    if done is None:
        done = open_
    return done.select(F.col("o.drop").alias("gone"), F.col("o.keep").alias("into"), F.col("o.place").alias("place"))


def closure(moves: DataFrame) -> DataFrame:
    """``from_id, to_id`` with every move (one a page) sent on to where it ends, by doubling.

    The pages of a cycle end at its least page, which itself doesn't move, and so do those
    that lead into it.
    """
    state = cut(moves.filter("from_id <> to_id").groupBy(F.col("from_id").alias("id")).agg(F.min("to_id").alias("to")).withColumn("least", F.col("to")))
    n = state.count()
    for _ in range(n.bit_length()):
        on = state.select(F.col("id").alias("to"), F.col("to").alias("on"), F.col("least").alias("more"))
        met = state.join(on, "to", "left")
        if met.filter("on IS NOT NULL").isEmpty():
            break
        state = cut(met.select("id", F.coalesce("on", "to").alias("to"), F.when(F.col("on").isNull(), F.col("least")).otherwise(F.least("least", "more")).alias("least")))
    # what still ends at a page that moves has walked around a cycle: from a page on it, its least one was met
    on = state.select(F.col("id").alias("to"), F.col("least").alias("end"))
    out = state.join(on, "to", "left").select(F.col("id").alias("from_id"), F.coalesce("end", "to").alias("to_id"))
    return out.filter("from_id <> to_id")


def canonicalize(concepts: DataFrame, moves: DataFrame) -> DataFrame:
    """Concepts after merges (``from_id, to_id``), which may go on from page to page.

    Links, the owner of a record and links in bodies follow to the final page. There tags and
    aliases unite; the body is the page's own or, if only a merged page was verified by a
    human, that page's, and gets the paper links of the others. Merged pages become redirects.
    """
    ends = cut(closure(moves))
    none = F.array().cast("array<string>")
    have = set(concepts.columns)
    opt = lambda c, t: F.col(c) if c in have else F.lit(None).cast(t).alias(c)
    page = concepts.select("id", "type", "title", "status", "outgoing", "tags", "aliases", opt("paper", "string"), opt("body", "string"), opt("verified_human", "boolean"))
    moved = ends.select(F.col("from_id").alias("id"), "to_id")
    out_links = page.select("id", F.posexplode("outgoing").alias("pos", "dst")).join(ends.select(F.col("from_id").alias("dst"), "to_id"), "dst", "left")
    rewritten = out_links.select("id", "pos", F.coalesce("to_id", "dst").alias("dst")).filter("id <> dst").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "dst"))).alias("l"))
    rewritten = rewritten.select("id", F.array_distinct(F.transform("l", lambda x: x.dst)).alias("new_links"))
    bodies = links.rewrite_links(page.select("id", "body"), ends.select(F.col("from_id").alias("old"), F.col("to_id").alias("new"))).withColumnRenamed("body", "new_body")
    owners = ends.select(F.col("from_id").alias("paper"), F.col("to_id").alias("owner"))
    slim = page.drop("body", "outgoing").join(bodies, "id", "left").join(rewritten, "id", "left").join(owners, "paper", "left").withColumn("paper", F.coalesce("owner", "paper"))
    slim = slim.join(moved, "id", "left")
    # what merged pages bring: a row for each target, which its merged pages bound
    row = F.struct(F.col("id"), F.coalesce("verified_human", F.lit(False)).alias("v"), F.coalesce("new_body", F.lit("")).alias("b"), F.coalesce("tags", none).alias("t"), F.concat(F.coalesce("aliases", none), F.array("title")).alias("a"))
    given = slim.filter("to_id IS NOT NULL").groupBy(F.col("to_id").alias("id")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    met = slim.join(given, "id", "left")
    own = F.coalesce("new_body", F.lit(""))
    checked = F.filter("r", lambda x: x.v)
    take = F.col("r").isNotNull() & ((F.coalesce("status", F.lit("")) == "deprecated") | (~F.coalesce("verified_human", F.lit(False)) & (F.size(checked) > 0)))
    base = F.when(take, F.when(F.size(checked) > 0, F.get(checked, F.lit(0)).b).otherwise(F.get("r", F.lit(0)).b)).otherwise(own)
    body = F.aggregate(F.concat(F.transform("r", lambda x: x.b), F.array(own)), base, lambda b, more: compiling.paper_links(more, b))
    titles = page.select(F.col("id").alias("to_id"), F.col("title").alias("to_title"))
    met = met.join(titles, "to_id", "left")
    gone, more = F.col("to_id").isNotNull(), F.col("r").isNotNull()
    redirect = F.concat(F.lit("Moved to ["), F.coalesce("to_title", "to_id"), F.lit("](/"), F.col("to_id"), F.lit(".md).\n"))
    united = lambda own_, new: F.array_distinct(F.concat(F.coalesce(own_, none), F.flatten(F.transform(F.coalesce("r", F.array().cast(given.schema["r"].dataType)), new))))
    aliases = F.filter(united(F.col("aliases"), lambda x: x.a), lambda a: ~more | (text.align_key(a) != text.align_key(F.col("title"))))
    status: Column = F.when(gone, "deprecated").when(more & (F.col("status") == "deprecated"), "stable").otherwise(F.col("status"))
    return met.select(
        "id",
        "type",
        "title",
        status.alias("status"),
        F.when(gone, F.array("to_id")).otherwise(F.coalesce("new_links", none)).alias("outgoing"),
        united(F.col("tags"), lambda x: x.t).alias("tags"),
        aliases.alias("aliases"),
        F.col("to_id").alias("canonical"),
        "paper",
        F.when(gone, redirect).when(more, body).otherwise(F.col("new_body")).alias("body"),
    )
