"""Numbers within groups and unique names, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellore.storage import cut


def rank_within(frame: DataFrame, group: str, order: str, into: str = "k") -> DataFrame:
    """``frame`` with the place of each row, from 1, in the ``order`` of its ``group``.

    Rows are dealt by ranges of group and order, so a large group spreads over many tasks;
    a row's place is the one in its part, after the sizes of its group's earlier parts.
    """
    dealt = cut(frame.repartitionByRange(F.col(group), F.col(order)).withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy(group, "part").agg(F.count(F.lit(1)).alias("n"))
    # one row for each part that a group lies in; only groups over several parts have any before
    running = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("before", F.sum("n").over(running)).filter("before is not null").select(F.col(group).alias("of"), F.col("part").alias("at"), "before")
    own = F.row_number().over(Window.partitionBy(group, "part").orderBy(order))
    met = dealt.withColumn("own", own).join(before, F.col(group).eqNullSafe(F.col("of")) & (F.col("part") == F.col("at")), "left")
    return met.withColumn(into, F.coalesce("before", F.lit(0)) + F.col("own")).drop("part", "own", "of", "at", "before")


def unique_names(wanted: DataFrame, taken: DataFrame, glue: str = "-") -> DataFrame:
    """``id, base, name``: each wanted ``base``, or the first of base-2, base-3, ... that is free, in the order of ids.

    ``taken`` (``name``) holds names that none may get. Where a numbered name is also what
    another base wants, the least id gets it and the others' base goes on without it, round
    by round, until no name repeats.
    """
    names = cut(taken.select("name").distinct())
    ranked = cut(rank_within(wanted.select("id", "base"), "base", "id"))
    blocked = None if names.isEmpty() else cut(_blocked(names, glue).join(wanted.select("base").distinct(), "base", "left_semi").distinct())
    settled = None
    while True:
        numbered = _numbered(ranked, blocked)
        made = numbered.select("id", "base", "k", "n", F.concat("base", F.when(F.col("n") > 1, F.concat(F.lit(glue), F.col("n").cast("string"))).otherwise("")).alias("name"))
        named = cut(made if settled is None else made.unionByName(settled))
        twice = named.groupBy("name").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("winner")).filter("c > 1")
        losers = cut(named.join(twice, "name").filter("id <> winner").select("base", "n").distinct())
        if losers.isEmpty():
            return named.select("id", "base", "name")
        # only bases that lost a name are numbered anew
        again = losers.select("base").distinct()
        blocked = cut(losers if blocked is None else blocked.unionByName(losers).distinct())
        settled = named.join(again, "base", "left_anti")
        ranked = cut(named.join(again, "base", "left_semi").select("id", "base", "k"))


def _numbered(ranked: DataFrame, blocked: DataFrame | None) -> DataFrame:
    """``id, base, k, n``: the ``k``-th free number of each base, whose ``blocked`` numbers (``base, n``) none gets.

    The i-th blocked number leaves n - i free ones before it. Among a base's places k and
    these counts, in one order, the k-th place stands where its number is: as many blocked
    numbers are before it as counts are less than k.
    """
    if blocked is None:
        return ranked.withColumn("n", F.col("k").cast("long"))
    busy = blocked.select("base").distinct()
    left = rank_within(blocked, "base", "n", "i").select("base", F.struct((F.col("n") - F.col("i")).alias("v"), F.lit(1).alias("kind")).alias("o"), F.lit(None).cast(ranked.schema["id"].dataType).alias("id"))
    rows = ranked.join(busy, "base", "left_semi").select("base", F.struct(F.col("k").cast("long").alias("v"), F.lit(0).alias("kind")).alias("o"), "id")
    placed = rank_within(rows.unionByName(left), "base", "o", "n").filter("o.kind = 0").select("id", "base", F.col("o.v").alias("k"), F.col("n").cast("long").alias("n"))
    return placed.unionByName(ranked.join(busy, "base", "left_anti").select("id", "base", F.col("k").cast("long").alias("k"), F.col("k").cast("long").alias("n")))


def _blocked(names: DataFrame, glue: str) -> DataFrame:
    """``base, n`` of all ways in which a name may be a base with a number."""
    pattern = rf"^(.*){glue}([1-9][0-9]*)$"
    if glue:
        split = F.array(F.struct(F.regexp_extract("name", pattern, 1).alias("base"), F.regexp_extract("name", pattern, 2).try_cast("long").alias("n")))
    else:  # any split of the digits at the end
        digits = F.length(F.regexp_extract("name", "([0-9]*)$", 1))
        at = F.when(digits > 0, F.sequence(F.lit(1), digits)).otherwise(F.array().cast("array<int>"))
        split = F.transform(at, lambda d: F.struct(F.expr("name").substr(F.lit(1), F.length("name") - d).alias("base"), F.expr("name").substr(F.length("name") - d + 1, d).try_cast("long").alias("n")))
        split = F.filter(split, lambda s: s.n.cast("string") == F.expr("name").substr(F.length("name") - F.length(s.n.cast("string")) + 1, F.length(s.n.cast("string"))))
    whole = names.select(F.col("name").alias("base"), F.lit(1).cast("long").alias("n"))
    parts = names.select(F.explode(split).alias("s")).select("s.base", "s.n").filter("base <> '' and n >= 2")
    return whole.unionByName(parts)
