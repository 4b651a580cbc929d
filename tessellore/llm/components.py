"""Connected components by alternating stars, wholly as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One star operation: every node hands its (larger or smaller) neighbours its least one."""
    if large:
        seen = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        seen = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = seen.join(least, "u")
    if large:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node on an edge (``u``, ``v``); the root is the least node reachable.

    Rounds of a large and a small star, each written out, until a round changes nothing;
    their number grows with the logarithm of the longest path. No neighbourhood is ever
    gathered: a node's least neighbour is a pre-aggregated minimum.
    """
    scratch = Scratch(edges.sparkSession)
    now = scratch.keep(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:  # every round that changes something lowers a node's neighbour, so this ends
        after = scratch.keep(_star(_star(now, True), False))
        seen = after.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        scratch.drop(now)
        now = after
        if seen == state:
            break
        state = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
