"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources share the corpus by weight; what a source can't supply in its allowed epochs is
reshared among the others. A source takes its documents whole for each complete epoch of
its target and, for what remains, in the order of exponential keys -ln(u) / quality, u a
hash of the document: heavier documents come sooner, reruns agree. What the last whole
document of that order leaves open is closed by up to FILLERS more: the largest that fit
and, at last, the one that ends nearest.

No source is ever sorted in one task. Keys fall into BINS bins; the sums of a source's
bins (a small table, pre-aggregated before the shuffle) say in which bin the budget ends,
bins before it are taken whole, and only that bin's documents are sorted.

Edge cases: a null or empty text has size 0; a null source is a source of its own and
ranks last; repeated rows are rows of their own, and ties of keys break by id and size;
an empty table gives an empty result; a corpus without words takes nothing; other columns
of the input pass through ``mix`` untouched, as each row travels as one struct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, join_small, word_count

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
BINS = 4096
#: Documents that may close what the prefix of a source leaves open.
FILLERS = 4
SEED = 20_240_601


def default_quality(text: Column, size: Column) -> Column:
    """A weight from 0.5 to 1: texts whose words have about the usual length weigh more."""
    per_word = F.length(text) / F.greatest(size, F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.5), 1.0 - F.abs(per_word - 6.5) / 20.0), F.lit(0.5))


def sampling_key(identity: Sequence[Column], quality: Column) -> Column:
    """-ln(u) / quality for u in (0, 1) from a hash."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *identity), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / quality


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank``, from 0 in code point order, null last.

    Sources are dealt by ranges; a part's own order and the sizes of the parts before it
    give the rank, so no task sorts them all.
    """
    scratch = Scratch(sources.sparkSession)
    dealt = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    dealt = scratch.keep(dealt)
    before, offsets = 0, []
    for row in sorted(dealt.groupBy("part").count().collect()):  # a row a partition
        offsets.append((row.part, before))
        before += row["count"]
    table = sources.sparkSession.createDataFrame(offsets, "of int, before bigint")
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return dealt.withColumn("own", own).join(F.broadcast(table), F.col("part") == F.col("of")).withColumn("rank", F.col("before") + F.col("own") - 1).drop("part", "own", "of", "before")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size`` with each source's rank, weight and target.

    All excess is reshared by weight until no target is above its bound. Each pass is one
    aggregate of exact integers, and a pass that bounds no further source is the last.
    """
    exact = lambda c: c.cast("decimal(19,0)")  # noqa: E731  # products of two are exact
    weighed = ranked(sources).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    weighed = weighed.withColumn("bound", exact(F.col("source_size")) * exact(F.lit(epochs)))
    kept = Scratch(sources.sparkSession).keep(weighed)
    total = int(kept.agg(F.sum(exact(F.col("source_size"))).alias("t")).first().t or 0)
    left, share = total, int(kept.agg(F.sum("weight").alias("w")).first().w or 1)
    bounded = F.lit(False)
    while True:
        now = exact(F.col("bound")) * exact(F.lit(share)) <= exact(F.col("weight")) * exact(F.lit(left))
        full = kept.filter(now).agg(F.sum("bound").alias("b"), F.sum("weight").alias("w")).first()
        bounded = now
        rest = kept.filter(~now).agg(F.sum("weight").alias("w")).first().w
        new_left, new_share = total - int(full.b or 0), int(rest or 0)
        if not rest or (new_left, new_share) == (left, share):
            break
        left, share = new_left, new_share
    target = F.when(bounded, F.col("bound").cast("double")).otherwise(F.col("weight") * F.lit(float(left)) / F.lit(float(share)))
    return kept.withColumn("target", target)


def mix(docs: DataFrame, *, text: str = "text", source: str = "source", identity: str = "doc_id", weights: Sequence[int] = WEIGHTS, epochs: int = MAX_EPOCHS, quality: Column | None = None, carry: Sequence[str] | None = None) -> DataFrame:
    """Every row of ``docs`` as the struct ``row`` with its size, its source's figures, ``copies``, how often the mix takes it, and ``filler``.

    A filler, of which a source has at most FILLERS, is taken for its size and not by its key.

    ``carry`` names the columns of the struct; all of them unless given.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    columns = docs.columns if carry is None else list(carry)
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{source}`").alias("source"), F.col(f"`{identity}`").alias("id"), word_count(F.col(f"`{text}`")).alias("size"), F.col(f"`{text}`").alias("text"))
    weight = default_quality(F.col("text"), F.col("size")) if quality is None else quality
    keyed = sized.select("row", "source", "id", "size", sampling_key([F.col("id"), F.col("size")], weight).alias("key"))
    keyed = keyed.withColumn("bin", F.floor((1 - F.exp(-F.col("key"))) * BINS).cast("int"))
    keyed = scratch.keep(keyed.withColumn("uid", F.monotonically_increasing_id()))
    bins = keyed.groupBy("source", "bin").agg(F.sum("size").alias("in_bin"))
    bins = scratch.keep(bins)
    goal = scratch.keep(targets(bins.groupBy("source").agg(F.sum("in_bin").alias("source_size")), weights, epochs))
    n_sources = goal.count()
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(epochs))).otherwise(0).cast("int"))
    goal = goal.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    # where the budget of a source ends: the first bin whose running sum passes it
    running = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    before = bins.select("source", "bin", "in_bin", F.coalesce(F.sum("in_bin").over(running), F.lit(0)).alias("before"))
    side = goal.select(F.col("source").alias("of"), "source_size", "target", "whole", "budget")
    ends = join_small(before, side, F.col("source").eqNullSafe(F.col("of")), "inner", rows=n_sources).filter((F.col("before") <= F.col("budget")) & (F.col("before") + F.col("in_bin") > F.col("budget")))
    ends = ends.groupBy("of").agg(F.min("bin").alias("end_bin"), F.min("before").alias("before"))
    plan = scratch.keep(side.join(ends.withColumnRenamed("of", "to"), F.col("of").eqNullSafe(F.col("to")), "left").drop("to"))
    joined = join_small(keyed, plan, F.col("source").eqNullSafe(F.col("of")), "left", rows=n_sources).drop("of")
    end = F.coalesce(F.col("end_bin"), F.lit(BINS))
    outside = joined.filter(F.col("bin") != end).withColumn("part", F.col("bin") < end)
    order = Window.partitionBy("source").orderBy("key", "id", "size", "uid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = joined.filter(F.col("bin") == end).withColumn("part", F.col("before") + F.sum("size").over(order) <= F.col("budget"))
    every = outside.unionByName(inside)
    # what the prefix leaves open is closed by the largest documents that fit, at last by the one that ends nearest
    slim = scratch.keep(every.select("source", "size", "key", "id", "uid", "part", "budget"))
    gaps = slim.groupBy("source").agg(F.max("budget") - F.sum(F.when(F.col("part"), F.col("size")).otherwise(0))).toDF("gap_of", "gap")
    gaps, last = scratch.keep(gaps.filter("gap > 0")), None
    rest = slim.filter(~F.col("part") & (F.col("size") > 0))
    off = F.abs(F.col("gap") - F.col("size"))
    for turn in range(FILLERS):
        free = rest if last is None else join_small(rest, last, F.col("uid") == F.col("last_uid"), "left_anti", rows=FILLERS * n_sources)
        met = join_small(free, gaps, F.col("source").eqNullSafe(F.col("gap_of")), "inner", rows=n_sources)
        fits = met.filter(F.col("size") <= F.col("gap") if turn < FILLERS - 1 else off < F.col("gap"))
        best = fits.groupBy(F.col("source").alias("of")).agg(F.min(F.struct(off.alias("off"), "key", "id", "size", "uid")).alias("m"))
        found = join_small(gaps, best, F.col("gap_of").eqNullSafe(F.col("of")), "left", rows=n_sources)
        found = scratch.keep(found.select("gap_of", (F.col("gap") - F.coalesce("m.size", F.lit(0))).alias("gap"), F.col("m.uid").alias("last_uid")))
        picked = found.filter("last_uid is not null").select("last_uid")
        last = picked if last is None else last.unionByName(picked)
        gaps = found.filter("gap > 0").select("gap_of", "gap")
    chosen = join_small(every, last, F.col("uid") == F.col("last_uid"), "left", rows=FILLERS * n_sources)
    partial = (F.col("part") | F.col("last_uid").isNotNull()) & (F.col("budget") > 0) & (F.col("whole") < epochs)
    out = chosen.withColumn("copies", F.col("whole") + partial.cast("int")).withColumn("filler", partial & ~F.col("part"))
    return out.select("row", "size", "source_size", "target", "copies", "filler")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken."""
    return mix(docs, **options).filter("copies > 0").select(F.col("row"), F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def mix_report(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    out = mix(docs.select("doc_id", "source", "text"), carry=["doc_id", "source"])
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies", "filler")
