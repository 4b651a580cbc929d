"""Exact best hits without reading everything: bounds first, then only what can still win.

Postings lie in blocks of documents; for each token and block a slim table has what one
document can get at most. Vectors lie in cells around centroids; a cell's widest angle to
its centroid bounds every similarity in it. Both searches read the most promising parts,
take the score of the last hit so far, and then read only parts whose bound reaches it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellore import schema
from tessellore.functions import text
from tessellore.operators import search
from tessellore.storage import cut, sized_broadcast

#: Documents of a block about, blocks and cells that are read first.
BLOCK_DOCS, FIRST_BLOCKS, FIRST_CELLS = 16, 48, 2
#: Vectors that centroids are fitted on at most; every vector is assigned.
FIT_VECTORS = 20_000


def _weight(in_title: Column) -> Column:
    return F.when(F.length("token") >= 2, 2).otherwise(1) * F.coalesce("idf", F.lit(1.0)) * F.when(in_title, 3).otherwise(1)


def blocked(postings: DataFrame, n_docs: int, block_docs: int = BLOCK_DOCS) -> tuple[DataFrame, DataFrame]:
    """Postings with the block of their document, and ``token, block, df, in_title`` of each token in each block.

    Both are to be saved sorted by token and block, so that reading a block skips the rest.
    """
    blocks = max(1, math.ceil(n_docs / block_docs))
    dealt = postings.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    return dealt, dealt.groupBy("token", "block").agg(F.count(F.lit(1)).alias("df"), F.max("in_title").alias("in_title"))


def top_documents(dealt: DataFrame, bounds: DataFrame, n_docs: int, query: str, most: int = schema.CAPS["index_hits"]) -> tuple[DataFrame, DataFrame]:
    """``id, score`` of the best hits, as ``search.fts_search`` has them, and the postings that were read."""
    met = cut(search.matched_postings(bounds, query))
    stats = cut(met.groupBy("token").agg(F.sum("df").alias("df")).withColumn("idf", F.log((F.lit(n_docs) + 1) / (F.col("df") + 1)) + 1))
    few = sized_broadcast(stats.select("token", "idf"))
    best = cut(met.join(few, "token").groupBy("block").agg(F.sum(_weight(F.col("in_title"))).alias("bound")))

    def read(blocks: DataFrame) -> DataFrame:
        return cut(search.matched_postings(dealt, query).join(sized_broadcast(blocks.select("block")), "block", "left_semi"))

    def scores(rows: DataFrame) -> DataFrame:
        return rows.join(few, "token").groupBy("id").agg(F.sum(_weight(F.col("in_title"))).alias("score"))

    ranked = lambda frame: frame.orderBy(F.round("score", 6).desc(), "id").limit(most)
    first = cut(best.orderBy(F.col("bound").desc(), "block").limit(FIRST_BLOCKS))
    rows = read(first)
    last = [r.score for r in ranked(scores(rows)).collect()]  # the cap's number of rows
    floor = round(last[-1], 6) - 1e-6 if len(last) == most else -1.0  # scores compare rounded
    more = best.filter(F.col("bound") >= floor).join(first.select("block"), "block", "left_anti")
    rows = rows.unionByName(read(more))
    return ranked(scores(rows)), rows


def celled(chunks: DataFrame, cells: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Chunks (``source_id, embedding``) with their cell, and ``cell, centre, angle`` of the cells.

    Centroids are fitted on at most FIT_VECTORS vectors; ``angle`` is the widest one between
    a centroid and a vector of its cell. A vector without a direction is in cell -1, which
    every search reads. The chunks are to be saved partitioned by cell.
    """
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    unit = chunks.withColumn("v", F.coalesce(F.col("embedding").cast("array<double>"), F.array().cast("array<double>"))).withColumn("n", norm)
    unit = unit.withColumn("v", F.transform("v", lambda x: x / F.col("n")))
    sound = F.coalesce(F.col("n") > 0, F.lit(False)) & ~F.isnan("n") & (F.col("n") < float("inf"))
    good = cut(unit.filter(sound).withColumn("features", array_to_vector("v")))
    flat = unit.filter(~sound)
    n = good.count()
    if not n:
        return flat.select(*chunks.columns, F.lit(-1).alias("cell")), chunks.sparkSession.createDataFrame([], "cell int, centre array<double>, angle double")
    sample = good if n <= FIT_VECTORS else good.orderBy(F.xxhash64("v")).limit(FIT_VECTORS)
    model = KMeans(k=max(2, min(cells, n)), seed=seed, distanceMeasure="cosine", maxIter=8, predictionCol="cell").fit(sample.select("features"))
    made = [(i, [float(x) / (sum(float(y) ** 2 for y in c) ** 0.5 or 1.0) for x in c]) for i, c in enumerate(model.clusterCenters())]
    centres = chunks.sparkSession.createDataFrame(made, "cell int, centre array<double>")
    dealt = cut(model.transform(good).select(*chunks.columns, "v", "cell"))
    dot = F.aggregate(F.zip_with("v", "centre", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    wide = dealt.join(F.broadcast(centres), "cell").groupBy("cell").agg(F.max(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot)))).alias("angle"))
    return dealt.drop("v").unionByName(flat.select(*chunks.columns, F.lit(-1).alias("cell"))), centres.join(wide, "cell")


def top_sources(dealt: DataFrame, cells: DataFrame, query: Sequence[float], most: int = schema.CAPS["index_hits"]) -> tuple[DataFrame, list[int]]:
    """``id, score`` of the best sources, as ``search.vector_search`` has them, and the cells that were read."""
    size = sum(x * x for x in query) ** 0.5
    if not size or not math.isfinite(size):
        return search.vector_search(dealt, query, most), [r.cell for r in cells.select("cell").collect()]
    bounds = {}
    for r in cells.collect():  # centroids, whose number the library sets
        near = sum(x * y for x, y in zip(r.centre, query, strict=True)) / size
        away = math.acos(max(-1.0, min(1.0, near)))
        bounds[r.cell] = math.cos(max(0.0, away - r.angle - 1e-7))
    order = sorted(bounds, key=lambda c: (-bounds[c], c))
    first = order[:FIRST_CELLS]
    found = search.vector_search(dealt.filter(F.col("cell").isin(-1, *first)), query, most).collect()
    floor = round(found[-1].score, 6) - 1e-6 if len(found) == most else -2.0
    read = first + [c for c in order[FIRST_CELLS:] if bounds[c] >= floor]
    return search.vector_search(dealt.filter(F.col("cell").isin(-1, *read)), query, most), sorted(read)
