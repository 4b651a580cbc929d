"""A table of rows by document, kept as segments that are never changed.

A segment has the rows of some documents and, for each document that it adds, changes or
removes, its stamp (none if removed). What a later segment stamps, an earlier one's rows no
longer count for: reading merges them by an anti-join, and the present stamps are the last
ones. A delta writes only its own segment. Then neighbours are merged as long as the older
has less than FAN times the rows and stamps of the newer, so the number of segments grows
with the logarithm of the table, and a row is rewritten about as often.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellore.operators import incremental
from tessellore.storage import cut, sized_broadcast

FAN = 4


def stamp(docs: DataFrame) -> DataFrame:
    """``path, sha256`` of documents (``id, title, body``)."""
    return docs.select(F.col("id").alias("path"), F.sha2(F.concat_ws("\n", "title", "body"), 256).alias("sha256"))


def _part(spark: SparkSession, root: str, held: list[dict], part: str) -> DataFrame | None:
    """A part of all segments with the segment's place in the order."""
    out = None
    for at, s in enumerate(held):
        one = spark.read.parquet(f"{root}/{s['name']}/{part}").withColumn("_at", F.lit(at))
        out = one if out is None else out.unionByName(one)
    return out


def stamps(spark: SparkSession, root: str, held: list[dict]) -> DataFrame:
    """``path, sha256`` of the documents that the segments hold now."""
    every = _part(spark, root, held, "stamps")
    if every is None:
        return spark.createDataFrame([], "path string, sha256 string")
    last = every.groupBy("path").agg(F.max_by("sha256", "_at").alias("sha256"))
    return last.filter("sha256 IS NOT NULL")


def _merged(spark: SparkSession, root: str, held: list[dict]) -> DataFrame:
    """The rows that no later segment has replaced."""
    if len(held) == 1:
        return _part(spark, root, held, "rows").drop("_at")
    later = _part(spark, root, held[1:], "stamps").groupBy(F.col("path").alias("_path")).agg((F.max("_at") + 1).alias("_last"))
    rows = _part(spark, root, held, "rows")
    return rows.join(sized_broadcast(later), (F.col("id") == F.col("_path")) & (F.col("_at") < F.col("_last")), "left_anti").drop("_at")


def live(spark: SparkSession, root: str, held: list[dict]) -> DataFrame:
    """The rows of the table; filters on them reach the files of every segment."""
    return _merged(spark, root, held)


def _write(spark: SparkSession, root: str, rows: DataFrame, stamped: DataFrame, sort: str | None) -> dict:
    """A new segment, named by nobody yet."""
    name = uuid.uuid4().hex
    out = rows if sort is None else rows.repartitionByRange(F.col(sort)).sortWithinPartitions(sort)
    out.write.parquet(f"{root}/{name}/rows")
    stamped.write.parquet(f"{root}/{name}/stamps")
    counts = [spark.read.parquet(f"{root}/{name}/{part}").count() for part in ("rows", "stamps")]
    return {"name": name, "rows": counts[0], "stamps": counts[1]}


def compact(spark: SparkSession, root: str, held: list[dict], sort: str | None) -> list[dict]:
    """The segments with the newest ones merged where they are of about one size."""
    weight = lambda s: s["rows"] + s["stamps"]
    first, total = len(held) - 1, weight(held[-1])
    while first > 0 and weight(held[first - 1]) < FAN * total:
        first -= 1
        total += weight(held[first])
    if first == len(held) - 1:
        return held
    some = held[first:]
    every = _part(spark, root, some, "stamps").groupBy("path").agg(F.max_by("sha256", "_at").alias("sha256"))
    if first == 0:  # nothing older is left for a removal to act on
        every = every.filter("sha256 IS NOT NULL")
    return [*held[:first], _write(spark, root, _merged(spark, root, some), every, sort)]


def extend(spark: SparkSession, root: str, held: list[dict], docs: DataFrame, build: Callable[[DataFrame], DataFrame], sort: str | None = None) -> list[dict]:
    """The segments after ``docs``; the same ones if no document has changed."""
    delta = incremental.changes(stamp(docs), stamps(spark, root, held)).filter("change <> 'same'")
    delta = cut(delta)
    if held and delta.isEmpty():
        return held
    fresh = delta.filter("change <> 'removed'").select(F.col("path").alias("id"))
    changed = cut(docs.join(fresh, "id", "left_semi"))
    gone = delta.filter("change = 'removed'").select("path", F.lit(None).cast("string").alias("sha256"))
    new = _write(spark, root, build(changed), stamp(changed).unionByName(gone), sort)
    return compact(spark, root, [*held, new], sort)
