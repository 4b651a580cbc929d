"""Change detection and delta refresh without a table format."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellore.operators import search


#: The statuses of a document that is under way.
RUNNING = ("queued", "extracting", "extracting_vision", "awaiting_vision", "compiling")


def changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """``path, change`` of stamps (``path, sha256``): new, changed, removed or same."""
    a = now.select("path", F.col("sha256").alias("a"))
    b = before.select("path", F.col("sha256").alias("b"))
    kind = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("same")
    return a.join(b, "path", "full_outer").select("path", kind.alias("change"))


def refresh_postings(postings: DataFrame, docs: DataFrame, delta: DataFrame) -> DataFrame:
    """The postings after a delta: those of changed and removed ids go, those of new and changed ids come."""
    stale = delta.filter(F.col("change").isin("changed", "removed")).select(F.col("path").alias("id"))
    fresh = delta.filter(F.col("change").isin("new", "changed")).select(F.col("path").alias("id"))
    kept = postings.join(stale, "id", "left_anti").select("token", "id", "in_title")
    return kept.unionByName(search.build_postings(docs.join(fresh, "id", "left_semi")).select("token", "id", "in_title"))


def refresh_vectors(chunks: DataFrame, fresh: DataFrame, delta: DataFrame, model: str) -> DataFrame:
    """Chunks after a delta; a chunk of another model never survives."""
    stale = delta.filter(F.col("change").isin("changed", "removed")).select(F.col("path").alias("source_id"))
    kept = chunks.filter(F.col("model") == model).join(stale, "source_id", "left_anti")
    return kept.unionByName(fresh.filter(F.col("model") == model).select(kept.columns))


def latest_state(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last record of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order]))
    return log.withColumn("n", place).filter("n = 1").drop("n")


def to_compile(files: DataFrame, state: DataFrame, version: int) -> DataFrame:
    """``path, reason``: files whose content or compile version the state doesn't have."""
    met = files.select("path", "sha256").join(state.select("path", F.col("sha256").alias("old"), F.col("version")), "path", "left")
    reason = F.when(F.col("old").isNull(), "new").when(F.col("old") != F.col("sha256"), "content").when(F.coalesce("version", F.lit(0)) < version, "version")
    return met.select("path", reason.alias("reason")).filter("reason is not null")


def missing_stages(done: DataFrame, required: list[str]) -> DataFrame:
    """``path, missing``: what is left of the required stages; none left means skip."""
    return done.select("path", F.array_except(F.array(*map(F.lit, required)), F.col("stages")).alias("missing"))


def process_status(state: DataFrame) -> DataFrame:
    """``path, shown``: what a pipeline status means to a reader."""
    shown = F.when(F.col("status").isNull(), "imported").when(F.col("status") == "done", "ok").when(F.col("status").isin(*RUNNING), "running").otherwise("failed")
    return state.select("path", "status", shown.alias("shown"))
