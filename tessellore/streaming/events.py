"""Event-time aggregates and keyed state, the same plans for tables and streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessellore.storage import shared_folder


def hourly(events: DataFrame) -> DataFrame:
    return events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("begun"), "n")


def _places(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tessellore-stream-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A file stream with the table's own schema."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).parquet(f"{folder}/{name[:-1]}[{name[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


def _sink(place: str) -> Callable[[DataFrame, int], None]:
    """Each micro-batch is a folder of its number, so one that is run again replaces itself."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    return save


def _latest(spark: SparkSession, place: str, keys: list[str], like: DataFrame) -> DataFrame:
    """The last state of each key over all batches; ``like`` gives the columns."""
    rest = [c for c in like.columns if c not in keys]
    got = spark.read.schema(f"{_ddl(like)}, batch long").parquet(f"{place}/out")
    return got.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("s")).select(*keys, *[F.col(f"s.{c}").alias(c) for c in rest])


def _ddl(frame: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in frame.dtypes)


def _local_times(frame: DataFrame) -> DataFrame:
    return frame.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in frame.dtypes if kind == "timestamp"})


def run_to_end(spark: SparkSession, path: str, plan: Callable[[DataFrame], DataFrame], keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Runs a windowed plan over a file stream until it has read everything; results are upserted by ``keys``.

    Updates only: a batch writes the groups that it changed, and the watermark lets the
    state of windows go that no event in time can reach. Events without a time are in no
    window.
    """
    place = _places(spark)
    planned = plan(read_stream(spark, path).withWatermark("ts", late))
    query = planned.writeStream.outputMode("update").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(_sink(place)).start()
    query.awaitTermination()
    return _local_times(_latest(spark, place, keys, planned))


STATE = "n_events bigint, last_ts timestamp"


def keep_state(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Counts a user's events and keeps the last time; events out of order or without a time only count."""
    n, last = state.get if state.exists else (0, None)
    for batch in rows:
        n += len(batch)
        newest = batch["ts"].max()
        if not pd.isna(newest):
            newest = newest.to_pydatetime()
            last = newest if last is None or newest > last else last
    state.update((n, last))
    yield pd.DataFrame({"user_id": [key[0]], "n_events": [n], "last_ts": pd.Series([last], dtype="datetime64[ns]")})


def run_state(spark: SparkSession, path: str) -> DataFrame:
    """The state of each user after the stream's end."""
    place = _places(spark)
    stream = read_stream(spark, path).select("user_id", "ts")
    kept = stream.groupBy("user_id").applyInPandasWithState(keep_state, f"user_id bigint, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)
    query = kept.writeStream.outputMode("update").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(_sink(place)).start()
    query.awaitTermination()
    return _local_times(_latest(spark, place, ["user_id"], kept))


# documents under way ------------------------------------------------------------------
#: The steps of a document's pipeline and what each may lead to.
STEPS = {
    "queued": ("extracting", "failed"),
    "extracting": ("compiling", "needs_vision", "failed"),
    "needs_vision": ("awaiting_vision", "failed"),
    "awaiting_vision": ("extracting_vision", "failed"),
    "extracting_vision": ("awaiting_vision", "compiling", "failed"),
    "compiling": ("done", "compile_failed"),
    "failed": ("queued",),
    "compile_failed": ("compiling", "queued"),
    "done": ("queued",),
}
DOCUMENT = "status string, pages_left array<int>, error string, n_refused long"


def advance(status: str | None, left: list[int], event: tuple[str, list[int] | None, str | None]) -> tuple[str | None, list[int], str | None, bool]:
    """One step of a document: (status, pages left, error, whether the event was refused).

    An event names the next status, pages and an error. A plan of pages comes with
    ``needs_vision``; pages that come with ``awaiting_vision`` are done, so a document that
    begins again goes on with those left. Compiling may begin only when none is left.
    """
    to, pages, error = event
    if status is None:
        return (to, [], None, False) if to == "queued" else (None, left, None, True)
    if to not in STEPS.get(status, ()):
        return status, left, None, True
    if to == "needs_vision":
        left = sorted(set(pages or []))
    elif to == "awaiting_vision" and pages:
        left = [p for p in left if p not in set(pages)]
    elif to == "compiling" and left:
        return status, left, None, True
    elif to == "queued" and status == "done":
        left = []
    return to, left, error if to in ("failed", "compile_failed") else None, False


def keep_documents(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A document's state after its events (``seq, status, pages, error``) in the order of ``seq``; refused ones are counted."""
    status, left, error, refused = state.get if state.exists else (None, [], None, 0)
    left = list(left or [])
    events = pd.concat(list(rows)).sort_values("seq")
    for to, pages, why in zip(events["status"], events["pages"], events["error"], strict=True):
        status, left, now, no = advance(status, left, (to, None if pages is None else [int(p) for p in pages], why))
        error, refused = (error if no else now), refused + int(no)
    state.update((status, left, error, refused))
    yield pd.DataFrame({"path": [key[0]], "status": [status], "pages_left": [left], "error": [error], "n_refused": [refused]})


def follow_documents(events: DataFrame) -> DataFrame:
    """The state of each document (``path``) of a stream of events."""
    return events.select("path", "seq", "status", "pages", "error").groupBy("path").applyInPandasWithState(keep_documents, f"path string, {DOCUMENT}", DOCUMENT, "update", GroupStateTimeout.NoTimeout)


def run_documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Document states after a stream over the Parquet files of a folder has been read to its end."""
    place = _places(spark)
    kept = follow_documents(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))
    query = kept.writeStream.outputMode("update").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(_sink(place)).start()
    query.awaitTermination()
    return _latest(spark, place, ["path"], kept)
