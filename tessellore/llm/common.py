"""Shared plumbing of the training-data operators.

Tables are always read through Spark's own readers, and every intermediate that cuts
lineage is a Parquet table in the folder that the cluster names in
``spark.checkpoint.dir``, so it outlives the executor that wrote it.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators: space and the ASCII controls from tab to carriage return.
WORD_GAP = "\\x20\\x09-\\x0D"
BLANKS = " \t\n\x0b\f\r"
#: Rows of a table that may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Bytes of a table with arrays that may be broadcast, and what a row counts without them.
BROADCAST_BYTES, ROW_BYTES = 128 << 20, 80


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    ``spark.checkpoint.dir`` if the session has it. Only a local session without it gets
    a temporary folder; a cluster session without it uses the file system's home.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    chosen = context._jsc.sc().getCheckpointDir()
    if chosen.isDefined():
        return chosen.get()
    if context.master.startswith("local[") or context.master == "local":
        named = tempfile.mkdtemp(prefix="tessellore-")
    else:
        fs = context._jvm.org.apache.hadoop.fs.FileSystem.get(context._jsc.hadoopConfiguration())
        named = f"{fs.getHomeDirectory().toString()}/.tessellore"
    context.setCheckpointDir(named)
    return named


#: What an Arrow batch holds at most, so that a worker's memory follows neither the number of rows nor the longest texts.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bounds the Arrow batches of what runs inside; the session's own settings return afterwards."""
    before = {k: spark.conf.get(k, None) for k in ARROW_BATCH}
    for k, v in ARROW_BATCH.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def release() -> None:
    """Gives the memory that a Python worker no longer uses back to the system, as workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not this C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A batch function that releases its worker's memory at its end."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


class Scratch:
    """Intermediate tables of one operator call, in the shared folder."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tessellore-{uuid.uuid4().hex}"
        self.made = 0

    def keep(self, frame: DataFrame, *, max_file_rows: int = 0) -> DataFrame:
        """Write the frame and read it back: its lineage ends here."""
        self.made += 1
        path = f"{self.root}/{self.made}"
        writer = frame.write
        if max_file_rows:
            writer = writer.option("maxRecordsPerFile", max_file_rows)
        with small_batches(self.spark):
            writer.parquet(path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        out._tl_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for frame in frames:
            path = jvm.org.apache.hadoop.fs.Path(frame._tl_path)
            path.getFileSystem(conf).delete(path, True)


def join_small(big: DataFrame, small: DataFrame, on: Column, how: str = "left", *, rows: int | None = None, limit: int = BROADCAST_ROWS, array_bytes: Column | None = None) -> DataFrame:
    """Join with a table that is broadcast only if it is shown to be small.

    It may have ``limit`` rows or, with ``array_bytes`` (of a row), BROADCAST_BYTES by sum. Beyond that it is an ordinary shuffled join, whose hot keys adaptive
    execution splits.
    """
    if array_bytes is not None:
        n, more = small.agg(F.count(F.lit(1)), F.sum(array_bytes)).first()
        fits = ROW_BYTES * n + (more or 0) <= BROADCAST_BYTES
    else:
        fits = (small.count() if rows is None else rows) <= limit
    return big.join(F.broadcast(small) if fits else small, on, how)


def word_count(text: Column) -> Column:
    """Words of a text, as a long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WORD_GAP}]+")), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]
