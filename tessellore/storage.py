"""Cuts lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """``spark.checkpoint.dir`` as the session has it; only a local session without one gets a temporary folder."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named or context._jsc.sc().getCheckpointDir().isDefined():
        return
    if context.master.startswith("local[") or context.master == "local":
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessellore-"))
    else:
        fs = context._jvm.org.apache.hadoop.fs.FileSystem.get(context._jsc.hadoopConfiguration())
        context.setCheckpointDir(f"{fs.getHomeDirectory().toString()}/.tessellore")


#: Tables that this process has written to cut lineage.
_MADE: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(frame: DataFrame) -> DataFrame:
    """The frame, computed once and kept as a Parquet table in the shared folder: columns that nobody reads are pruned."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/tessellore-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    _MADE.append(path)
    return spark.read.schema(frame.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Removes the tables that this process has written, once the results that read them are written; says how many."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _MADE:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    n = len(_MADE)
    _MADE.clear()
    return n


#: Rows of a side that may be sent to all executors; beyond it the join shuffles.
BROADCAST_ROWS = 50_000


def sized_broadcast(frame: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The frame with a broadcast hint only if a count of at most ``limit`` + 1 rows shows it small."""
    return F.broadcast(frame) if frame.limit(limit + 1).count() <= limit else frame
