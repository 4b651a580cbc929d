"""The corpus pipeline: rules, near duplicates, secrets, mixture, packing.

Each stage takes all rows that the one before has kept and returns the columns of
``documents``, its decisions carried out; the last returns the packed pieces. ``run``
writes each stage as Parquet in the shared folder and reads it again for the next.

For all stages: an empty table gives an empty result with the same columns; a null text
counts as an empty one, texts of any length are read whole, repeated rows and null ids are
rows like others unless a stage says more; further columns of the input pass through the
first four stages, whatever their names, and don't take part in the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessellore.llm import minhash, mixing, packing, quality, secret_scan
from tessellore.llm.common import Scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose host does, go.

    A null or empty text fails; a null source is a host of its own; equal rows fare alike.
    """
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the least id.

    Documents without words all stay. Of rows that share an id or are equal one stays, if
    they are near duplicates; a null id comes after all others.
    """
    return minhash.drop_near(docs, minhash.Rule(5, 80))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by markers of their kind; n_chars follows.

    Spans that overlap are masked as one; a null text stays null, and so does its n_chars.
    """
    return secret_scan.redact_secrets(docs, length="n_chars")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document occurs as often as the mix takes it.

    Ties of sampling keys go by id and size; a null source is the last one; a document
    without words has size 0 and fills no budget.
    """
    return mixing.mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in training sequences.

    A null or empty text is one piece, the end token; equal rows are packed once each.
    """
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Secret spans, sampling keys and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
