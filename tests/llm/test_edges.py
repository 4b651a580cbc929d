"""Every query on documents and every stage: nulls, repeated rows, clashing columns, empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessellore.llm.queries import QUERIES

SHAPE = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards make toxic brew for the queen of spades"
#: Names that the operators use for their own columns.
CLASHES = ("row", "t", "w", "h", "k", "n", "at", "did", "place", "places", "gone", "node", "size", "key", "uid", "pair", "pairs", "piece", "m", "f", "phrase", "hashes", "copies", "target", "kept", "start", "end", "spans", "licences", "n_words", "host", "found", "of", "hash", "h1", "h2")


def rows():
    out = [(k, f"{PROSE} {k} " + " ".join(f"w{k * j % 97}" for j in range(30)), "en", f"s{k % 3}", 10) for k in range(12)]
    out += [(20, None, None, None, None), (21, "", "en", "s0", 0), (22, " \t\n", "fr", "s1", 3), (None, PROSE, "en", "s0", 5), (None, PROSE, "en", "s0", 5), (3, out[3][1], "en", "s0", 10), (23, "x" * 60_000, "en", None, 1), (24, f'password = "Zx81kQ0v7TpLm3"\nReleased under the MIT License.\n{PROSE}', "en", "s2", 9)]
    return out


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    made = {}
    plain = spark.createDataFrame(rows(), SHAPE)
    wide = plain.select("*", *[F.lit("1").alias(c) for c in CLASHES])
    for name, frame in (("plain", plain), ("wide", wide), ("empty", plain.limit(0)), ("empty wide", wide.limit(0))):
        made[name] = str(tmp_path_factory.mktemp("edges") / name.replace(" ", "-"))
        frame.write.parquet(f"{made[name]}/documents.parquet")
    return made


def all_rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(("op9_", "op10_"))])
def test_columns_of_clashing_names_change_nothing(spark, folders, name):
    got, want = QUERIES[name](spark, folders["wide"]), QUERIES[name](spark, folders["plain"])
    drop = [c for c in want.columns if c == "sequence_id" or c == "offset"] if name.startswith("op4") else []
    assert got.columns == want.columns and all_rows(got.drop(*drop)) == all_rows(want.drop(*drop))
    empty = QUERIES[name](spark, folders["empty wide"])
    assert empty.columns == want.columns and empty.collect() == []


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_take_any_columns_and_no_rows(spark, folders, stage):
    name, run = corpus_pipeline.STAGES[stage]
    last = stage == len(corpus_pipeline.STAGES) - 1
    wide, plain, empty = (spark.read.parquet(f"{folders[f]}/documents.parquet") for f in ("wide", "plain", "empty wide"))
    got, want = run(spark, wide, folders["wide"]), run(spark, plain, folders["plain"])
    assert run(spark, empty, folders["empty wide"]).collect() == []
    if last:
        assert got.columns == want.columns and got.count() == want.count() and got.filter("piece = 0").count() == plain.count()
    else:
        assert got.columns == wide.columns and want.columns == plain.columns
        assert all_rows(got.select(*plain.columns)) == all_rows(want)
