"""Line dedup against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessellore.llm import common, line_dedup

SCHEMA = "doc_id bigint, text string"
BLANKS = " \t\n\x0b\f\r"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows, min_docs=10, min_chars=1):
    split = [(i, (t or "").split("\n")) for i, t in rows]
    seen = {}
    for n, (_, lines) in enumerate(split):
        for k in {key_of(x) for x in lines}:
            seen.setdefault(k, set()).add(n)
    common_keys = {k for k, v in seen.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for i, lines in split:
        rest = [x for x in lines if key_of(x) not in common_keys]
        out.append((i, len(lines), len(lines) - len(rest), "\n".join(rest)))
    return sorted(out, key=repr)


def corpus(seed=5):
    rng = random.Random(seed)
    pool = [f"Line {k} É" for k in range(40)] + ["", " \t", "\x0b\f\r", "  Footer\r", "FOOTER", "footer ", "ÀB", "àb", "Àb"]
    docs = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for k in range(120)]
    docs += [(500, None), (501, ""), (502, "\n\n"), (503, "Footer\nfooter"), (None, "footer\nx"), (None, "footer\nx"), (504, "y\n" * 3000 + "footer"), (504, "y\n" * 3000 + "footer")]
    docs += [(600 + k, "same text\nof copies") for k in range(30)]
    return docs


def got(frame):
    return sorted(((r.row.doc_id, r.n_lines, r.n_dropped, r.kept) for r in frame.collect()), key=repr)


@pytest.mark.parametrize(("min_docs", "min_chars"), [(10, 1), (3, 1), (10, 7), (1, 1)])
def test_equals_brute_force(spark, min_docs, min_chars):
    rows = corpus()
    assert got(line_dedup.drop_lines(spark.createDataFrame(rows, SCHEMA).repartition(5), min_docs=min_docs, min_chars=min_chars)) == brute(rows, min_docs, min_chars)


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    rows = corpus(6)
    assert got(line_dedup.drop_lines(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_report_has_the_digest_of_what_is_kept(spark):
    rows = corpus(7)
    out = sorted((tuple(r) for r in line_dedup.line_report(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert out == sorted(((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(rows)), key=repr)


def test_empty_table_and_clashing_names(spark):
    assert line_dedup.line_report(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = corpus(8)
    names = ["r", "s", "a", "b", "x", "y", "at", "h", "t", "gone", "gr", "gs", "row", "lines", "rest", "kept", "hashes"]
    wide = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(None).cast("string").alias(c) for c in names])
    out = line_dedup.drop_lines(wide)
    assert got(out) == brute(rows)
    assert out.select("row.*").columns == wide.columns


def test_a_line_of_half_a_million_characters_and_a_text_of_many_lines(spark):
    rows = [(k, "x" * 500_000 + "\n" + str(k)) for k in range(10)] + [(99, "z\n" * 200_000)]
    assert got(line_dedup.drop_lines(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
