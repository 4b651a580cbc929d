"""Consolidation, redirects and pruned searches against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from tessellore.operators import merging, pruned, search


def greedy(choices, verified=frozenset()):
    gone = {}
    for keep, drop in choices:
        if drop in verified:
            keep, drop = drop, keep
        if drop in verified or keep in gone or drop in gone or keep == drop:
            continue
        gone[drop] = keep
    return gone


@pytest.mark.parametrize("seed", range(4))
def test_consolidation_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    n = (6, 12, 40, 9)[seed]
    choices = [tuple(rng.sample(range(n), 2)) for _ in range(60)]
    choices = [(f"p{a}", f"p{b}") for a, b in choices] + [("p0", "p0")]
    verified = {f"p{k}" for k in range(n) if k % 5 == 0}
    rows = [(i, a, b) for i, (a, b) in enumerate(choices)]
    frame = spark.createDataFrame(rows, "place int, keep string, drop string").repartition(3)
    got = merging.consolidate(frame, spark.createDataFrame([(v,) for v in verified], "id string"))
    assert {r.gone: r.into for r in got.collect()} == greedy(choices, verified)
    assert {r.gone: r.into for r in merging.consolidate(frame).collect()} == greedy(choices)
    assert merging.consolidate(frame.limit(0)).count() == 0


def test_greedy_consolidation(spark):
    frame = spark.createDataFrame([(0, "a", "b"), (1, "b", "c"), (2, "c", "d")], "place int, keep string, drop string")
    assert {r.gone: r.into for r in merging.consolidate(frame, spark.createDataFrame([("d",)], "id string")).collect()} == {"b": "a", "c": "d"}


def test_redirects_go_to_their_end(spark):
    rng = random.Random(8)
    moves = {f"n{k}": f"n{rng.randrange(40)}" for k in range(36)} | {"x": "y", "y": "z", "z": "x", "w": "x", "s": "s"}

    def end(page):
        seen = []
        while page in moves and moves[page] != page and page not in seen:
            seen.append(page)
            page = moves[page]
        return min(seen[seen.index(page) :]) if page in seen else page

    got = {r.from_id: r.to_id for r in merging.closure(spark.createDataFrame(list(moves.items()), "from_id string, to_id string")).collect()}
    assert got == {p: end(p) for p in moves if end(p) != p}
    assert got["w"] == "x" and "x" not in got
    long = spark.range(300).select(F.concat(F.lit("c"), F.lpad("id", 4, "0")).alias("from_id"), F.concat(F.lit("c"), F.lpad(F.col("id") + 1, 4, "0")).alias("to_id"))
    assert {r.to_id for r in merging.closure(long).collect()} == {"c0300"}


def test_pages_after_moves(spark):
    shape = "id string, type string, title string, status string, outgoing array<string>, tags array<string>, aliases array<string>, paper string, body string, verified_human boolean"
    rows = [
        ("topics/a", "Topic", "Alpha", "stable", [], ["x"], [], None, "A [P](/papers/p.md)", False),
        ("topics/b", "Topic", "Beta", "stable", ["papers/p"], ["y"], ["B"], None, "Checked [Q](/papers/q.md)", True),
        ("topics/c", "Topic", "Gamma", "stable", [], [], [], None, "C [R](/papers/r.md)", False),
        ("notes/n", "Note", "N", "stable", ["topics/a", "topics/c"], [], [], "topics/a", "see [A](/topics/a.md) and [C](/topics/c.md)", False),
    ]
    moves = spark.createDataFrame([("topics/a", "topics/b"), ("topics/b", "topics/c")], "from_id string, to_id string")
    got = {r.id: r for r in merging.canonicalize(spark.createDataFrame(rows, shape), moves).collect()}
    assert (got["topics/a"].canonical, got["topics/a"].status, got["topics/a"].body) == ("topics/c", "deprecated", "Moved to [Gamma](/topics/c.md).\n")
    assert (got["notes/n"].outgoing, got["notes/n"].paper, got["notes/n"].body) == (["topics/c"], "topics/c", "see [A](/topics/c.md) and [C](/topics/c.md)")
    c = got["topics/c"]
    assert c.canonical is None and set(c.tags) == {"x", "y"} and {"Alpha", "Beta", "B"} <= set(c.aliases)
    assert c.body.startswith("Checked") and all(f"(/papers/{p}.md)" in c.body for p in "pqr")


def test_pruned_text_search_equals_the_scan_and_reads_less(spark):
    rows = spark.range(3000).select(
        F.concat(F.lit("d"), F.col("id")).alias("id"),
        F.when(F.col("id") % 37 == 0, F.concat(F.lit("flow cell "), F.col("id") % 11)).otherwise(F.lit("other")).alias("title"),
        F.concat_ws(" ", F.when(F.col("id") % 3 == 0, "flow"), F.when(F.col("id") % 50 == 0, "cells migrate"), F.concat(F.lit("w"), F.col("id") % 500)).alias("body"),
    )
    postings = search.build_postings(rows).cache()
    dealt, bounds = pruned.blocked(postings, 3000)
    for query in ("flow cell", "cell migrate flow", "nothing", "w1", "other"):
        hits, read = pruned.top_documents(dealt, bounds, 3000, query)
        want = search.fts_search(postings, 3000, query).collect()
        assert [(r.id, round(r.score, 6)) for r in hits.collect()] == [(r.id, round(r.score, 6)) for r in want]
        if query == "cell migrate flow":
            assert read.count() < 0.6 * search.matched_postings(postings, query).count()


def test_pruned_vector_search_equals_the_scan_and_reads_less(spark):
    rng = random.Random(3)
    rows = []
    for k in range(1200):
        centre = [1.0 if i == k % 12 else 0.0 for i in range(12)]
        rows.append((f"s{k // 2}", [x + rng.gauss(0, 0.05) for x in centre]))
    rows += [("zero", [0.0] * 12), ("none", None), ("twin", rows[5][1]), ("twin2", rows[5][1])]
    chunks = spark.createDataFrame(rows, "source_id string, embedding array<double>")
    dealt, cells = pruned.celled(chunks, 12)
    dealt = dealt.cache()
    assert dealt.count() == len(rows)
    for query in (rows[5][1], [1.0] * 12, [0.0] * 12):
        hits, read = pruned.top_sources(dealt, cells, query)
        assert [(r.id, round(r.score, 6)) for r in hits.collect()] == [(r.id, round(r.score, 6)) for r in search.vector_search(chunks, query).collect()]
        if query == rows[5][1]:
            assert len(read) <= 6
    assert pruned.top_sources(*pruned.celled(chunks.filter("source_id = 'zero'"), 4), [1.0] * 12)[0].count() <= 1
