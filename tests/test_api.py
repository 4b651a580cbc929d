"""The library object over a small made library."""

import pytest

from tessellore import schema
from tessellore.api import Library


@pytest.fixture(scope="module")
def shelf(spark):
    row = lambda i, kind, title, out=(), **k: (i, f"{i}.md", kind, title, k.get("published"), k.get("tags", []), k.get("status", "stable"), False, k.get("paper"), k.get("doi"), list(out), k.get("confidence"), None, [], k.get("body", ""))
    rows = [
        row("papers/a", "Paper", "Cell migration", ["topics/t", "methods/m"], published="2020-05-01", tags=["Bio"], body="cell migration under flow", doi="10.1/a"),
        row("papers/b", "Paper", "Flow", ["topics/t"], published="2022-01-01", body="cites papers/a and papers/zz"),
        row("papers/c", "Paper", "Old", [], status="deprecated", published="2021-01-01"),
        row("papers/d", "Paper", "Lone", [], body="alone"),
        row("topics/t", "Topic", "Motion"),
        row("topics/motions", "Topic", "Motions"),
        row("methods/m", "Method", "Imaging"),
        row("datasets/d", "Dataset", "Set", ["papers/b"]),
        row("claims/1", "Claim", "migration claim", ["papers/a"], paper="papers/a", confidence="reviewed", body="cells migrate"),
        row("claims/2", "Claim", "disputed", ["papers/a"], paper="papers/a", confidence="disputed"),
        row("extracts/a", "TextExtract", "raw", [], paper="papers/a"),
    ]
    texts = spark.createDataFrame([("extracts/a", "raw", "migration of cells in collagen")], "id string, title string, body string")
    return Library(spark.createDataFrame(rows, schema.CONCEPTS), texts)


def ids(frame, column="id"):
    return [r[column] for r in frame.collect()]


def test_search_promotes_extracts(shelf):
    assert ids(shelf.search("collagen")) == ["papers/a"]
    assert set(ids(shelf.search("migration"))) == {"papers/a", "claims/1"}
    assert ids(shelf.search("migration", kind="Claim", low="2020", high="2021")) == ["claims/1"]
    assert ids(shelf.search("migration", high="2020")) == []
    with pytest.raises(ValueError):
        shelf.search(" ")


def test_graph(shelf):
    assert ids(shelf.backlinks("papers/a")) == ["claims/2", "claims/1"]
    assert {(r.id, r.direction) for r in shelf.neighbors("papers/b").collect()} == {("topics/t", "out"), ("datasets/d", "in")}
    assert set(ids(shelf.neighborhood(["papers/b"], 2))) == {"papers/b", "topics/t", "datasets/d", "papers/a"}
    assert set(ids(shelf.walk("datasets/d", 2))) == {"datasets/d", "papers/b", "topics/t"}
    nodes, edges = shelf.graph("papers/a")
    assert set(ids(nodes)) == {"papers/a", "topics/t", "methods/m"} and edges.count() == 2
    assert ids(shelf.compare(["papers/a", "papers/b"]), "hub") == ["topics/t"]
    assert shelf.workbench(3).count() == 3


def test_coverage(shelf):
    assert {(r.topic_id, r.year, r.n_papers) for r in shelf.coverage().collect()} == {("topics/t", "2020", 1), ("topics/t", "2022", 1)}
    assert ids(shelf.gaps("topics/t"), "gap_id") == ["undated:papers/d", "year:topics/t:2021"]
    assert {(r.category, r.id) for r in shelf.check().collect()} >= {("isolated-paper", "papers/d"), ("isolated-concept", "topics/motions")}
    assert {r.type: r.n for r in shelf.stats()["counts"].collect()}["Paper"] == 3


def test_integrity(shelf):
    assert {(r.cited, r.legal) for r in shelf.cite_check("see papers/a.md, claims/9.").collect()} == {("papers/a", True), ("claims/9", False)}
    assert {(r.a, r.b) for r in shelf.near_duplicates().collect()} == {("topics/motions.md", "topics/t.md")}
    assert "doi = {10.1/a}" in shelf.bibtex(["papers/a"]).first().entry
    assert ids(shelf.evidence("migrate")) == ["claims/1"]
    assert not shelf.get("papers/a").first().truncated


def test_consolidation_and_dismissed_pairs(spark, shelf):
    assert [(r.gone, r.into) for r in shelf.consolidate().collect()] == [("topics/motions.md", "topics/t.md")]
    gone = spark.createDataFrame([("topics/t.md", "topics/motions.md")], "a string, b string")
    assert shelf.near_duplicates(gone).count() == 0
    assert {r.reason for r in shelf.near_duplicates().collect()} == {"align:stem"}


def test_canonicalize(spark, shelf):
    moves = spark.createDataFrame([("topics/t", "topics/motions")], "from_id string, to_id string")
    out = {r.id: r for r in shelf.canonicalize(moves).collect()}
    assert out["papers/a"].outgoing == ["topics/motions", "methods/m"]
    assert out["topics/t"].status == "deprecated" and out["topics/t"].canonical == "topics/motions"
    assert "Motion" in out["topics/motions"].aliases
