"""Model and service seams with fakes, manuscripts and coverage blocks."""

import pytest

from tessellore.functions import seams
from tessellore.operators import survey
from tessellore.plans import lens


def test_embedding_batches(spark):
    chunks = spark.createDataFrame([(f"c{i}", "s", "x" * i) for i in range(70)], "chunk_id string, source_id string, text string")
    out = seams.embed(chunks, lambda texts: [[len(t), len(texts)] for t in texts], "fake")
    rows = {r.chunk_id: r for r in out.collect()}
    assert rows["c5"].embedding[0] == 5.0 and rows["c5"].model == "fake"
    assert max(r.embedding[1] for r in rows.values()) <= seams.EMBED_BATCH
    with pytest.raises(Exception, match="number or size"):
        seams.embed(chunks, lambda texts: [], "fake").collect()


def test_answers_are_parsed_with_their_problems(spark):
    prompts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id string, prompt string")
    fake = {"a": 'ok ```json\n{"title": "T", "year": 2020}\n```', "b": "sorry", "c": '{"year": 1}'}
    out = seams.parse_answers(seams.complete(prompts, fake.__getitem__), "title string, year int", ["title"])
    assert {r.id: (r.value and r.value.title, r.problem) for r in out.collect()} == {"1": ("T", None), "2": (None, "no JSON object"), "3": (None, "missing: title")}


def test_look_up_prefers_the_doi(spark):
    papers = spark.createDataFrame([("p1", "doi:10.1/A", "Other words", None), ("p2", None, "Cell migration in collagen", "2020-01-01"), ("p3", None, "Nothing alike", None)], "id string, doi string, title string, published string")
    catalogue = spark.createDataFrame([("10.1/a", "Real title", "2019"), ("10.1/b", "Cell migration in collagen", "2020"), ("10.1/c", "Cell division", "2020")], "doi string, title string, published string")
    hits = {r.id: (r.doi, r.score) for r in seams.look_up(papers, catalogue).collect()}
    assert hits == {"p1": ("10.1/a", 1.0), "p2": ("10.1/b", 0.95)}
    filled = {r.id: r.doi for r in seams.apply_biblio(papers, seams.look_up(papers, catalogue)).collect()}
    assert filled == {"p1": "doi:10.1/A", "p2": "10.1/b", "p3": None}


def test_manuscript_links_become_citations(spark):
    bodies = spark.createDataFrame([("s", "As [A](/papers/a.md) & [topic](topics/t.md) say."), ("n", "no links")], "id string, body string")
    keys = spark.createDataFrame([("papers/a", "a2020")], "id string, key string")
    assert {r.id: r.text for r in survey.manuscript(bodies, keys).collect()} == {"s": "As [@a2020] & topic say.", "n": "no links"}
    tex = {r.id: r.text for r in survey.manuscript(bodies, keys, "tex").collect()}
    assert tex["s"] == "As \\cite{a2020} \\& topic say."


def test_coverage_block(spark):
    papers = spark.createDataFrame([("p", "2020"), ("q", "2022")], "paper string, year string")
    years = spark.createDataFrame([("2020",), ("2021",), ("2022",)], "year string")
    row = survey.coverage_block(papers, papers.limit(1), years).first()
    assert (row.n_scope, row.n_cited, row.missing_years) == (2, 1, ["2021"])


def test_lens_leaves_no_views(spark):
    lens.nodes(spark, "/root/testdata/sf0.001").count()
    assert not [t for t in spark.catalog.listTables() if t.isTemporary]
