"""Stores, documents, contexts, saved pages, the write path and paths over small made cases."""

import zipfile
import io

import pytest
from pyspark.sql import functions as F

from tessellore import paths, schema
from tessellore.api import Library
from tessellore.operators import compile as compiling
from tessellore.operators import align, context, links, merge, pages, resolve, search
from tessellore.sources import documents, library, store
from tessellore.streaming import events


def docs(spark, rows):
    return spark.createDataFrame(rows, "id string, title string, body string")


@pytest.fixture(scope="module")
def shelf(spark):
    def row(i, kind, title, body="", out=(), **k):
        return (i, f"{i}.md", kind, title, k.get("published"), k.get("tags", []), k.get("status", "stable"), k.get("verified", False), k.get("paper"), k.get("doi"), list(out), k.get("confidence"), k.get("stance"), [], body)

    rows = [
        row("papers/2020-a", "Paper", "Cell migration", "cell migration under flow", ["topics/t"], published="2020-05-01", tags=["Bio", "x"], doi="10.1/a"),
        row("papers/2021-b", "Paper", "Flow", "flow only", ["topics/t"], published="2021-05-01", tags=["bio"]),
        row("topics/t", "Topic", "Motion", "Text. [A](/papers/2020-a.md)", ["papers/2020-a"]),
        row("claims/2020-a--one", "Claim", "One", "> cells migrate", ["papers/2020-a"], paper="papers/2020-a", confidence="reviewed", stance="reports"),
        row("claims/2020-a--two", "Claim", "Two", "> no migration", ["papers/2020-a"], paper="papers/2020-a", confidence="disputed"),
        row("notes/n", "Note", "My note", "About [A](/papers/2020-a.md) and claims/2020-a--one.", ["papers/2020-a"], verified=True),
        row("surveys/s", "Survey", "Survey of motion", "# Intro\nSee [A](/papers/2020-a.md) & [One](/claims/2020-a--one.md), [Motion](/topics/t.md).", ["papers/2020-a"]),
        row("extracts/a", "TextExtract", "raw", "", [], paper="papers/2020-a"),
    ]
    texts = docs(spark, [("extracts/a", "raw", "Collagen guides cells.\n\nMigration of cells in collagen is slow.")])
    return Library(spark.createDataFrame(rows, schema.CONCEPTS), texts)


# stores -------------------------------------------------------------------------------
def test_an_index_is_kept_and_refreshed_by_what_changed(spark, tmp_path, monkeypatch):
    kept = store.Store(spark, str(tmp_path / "lib"))
    first = docs(spark, [("a", "Alpha", "beta gamma"), ("b", "Beta", "delta"), ("c", "", "gone")])
    assert kept.build_index(first).count() == search.build_postings(first).count()
    version = kept.version(store.POSTINGS)
    assert kept.refresh_index(first).count() == 6 and kept.version(store.POSTINGS) == version
    seen = []
    real = search.build_postings
    monkeypatch.setattr(search, "build_postings", lambda d: seen.append(sorted(r.id for r in d.collect())) or real(d))
    now = docs(spark, [("a", "Alpha", "beta gamma"), ("b", "Beta", "delta epsilon"), ("d", "New", "one")])
    got = {tuple(r) for r in kept.refresh_index(now).collect()}
    assert seen == [["b", "d"]]
    assert got == {tuple(r) for r in real(now).collect()}
    other = store.Store(spark, str(tmp_path / "lib"))
    assert {tuple(r) for r in other.load(store.POSTINGS).collect()} == got
    hits = search.fts_search(other.load(store.POSTINGS), 3, "epsilon")
    assert [r.id for r in hits.collect()] == ["b"]
    kept.clean(store.POSTINGS)
    assert other.load(store.POSTINGS).count() == len(got)


def test_a_failed_change_of_several_tables_goes_back(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path / "lib"))
    kept.save("x", spark.createDataFrame([(1,)], "n int"))
    with pytest.raises(ZeroDivisionError), kept.transaction("x", "y"):
        kept.save("x", spark.createDataFrame([(2,)], "n int"))
        kept.save("y", spark.createDataFrame([(2,)], "n int"))
        1 / 0
    assert [r.n for r in kept.load("x").collect()] == [1] and not kept.exists("y")


def test_caches_memos_and_root_pages(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path / "lib"))
    wanted = spark.createDataFrame([("a", "text", ["x", "y"]), ("b", "other", ["x"])], "path string, text string, stages array<string>")
    keys = {r.path: r.key for r in kept.cached_outputs(wanted, 3).collect()}
    kept.upsert(store.CACHE, spark.createDataFrame([(keys["a"], "{}")], "key string, output string"), ["key"])
    assert {r.path: r.output for r in kept.cached_outputs(wanted, 3).collect()} == {"a": "{}", "b": None}
    assert {r.output for r in kept.cached_outputs(wanted, 4).collect()} == {None}
    built = []
    stamps = spark.createDataFrame([("a", "1")], "path string, sha256 string")
    make = lambda: built.append(1) or stamps
    kept.memoized("m", stamps, make)
    kept.memoized("m", stamps, make)
    kept.memoized("m", stamps.withColumn("sha256", F.lit("2")), make)
    assert len(built) == 2
    assert kept.bootstrap() == list(store.ROOT_PAGES) and kept.bootstrap() == []
    kept.log("did\nthis", "2020-01-01")
    kept.log("that", "2020-01-02")
    assert kept.log_page() == "# Log\n- 2020-01-01 did this\n- 2020-01-02 that\n"


# documents ----------------------------------------------------------------------------
def test_documents_are_read_by_their_format(spark):
    found = spark.createDataFrame([("a.md", b"# T\r\nx"), ("b.csv", b"h,i\n1,a|b\n"), ("c.html", b"<h2>T</h2><p>x &amp; y<script>no</script></p><ul><li>z</ul>"), ("d.pdf", b"%PDF"), ("e.txt", b" "), ("f.exe", b"x"), ("g.fmt", b"boom")], "path string, content binary")
    rows = {r.path: (r.body, r.problem) for r in documents.extract_documents(found, {"fmt": lambda b: 1 / 0}).collect()}
    assert rows["a.md"] == ("# T\nx", None)
    assert rows["b.csv"] == ("| h | i |\n| --- | --- |\n| 1 | a\\|b |", None)
    assert rows["c.html"][0] == "## T\n\nx & y\n\n- z"
    assert rows["d.pdf"] == (None, "no reader for pdf") and rows["e.txt"] == (None, "no text")
    assert rows["g.fmt"][1].startswith("ZeroDivisionError") and "f.exe" not in rows
    assert {r.path: r.readable for r in documents.gate(found).collect()} == {"a.md": True, "b.csv": True, "c.html": True, "d.pdf": False, "e.txt": True}


def test_pages_are_planned_and_transcribed(spark):
    found = spark.createDataFrame([("a.pdf", b"3")], "path string, content binary")
    read = documents.read_pages(found, lambda b: [(1, "x" * 100, False), (2, "thin", False), (3, "y" * 100, True)])
    plan = documents.plan_pages(read)
    assert [r.pages for r in plan.collect()] == [[2, 3]]

    def call(path, wanted):
        if len(wanted) > 1:
            return "### Page 2\nlong enough text here"  # lacks page 3, so the batch is split
        return f"### Page {wanted[0]}\nlong enough text here" if wanted[0] == 2 else "### Page 3\nshort"

    got = {tuple(r.pages): (r.markdown is None, r.problem) for r in documents.transcribe(plan, call).collect()}
    assert got == {(2,): (False, None), (3,): (True, "no text for page 3")}


def test_pages_go_to_files_and_archives(spark, tmp_path):
    rows = spark.createDataFrame([("papers/a.md", '{"type": "Paper", "title": "Ａ ﬁ", "authors": ["X", "Y"], "venue": "V"}', "Body"), ("notes/n.md", '{"type": "Note", "authors": "Z"}', "N")], "path string, frontmatter string, body string")
    assert library.write_pages(rows, str(tmp_path / "lib")) == 2
    shelf = Library.read(spark, str(tmp_path / "lib"))
    got = {r.id: r for r in shelf.concepts.collect()}
    assert got["papers/a"].title == "A fi" and got["papers/a"].authors == ["X", "Y"] and got["papers/a"].venue == "V" and got["notes/n"].authors == ["Z"]
    assert "author = {X and Y}" in shelf.bibtex().first().entry and "journal = {V}" in shelf.bibtex().first().entry
    archive = shelf.pack(library.files(spark, str(tmp_path / "lib")), notes=False)
    assert zipfile.ZipFile(io.BytesIO(archive)).namelist() == ["papers/a.md"]
    with pytest.raises(Exception, match="leaves its folder"):
        library.write_pages(rows.withColumn("path", F.lit("../x.md")), str(tmp_path / "lib"))


def test_made_libraries_have_saved_pages_if_asked_for(spark):
    made = library.synthetic(spark, papers=3, topics=2, saved=2)
    assert {r.type: r["count"] for r in made.groupBy("type").count().collect()} == {"Paper": 3, "Topic": 2, "Claim": 3, "TextExtract": 3, "Note": 2, "Question": 2, "Survey": 2}


# links --------------------------------------------------------------------------------
def test_stubs_and_the_error_of_the_guard(spark):
    bodies = spark.createDataFrame([("p", "[Motion](/topics/movement.md) [New thing](/methods/new-thing.md) [again](methods/new-thing.md)")], "id string, body string")
    hubs = spark.createDataFrame([("Topic", "topics/motion.md", "Motion", [])], "type string, path string, title string, aliases array<string>")
    guarded = links.guard_links(links.body_links(bodies), hubs.select("path"), hubs)
    assert links.guarded_bodies(bodies, guarded).first().body == "[Motion](/topics/motion.md) [New thing](/methods/new-thing.md) [again](methods/new-thing.md)"
    stubs = links.stub_pages(guarded, spark.createDataFrame([("p", "papers/p.md", "Paper")], "id string, paper string, paper_title string")).collect()
    assert [(s.path, s.type, s.title) for s in stubs] == [("methods/new-thing.md", "Method", "New thing")] and "[Paper](/papers/p.md)" in stubs[0].body
    bad = spark.createDataFrame([("p", "[x](/domains/y.md)")], "id string, body string")
    with pytest.raises(ValueError, match="domains/y.md"):
        links.guarded_bodies(bad, links.guard_links(links.body_links(bad), hubs.select("path"), hubs))


# write path ---------------------------------------------------------------------------
def test_bodies_and_additions_are_appended_once(spark):
    heads = spark.createDataFrame([("d", "Head"), ("e", "Only")], "doc string, body string")
    tails = spark.createDataFrame([("d", 2, "Head"), ("d", 1, " More "), ("d", 3, "")], "doc string, segment int, additions string")
    assert {r.doc: r.body for r in compiling.merge_additions(heads, tails).collect()} == {"d": "Head\n\nMore", "e": "Only"}


def test_saved_pages_and_their_conditions(shelf):
    made = compiling.save_page(shelf.concepts, "Survey", "New one", "See papers/2020-a.").first()
    assert (made.path, made.action) == ("surveys/new-one.md", "written")
    assert shelf.save_survey("S", "# New").first().action == "updated"
    assert shelf.save_note("N", "text").first().action == "skipped"
    for title, body, match in (("", "x", "title"), ("T", " ", "body"), ("T", "see papers/none", "papers/none")):
        with pytest.raises(ValueError, match=match):
            shelf.save_note(title, body)


def test_compiled_items_align_with_the_library(spark, shelf):
    items = spark.createDataFrame([("The Motion", "Topic", ["a"], "Body", "P", "/papers/p.md"), ("Fresh", "Method", [], "B", "P", "/papers/p.md")], "title string, type string, tags array<string>, body string, paper_title string, paper_href string")
    got = {r.path: r for r in shelf.compile(items).collect()}
    assert set(got) == {"topics/t.md", "methods/fresh.md"}
    assert got["topics/t.md"].action == "updated" and got["topics/t.md"].title == "Motion" and "[A](/papers/2020-a.md)" in got["topics/t.md"].body
    assert got["methods/fresh.md"].action == "written"


def test_ingest_reads_what_changed(spark, shelf):
    files = spark.createDataFrame([("a.md", b"one"), ("b.md", b"two")], "path string, content binary")
    state = files.filter("path = 'a.md'").select("path", F.sha2("content", 256).alias("sha256"), F.lit(3).alias("version"))
    assert [(r.path, r.body) for r in shelf.ingest(files, state, 3).collect()] == [("b.md", "two")]


# merges -------------------------------------------------------------------------------
def test_a_merge_of_pages_and_its_report(shelf):
    moves = shelf.concepts.limit(0).select(F.col("id").alias("old"), F.col("id").alias("new"))
    got = {r.path: (r.action, r.conflict) for r in shelf.merge_pages(shelf, moves).collect()}
    assert got["topics/t.md"] == ("merged", False) and got["claims/2020-a--one.md"] == ("skipped", False) and got["notes/n.md"] == ("skipped", False)
    report = merge.report(shelf.merge_pages(shelf, moves))
    assert "## Merged\n- claims/2020-a--two.md\n- topics/t.md" in report and report.endswith("- (none)\n")


def test_verified_pages(spark):
    rows = spark.createDataFrame([("a", False), ("b", True)], "id string, verified_human boolean")
    got = {r.id: (r.verified_human, r.verified_by) for r in merge.verify(rows, rows.filter("id = 'a'").select("id"), "me", "2020").collect()}
    assert got == {"a": (True, "human:me"), "b": (True, None)}


# what models see ----------------------------------------------------------------------
def test_context_holds_passages_papers_and_claims(shelf):
    got = shelf.context("migration in collagen")
    assert "### Passage 1\npaper: papers/2020-a\nextract: extracts/a\nCollagen guides cells. Migration of cells in collagen is slow." in got
    assert "- papers/2020-a Cell migration published=2020-05-01 doi=10.1/a tags=Bio,x links=topics/t\n  cell migration under flow" in got
    assert "- claims/2020-a--one One paper=papers/2020-a stance=reports confidence=reviewed\n  quote: cells migrate" in got and "--two" not in got
    assert shelf.cite_ids("migration in collagen") == {"papers": ["papers/2020-a"], "claims": ["claims/2020-a--one"]}
    empty = shelf.context("zzz coverage gap")
    assert "## Coverage gaps" in empty and "- papers/2021-b Flow" in empty
    assert len(context.assemble("q", {"passages": shelf.concepts.limit(0), "papers": shelf.papers, "claims": shelf.concepts.limit(0)}, titles=["x" * 30_000])) <= context.CONTEXT_CHARS + 60


def test_exports_cite_papers_and_claims(shelf):
    tex = shelf.export("surveys/s", "tex").first()
    assert r"\section*{Intro}" in tex.text and r"\cite{cellmigration2020}" in tex.text and "Motion" in tex.text and r"\bibliography{s}" in tex.text
    md = shelf.export("surveys/s").first()
    assert md.text.startswith('---\ntitle: "Survey of motion"') and "[@cellmigration2020]" in md.text and md.bibtex.count("@article") == 1


def test_reader_pages(shelf):
    assert [r.id for r in shelf.shelf("2020", "2020-12", "BIO").collect()] == ["papers/2020-a"]
    assert [r.id for r in shelf.shelf().collect()] == ["papers/2021-b", "papers/2020-a"]
    assert [(r.type, r.id) for r in shelf.cards().collect()] == [("Note", "notes/n"), ("Survey", "surveys/s")]
    assert shelf.open("notes/n.md").first().truncated is False
    for path in ("sources/a.pdf", "../x", " ", ".okf/state"):
        with pytest.raises(ValueError):
            shelf.open(path)
    assert "- Papers: 2" in shelf.root_page() and "- [topics/t.md](/topics/t.md) (1 papers)" in shelf.root_page()
    assert pages.in_range(shelf.papers, None, "2020-06").count() == 1


def test_papers_side_by_side(shelf):
    got = shelf.comparison(["papers/2020-a", "/papers/2021-b.md", "papers/none", "papers/2020-a"])
    assert got["missing"] == ["papers/none"] and got["truncated"] is False
    cards = got["papers"].collect()
    assert [(c.id, c.n_claims, [h.id for h in c.hubs]) for c in cards] == [("papers/2020-a", 2, ["topics/t"]), ("papers/2021-b", 0, ["topics/t"])]
    assert [(r.hub, r.in_all) for r in got["shared"].collect()] == [("topics/t", True)] and [r.tag for r in got["tags"].collect()] == ["bio"]
    assert [r.id for r in got["nodes"].collect()] == ["papers/2020-a", "papers/2021-b", "topics/t"]
    assert {(r.src, r.dst) for r in got["edges"].collect()} == {("papers/2020-a", "topics/t"), ("papers/2021-b", "topics/t")}
    assert [c.id for c in shelf.comparison()["papers"].collect()] == ["papers/2021-b", "papers/2020-a"]
    with pytest.raises(ValueError, match="no paper"):
        shelf.comparison(query="zzzz")


def test_graphs_of_a_search_and_comparisons(shelf):
    nodes, edges = shelf.graph(query="collagen")
    assert {r.id for r in nodes.collect()} == set()
    nodes, edges = shelf.graph(query="migration")
    assert {r.id for r in nodes.collect()} == {"papers/2020-a", "topics/t"} and edges.count() == 2
    nodes, edges = shelf.graph(query="cells migrate")
    assert {r.id for r in nodes.collect()} == {"papers/2020-a", "claims/2020-a--one"} and edges.count() == 1
    assert [r.hub for r in shelf.compare(query="flow").collect()] == ["topics/t"]
    assert [(r.tag, r.in_all) for r in shelf.shared_tags(["papers/2020-a", "papers/2021-b"]).collect()] == [("bio", True)]
    with pytest.raises(ValueError):
        shelf.compare()
    assert {r.id for r in shelf.filtered(types=("Paper", "Topic"), this_year=2022, query="migration").collect()} == {"papers/2020-a", "topics/t"}
    survey = shelf.compile_survey("topics/t", "2020", "2020")
    assert [r.paper for r in survey["papers"].collect()] == ["papers/2020-a"] and {r.id for r in survey["allowed"].collect()} == {"papers/2020-a", "claims/2020-a--one", "claims/2020-a--two"}


def test_vectors_are_synced_by_model(spark, shelf, tmp_path):
    with Library(shelf.concepts, shelf._texts) as own:
        own.with_index(str(tmp_path / "index"))
        first = own.sync_vectors(lambda texts: [[float(len(t)), 1.0] for t in texts], "m1")
        assert {(r.chunk_id, r.model) for r in first.collect()} == {("claims/2020-a--one#quote", "m1"), ("claims/2020-a--two#quote", "m1"), ("extracts/a#p0", "m1")}
        second = own.sync_vectors(lambda texts: [[1.0, 2.0] for t in texts], "m2")
        assert {r.model for r in second.collect()} == {"m2"}
        assert own.search("collagen", vector=[1.0, 2.0], model="m2").count() >= 1


def test_prompts_for_synonyms_and_the_vocabulary(spark, shelf):
    words = resolve.vocabulary(shelf.concepts)
    keys = align.index(words)
    incoming = spark.createDataFrame([("Topic", "motion"), ("Topic", "Speed"), ("Method", "Imaging")], "type string, title string")
    got = {r.type: r.prompt for r in resolve.alias_prompts(incoming, keys, words).collect()}
    assert got == {"Topic": 'New: ["Speed"]\nKnown: ["Motion"]', "Method": 'New: ["Imaging"]\nKnown: []'}


# streams ------------------------------------------------------------------------------
def test_documents_go_through_their_steps():
    status, left, refused = None, [], 0
    for event in [("extracting", None, None), ("queued", None, None), ("extracting", None, None), ("needs_vision", [3, 1, 2], None), ("awaiting_vision", [1], None), ("failed", None, "lost"), ("queued", None, None), ("extracting", None, None), ("compiling", None, None)]:
        status, left, error, no = events.advance(status, left, event)
        refused += no
    assert (status, left, refused) == ("extracting", [2, 3], 2)


def test_document_states_survive_batches(spark, tmp_path):
    shape = "path string, seq long, status string, pages array<int>, error string"
    steps = [("queued", None), ("extracting", None), ("needs_vision", [1, 2]), ("awaiting_vision", [1]), ("extracting_vision", None), ("awaiting_vision", [2]), ("extracting_vision", None), ("compiling", None), ("done", None)]
    for n, (status, wanted) in enumerate(steps):
        rows = [("a", n, status, wanted, None)] + ([("b", 0, "queued", None, None)] if n == 0 else []) + ([("b", 1, "done", None, None)] if n == 3 else [])
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    got = {r.path: (r.status, list(r.pages_left), r.n_refused) for r in events.run_documents(spark, str(tmp_path / "events"), shape).collect()}
    assert got == {"a": ("done", [], 0), "b": ("queued", [], 1)}


def test_events_without_a_time_only_count(spark, tmp_path):
    spark.sql("SELECT 1L user_id, cast(null as timestamp) ts, 'x' event_type, 1.0D value UNION ALL SELECT 2L, timestamp'2020-01-01 00:30:00', 'x', 2.0D UNION ALL SELECT 2L, null, 'x', 3.0D").coalesce(1).write.parquet(str(tmp_path / "e.parquet"))
    got = {r.user_id: (r.n_events, r.last_ts is None) for r in events.run_state(spark, str(tmp_path / "e.parquet")).collect()}
    assert got == {1: (1, True), 2: (2, False)}
    hours = events.run_to_end(spark, str(tmp_path / "e.parquet"), events.hourly, ["hour", "event_type"]).collect()
    assert [(r.n, r.total) for r in hours] == [(1, 2.0)]


def test_path_templates():
    assert paths.expand("${home}/x/${env:NAME}", {"home": "/h"}, {"NAME": " n "}) == "/h/x/n"
    for template in ("${other}", "${env:NONE}"):
        with pytest.raises(ValueError, match="path variable"):
            paths.expand(template, {"home": "/h"}, {})


def test_extracts_without_words_and_with_blanks_of_any_kind_are_chunked(spark, tmp_path):
    """A row for each document, whatever its text, as the SQL says."""
    from tests import oracle
    from tessellore.plans import registry

    texts = ["One.\n\nTwo.", None, "", " \n\n\t", "a\xa0b\u2003c\u3000d", "a\x1cb\x85c\u2028d", "\xa0\n\xa0", "word " * 4000, "x" * 20000]
    rows = [*enumerate(texts), (7, texts[7]), (7, "another text of it"), (1, None), (None, "no id")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "w"))
    (part,) = (tmp_path / "w").glob("part-*.parquet")
    part.rename(tmp_path / "documents.parquet")
    oracle.compare(spark, oracle.connect(tmp_path), registry.queries()["extract_chunks"], registry.oracle_sql()["extract_chunks"], str(tmp_path))
