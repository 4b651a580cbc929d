"""Hand cases of the text functions and of the plain Python parts."""

import re

import pytest
from pyspark.sql import functions as F

from tessellore.functions import text, udf
from tessellore.operators import resolve
from tessellore.sources import library


def value(spark, expression, **columns):
    frame = spark.range(1)
    for name, v in columns.items():
        frame = frame.withColumn(name, F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)))
    return frame.select(expression.alias("v")).first().v


def test_links_are_resolved_and_kept_once(spark):
    body = 'See [a](../topics/x.md), [b](/papers/p.md "t"), [c](p2.md#part), [x](https://e.org/a.md), [m](mailto:a@b.md), [f](#frag), [again](../topics/x.md), [out](../../../y.md), [img](z.png)'
    got = value(spark, text.extract_links(F.col("b"), F.lit("papers/2020-a.md")), b=body)
    assert got == ["topics/x", "papers/p", "papers/p2"]


@pytest.mark.parametrize("raw, want", [("2024", "2024-01-01"), ("2024-13", None), ("2024-02-30", None), ("2024-02-29", "2024-02-29"), (" 2023-05 ", "2023-05-01"), ("n.d.", None), (None, None)])
def test_published(spark, raw, want):
    assert value(spark, text.normalize_published(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("raw, want", [("Hello,  World!", "hello-world"), ("--", "untitled"), ("Ångström (x)", "ångström-x"), ("a" * 100, "a" * 80)])
def test_slug(spark, raw, want):
    assert value(spark, text.slug(F.lit(raw))) == want


def test_han_tokens_go_over_other_text(spark):
    got = value(spark, text.fts_tokens(F.lit("基因abc的表达 x1")))
    assert set(got) == {"abc", "x1", "基", "表", "达", "基因", "因的", "的表", "表达"}


def test_quotes_fold_alike_in_both_forms(spark):
    raw = "Hy­phen-\n ated “Text”, (with)  blanks… End"
    assert value(spark, text.fold_quote(F.lit(raw))) == udf.fold(raw)[0] == "hyphenated text with blanks end"
    assert value(spark, text.quote_in_extract(F.lit("…"), F.lit("abc"))) is False


def test_snapping():
    extract = "Before. The quick brown fox, jumps over the lazy dog near the old river bank today. After."
    assert udf.snap_quote("the QUICK brown fox jumps", extract) == "The quick brown fox, jumps"
    changed = "the quick brown fox leaps across the lazy dog near the old river bank today"
    assert udf.snap_quote(changed, extract) == "The quick brown fox, jumps over the lazy dog near the old river bank today."
    assert udf.snap_quote("nothing like it at all in here my friend ok", extract) is None
    assert udf.snap_quote("", extract) is None


def test_passages_and_segments():
    paras = ["a" * 100, "b" * 500, "c" * 900, "d" * 2000]
    got = udf.passages("\n\n".join(paras))
    assert [len(x) for x in got] == [601, 800, 100, 800, 800, 400]
    assert "".join(got).replace(" ", "") == "".join(paras)
    long = "x" * 5000 + "\n\n" + "y" * 5000
    assert [len(x) for x in udf.segments(long)] == [5000, 5000]
    assert udf.segments("  ") == []


def test_front_matter():
    front, body = udf.split_front_matter("---\ntype: Paper\npublished: 2020-01-02\ntags: [a, b]\n---\n\nText")
    assert front == '{"type": "Paper", "published": "2020-01-02", "tags": ["a", "b"]}' and body.strip() == "Text"
    assert udf.split_front_matter("---\ntype: x\nno end") == ("{}", "---\ntype: x\nno end")
    assert udf.split_front_matter("---\n- a\n---\nb") == ("{}", "b")


def test_a_row_without_a_divider_is_no_table():
    assert udf.markdown_blocks("| a |") == [("paragraph", "| a |")]
    assert udf.markdown_blocks("a | b\n--- | ---\n| 1 | 2 |\n\n##### five\n1) x\n2. y") == [("table", "a | b\n1 | 2"), ("paragraph", "##### five"), ("ordered-list", "x\ny")]
    assert udf.markdown_inlines("a **b** `c` [d](/papers/e.md) ![f](g) _h_") == [("text", "a ", None), ("strong", "b", None), ("text", " ", None), ("code", "c", None), ("text", " ", None), ("link", "d", "/papers/e.md"), ("text", " ", None), ("text", "f", None), ("text", " ", None), ("em", "h", None)]


def brute_fold(source):
    import unicodedata

    source = unicodedata.normalize("NFKC", source)
    source = re.sub(r"-\s+(?=[a-z])", "", source.replace("\u00ad", ""))
    return re.sub(r"\s+", " ", re.sub("[.,;:()\\[\\]\"'“”‘’…]", "", source)).strip().lower()


def test_folding_and_its_places_over_random_texts():
    import random

    rng = random.Random(5)
    for _ in range(2000):
        raw = "".join(rng.choice("aB c-\n.,(“é ﬁＡ x") for _ in range(rng.randint(0, 40)))
        folded, places = udf.fold(udf.nfkc(raw))
        assert folded == brute_fold(raw)
        assert len(places) == len(folded) and places == sorted(places)
        source = udf.nfkc(raw)
        assert all(c == " " or source[p].lower() == c for c, p in zip(folded, places))
        if folded:
            words = folded.split(" ")
            a = rng.randrange(len(words))
            wanted = " ".join(words[a : rng.randint(a + 1, len(words))])
            if brute_fold(wanted) == wanted:  # a lower-cased text may have hyphens that break a word
                assert wanted in udf.fold(udf.snap_quote(wanted, raw))[0]


def test_cut_texts_lose_nothing():
    import random

    rng = random.Random(6)
    for _ in range(300):
        raw = "".join(rng.choice(["word ", "\n\n", "\n", "x" * rng.randint(1, 30)]) for _ in range(rng.randint(0, 60)))
        cut = udf.segments(raw, 50)
        assert all(0 < len(x) <= 50 for x in cut) and "".join("".join(cut).split()) == "".join(raw.split())
        joined = udf.passages(raw, 20, 40)
        assert all(0 < len(x) <= 40 for x in joined) and "".join("".join(joined).split()) == "".join(raw.split())


def test_blocks():
    kinds = [k for k, _ in udf.markdown_blocks("# T\n\npara\nmore\n- a\n- b\n> q\n```\ncode\n```\n---\n| a |\n|---|")]
    assert kinds == ["heading1", "paragraph", "list", "quote", "code", "rule", "table"]


@pytest.mark.parametrize(
    "kind, a, b, want",
    [
        ("Method", "Cellpose", "Cellpose3", None),
        ("Gene", "COL5A1", "COL4A1", None),
        ("Method", "The Cell Pose", "cellpose", "align:title"),
        ("Method", "Deep learning (DL)", "DL", "align:alias"),
        ("Entity", "Macrophage", "Macrophages", "edit-distance:1"),
        ("Gene", "macrophage", "macrophages", None),
        ("Topic", "single cell sequencing", "sequencing of single cell", "token:equal"),
        ("Topic", "cell migration", "collective cell migration", "token:contain"),
        ("Topic", "apples", "oranges", None),
    ],
)
def test_merge_reasons(spark, kind, a, b, want):
    none = F.array().cast("array<string>")
    assert value(spark, resolve.merge_reason(F.lit(kind), F.lit(a), F.lit(b), none, none)) == want


def test_deletion_variants_meet_within_two_edits(spark):
    variants = lambda w: set(value(spark, text.deletion_variants(F.lit(w))))
    assert variants("abc") == {"abc", "bc", "ac", "ab", "a", "b", "c"}
    assert variants("kitten") & variants("sitten") and variants("kitten") & variants("kittens")


def test_archives():
    packed = library.zip_bytes([("b.md", b"2"), ("a/x.md", b"1")])
    assert library.unzip(packed) == [("a/x.md", b"1"), ("b.md", b"2")]
    with pytest.raises(ValueError):
        library.unzip(library.zip_bytes([("../x", b"")]))


def test_library_round_trip(spark, tmp_path):
    import json

    pages = [
        ("papers/2020-a.md", json.dumps({"type": "Paper", "title": "A", "published": "2020", "tags": ["x"], "doi": "https://doi.org/10.1/AB", "verified": {"by": "human:me"}}), "Links [t](../topics/t.md)"),
        ("topics/t.md", json.dumps({"type": "Topic", "title": "T", "status": "odd"}), "no links"),
        ("extracts/a.md", json.dumps({"type": "TextExtract", "paper": "papers/2020-a.md"}), "body"),
        ("notes/n.md", json.dumps({"title": "no type"}), "x"),
        ("other/o.md", json.dumps({"type": "Paper"}), "x"),
    ]
    assert library.write_pages(spark.createDataFrame(pages, "path string, frontmatter string, body string"), str(tmp_path)) == 5
    found = library.files(spark, str(tmp_path))
    assert {r.path for r in found.collect()} == {p for p, _, _ in pages}
    rows = {r.id: r for r in library.concepts(found).collect()}
    assert set(rows) == {"papers/2020-a", "topics/t", "extracts/a"}
    paper = rows["papers/2020-a"]
    assert (paper.published, paper.tags, paper.doi, paper.verified_human, paper.outgoing) == ("2020-01-01", ["x"], "10.1/ab", True, ["topics/t"])
    assert rows["topics/t"].status == "stable" and rows["extracts/a"].body == "" and rows["extracts/a"].paper == "papers/2020-a"


def test_synthetic_census(spark):
    counts = {r.type: r["count"] for r in library.synthetic(spark, 50, 5, 2).groupBy("type").count().collect()}
    assert counts == {"Paper": 50, "Topic": 5, "Claim": 100, "TextExtract": 50}


def test_expanding_sources(spark):
    listing = spark.createDataFrame([("a/X.pdf", 1), ("b/x.PDF", 0), ("c/y.exe", 2), (".git/z.md", 3), ("d/z.md", 4)], "path string, pos int")
    assert {r.path for r in library.expand_sources(listing).collect()} == {"b/x.PDF", "d/z.md"}
