"""Scalar functions of the library as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing in concept titles.
TOKEN_STOPS = (
    "a", "an", "and", "based", "by", "for", "from", "in", "into", "of", "on", "or", "the", "to", "using", "via", "vs", "with",
    "signaling", "signalling", "pathway", "pathways", "analysis", "analyses", "assay", "assays", "method", "methods",
    "approach", "approaches", "model", "models", "study", "studies", "role", "effect", "effects", "response", "responses",
    "associated", "related", "involving",
)
#: Single Han characters that are not indexed alone.
HAN_STOPS = "的了是在和与及就都而或其之于也对从到由被把以为所因但并且这那有中上下个等更又再已将还若则即吗呢吧啊哦我你他她它们"
#: Lines that are page furniture.
LINE_NOISE = (
    r"^(?:ID: [\w.]+ — \d{4}/\d{1,2}/\d{1,2} — page \d+ — #\d+|## PLOS [A-Z ]+|OPEN ACCESS|RESEARCH ARTICLE"
    r"|\*\*(?:nature (?:methods|biotechnology|medicine|genetics|cancer|aging|energy|neuroscience))\*\*|\d{1,3} of \d{1,3})\s*$"
)
#: Inline footers and formatting tags that are dropped from lines.
DOWNLOADED = r"Downloaded from \S+(?: by guest on \d{1,2} \w+ \d{4}| at \S+ .+? on \w+ \d{1,2}, \d{4})?"
INLINE_TAGS = r"</?(?:u|i|b|em|strong|sub|sup)>"
#: A lone capital before small letters; A and I are words of their own. Borders are those of ASCII words, as a Unicode border would count fewer in accented texts.
BROKEN_WORD = r"(?<![A-Za-z0-9_])[B-HJ-Z] [a-z]{2,}(?![A-Za-z0-9_])"
BROKEN_WORD_THRESHOLD = 80
QUOTE_NOISE = ".,;:()\\[\\]\"'“”‘’…"


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Without the blanks of any kind around it."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def concept_id(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^/+", ""), r"(?i)\.md$", "")


def concept_path(concept: Column) -> Column:
    return F.concat(concept_id(concept), F.lit(".md"))


def fold_path(path: Column) -> Column:
    """Resolves ``.`` and ``..`` steps; a path that leaves the root is null."""
    def step(got: Column, part: Column) -> Column:
        up = F.when(F.size(got) == 0, F.lit(None).cast("array<string>")).otherwise(F.slice(got, 1, F.greatest(F.size(got) - 1, F.lit(0))))
        return F.when(part.isin("", "."), got).when(part == "..", up).otherwise(F.concat(got, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def resolve_href(href: Column, page: Column) -> Column:
    """The concept id a link on a page points to, or null for what is no page of the library."""
    bare = F.regexp_replace(href, r"#.*$", "")
    folder = F.regexp_replace(page, r"[^/]*$", "")
    full = F.when(bare.startswith("/"), bare).otherwise(F.concat(folder, bare))
    outside = href.rlike(r"^(?i)(https?:|mailto:|#)") | ~bare.rlike(r"(?i)\.md$")
    return F.when(outside, F.lit(None).cast("string")).otherwise(concept_id(fold_path(full)))


def link_targets(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(r'\[([^\]]*)\]\(([^)\s]+)(?:\s+"[^"]*")?\)'), F.lit(2))


def extract_links(body: Column, page: Column) -> Column:
    """Ids that a page links to, each once, in order of first occurrence."""
    return F.array_distinct(F.filter(F.transform(link_targets(body), lambda h: resolve_href(h, page)), lambda x: x.isNotNull()))


def slug(text: Column) -> Column:
    kept = F.regexp_replace(F.regexp_replace(F.lower(strip(text)), r"\s+", "-"), r"[^\p{L}\p{N}-]", "")
    cut = F.substring(F.regexp_replace(F.regexp_replace(kept, "-+", "-"), "^-|-$", ""), 1, 80)
    return F.when(F.coalesce(cut, F.lit("")) == "", F.lit("untitled")).otherwise(cut)


def paper_slug(year: Column, title: Column) -> Column:
    return F.concat_ws("-", year, slug(title))


def normalize_published(value: Column) -> Column:
    v = strip(value)
    day = F.when(v.rlike(r"^\d{4}$"), F.concat(v, F.lit("-01-01"))).when(v.rlike(r"^\d{4}-\d{2}$"), F.concat(v, F.lit("-01"))).when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), v)
    return F.when(F.try_to_date(day, "yyyy-MM-dd").isNotNull(), day)


def published_year(value: Column) -> Column:
    return F.nullif(F.regexp_extract(value, r"^(\d{4})", 1), F.lit(""))


def normalize_doi(value: Column) -> Column:
    return F.nullif(F.lower(F.regexp_replace(strip(value), r"^(?i)(https?://(dx\.)?doi\.org/|doi:\s*)", "")), F.lit(""))


def title_year_key(title: Column, published: Column) -> Column:
    return F.concat_ws("|", slug(title), F.coalesce(published_year(published), F.lit("")))


def fold_quote(text: Column) -> Column:
    """Quotes compare without hyphenation, blanks, punctuation and case."""
    joined = F.regexp_replace(F.regexp_replace(text, "­", ""), r"-\s+(?=[a-z])", "")
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(joined, f"[{QUOTE_NOISE}]", ""), r"\s+", " ")))


def quote_in_extract(quote: Column, extract: Column) -> Column:
    needle = fold_quote(quote)
    return F.when(needle == "", F.lit(False)).otherwise(F.contains(fold_quote(extract), needle))


def quote_fingerprint(quote: Column) -> Column:
    return F.substring(fold_quote(quote), 1, 120)


def latin_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9][a-z0-9+-]{1,}"), F.lit(0))


def han_tokens(text: Column, stops: str = HAN_STOPS) -> Column:
    """Single Han characters but stops, and the pairs of the text's Han characters in a row."""
    def both(chars: Column) -> Column:
        pairs = F.filter(F.transform(chars, lambda c, i: F.concat(c, F.get(chars, i + 1))), lambda p: p.isNotNull())
        return F.concat(F.filter(chars, lambda c: ~F.lit(stops).contains(c)), pairs)

    found = F.regexp_extract_all(text, F.lit(r"\p{IsHan}"), F.lit(0))
    return let(found, both)


def fts_tokens(text: Column) -> Column:
    return F.array_distinct(F.concat(latin_tokens(text), han_tokens(text)))


def passage_terms(text: Column) -> Column:
    spaced = F.filter(F.split(F.lower(text), r"\s+"), lambda t: F.length(t) >= 2)
    runs = F.regexp_extract_all(text, F.lit("[一-鿿]{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_distinct(F.concat(spaced, latin_tokens(text), pairs))


def score_passage(passage: Column, terms: Column) -> Column:
    return let(F.lower(passage), lambda hay: F.size(F.filter(terms, lambda t: F.contains(hay, t))))


def fixed_passages(text: Column, size: int = 800) -> Column:
    """A text without paragraphs, cut every ``size`` characters."""
    n = lambda t: F.greatest(F.ceil(F.length(t) / size).cast("int"), F.lit(1))
    return let(text, lambda t: F.transform(F.sequence(F.lit(0), n(t) - 1), lambda i: F.substring(t, i * size + 1, F.lit(size))))


def align_key(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(text)), r"^(the|an|a)\s+", ""), r"[^\p{L}\p{N}]", "")


def stem_key(key: Column) -> Column:
    plural = (F.length(key) > 5) & key.endswith("s") & ~key.endswith("ss")
    return F.when(plural, F.regexp_replace(key, "s$", "")).otherwise(key)


def singular(key: Column) -> Column:
    """A plural key without its last letter; null if it is none."""
    return F.when((F.length(key) > 5) & key.endswith("s") & ~key.endswith("ss"), F.regexp_replace(key, "s$", ""))


def other_number(key: Column) -> Column:
    """The singular of a plural key, the plural of another; null if it is too short for either."""
    return F.coalesce(singular(key), F.when(F.length(key) > 5, F.concat(key, F.lit("s"))))


def align_tokens(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(text), r"\([^)]*\)", " ")
    return F.array_distinct(F.filter(F.split(bare, r"[^\p{L}\p{N}]+"), lambda t: (F.length(t) >= 2) & ~t.isin(*TOKEN_STOPS)))


def parentheticals(text: Column) -> Column:
    """What stands in parentheses, unless it is the whole text."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\(([^)]+)\)"), F.lit(1)), strip), lambda t: (t != "") & (align_key(t) != align_key(text)))


def tokens_equal(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.array_sort(a) == F.array_sort(b))


def token_match(existing: Column, incoming: Column) -> Column:
    """``equal``, or ``existing-in-incoming`` when the existing title is the broader one, else null."""
    subset = (F.size(existing) > 0) & (F.size(F.array_except(existing, incoming)) == 0)
    long_enough = (F.length(F.get(existing, F.lit(0))) >= 5) & (F.size(incoming) - F.size(existing) <= 2)
    return F.when(subset & (F.size(existing) == F.size(incoming)), F.lit("equal")).when(subset & ((F.size(existing) >= 2) | long_enough), F.lit("existing-in-incoming"))


#: From how many letters of the shorter slug on a common beginning makes two slugs akin. Below it, slugs
#: of compile targets need to lie within one another; a link's slug has to begin the paper's with so many letters.
KIN_LENGTH = {"target": 12, "link": 8}
KIN_BEGIN = 4


def akin(said: Column, slug: Column, rule: str) -> Column:
    """Whether two slugs mean one paper, their leading years aside; an empty one means none."""
    x, y = (F.regexp_replace(c, "^[0-9]{4}-", "") for c in (said, slug))
    size = F.least(F.length(x), F.length(y))
    at = F.greatest(F.position(x, y), F.position(y, x))  # 1 where one begins the other, 0 where neither holds the other
    below = at > 0 if rule == "target" else (x == y) | ((F.position(x, y) == 1) & (F.length(x) >= KIN_BEGIN))
    begins = (F.position(x, y) == 1) | (F.position(y, x) == 1)
    return (size > 0) & F.when(size >= KIN_LENGTH[rule], begins).otherwise(below)


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9]+", "")


def _is_symbol(text: Column) -> Column:
    return (F.length(_bare(text)) <= 16) & _bare(text).rlike("[0-9]")


def symbol(text: Column) -> Column:
    """The letters and digits of a catalogue symbol: at most 16, some of them digits; null for what is none."""
    return F.when(_is_symbol(text), _bare(text))


def symbol_pair(a: Column, b: Column) -> Column:
    """Two different catalogue symbols."""
    return _is_symbol(a) & _is_symbol(b) & (_bare(a) != _bare(b))


def version_stem(text: Column) -> Column:
    """A title without the version at its end."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\s._-]*v?\d+(\.\d+)*$", ""))


def unspaced(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def version_pair(a: Column, b: Column) -> Column:
    """One stem, different versions."""
    return (version_stem(a) != "") & (version_stem(a) == version_stem(b)) & (unspaced(a) != unspaced(b))


def deletion_variants(key: Column, most: int = 2) -> Column:
    """The key and what remains of it after up to ``most`` deletions, each once."""
    def without_one(t: Column) -> Column:
        n = F.length(t)
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, n)))).otherwise(F.array().cast("array<string>"))

    out, level = F.array(key), F.array(key)
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, without_one)))
        out = F.concat(out, level)
    return F.array_distinct(out)


def jaccard(a: Column, b: Column) -> Column:
    return F.when(F.size(F.array_union(a, b)) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def excerpt(body: Column, most: int = 160) -> Column:
    plain = F.regexp_replace(body, r"\[([^\]]+)\]\([^)]+\)", "$1")
    flat = F.trim(F.regexp_replace(F.regexp_replace(plain, "[#*_`>]", ""), r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit("…"))).otherwise(flat)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")


def normalize_markdown(text: Column) -> Column:
    """Lines without inline tags, footers and trailing blanks; furniture lines go, blank runs become one."""
    clean = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, INLINE_TAGS, ""), DOWNLOADED, ""), r"[ \t]+$", "")
    kept = F.filter(F.transform(F.split(text, "\n"), clean), lambda x: ~F.trim(x).rlike(LINE_NOISE))
    return F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def broken_words(text: Column) -> Column:
    """Single capitals torn off their words, as bad text layers leave them."""
    return F.regexp_count(text, F.lit(BROKEN_WORD))


def cite_ids(body: Column) -> Column:
    """Page ids named in a text, each once, in order."""
    found = F.regexp_extract_all(body, F.lit(r"\b((?:papers|claims|topics|methods|entities|notes|questions|surveys)/[A-Za-z0-9][A-Za-z0-9._/-]*)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"(?i)\.md$", ""), r"[.,;:)]+$", "")))


def citation_key(title: Column, published: Column) -> Column:
    """The letters and digits of a title, 24 at most, and its year."""
    plain = F.substring(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", ""), 1, 24)
    return F.concat(F.coalesce(F.nullif(plain, F.lit("")), F.lit("paper")), F.coalesce(published_year(published), F.lit("")))


def escape_bib(text: Column) -> Column:
    return F.regexp_replace(text, r"([{}\\])", r"\\$1")


def escape_latex(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\\", r"\\textbackslash "), r"([{}%&#$_])", r"\\$1"), "~", r"\\textasciitilde ")


def cosine(a: Column, b: Column) -> Column:
    """Over the common dimensions; 0 when a norm is."""
    n = F.least(F.size(a), F.size(b))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(x, y) / norm)


def years_between(low: Column, high: Column, most: int = 100) -> Column:
    a, b = F.least(low, high), F.greatest(low, high)
    return F.sequence(a, F.least(b, a + most))


def date_parts(year: Column, month: Column, day: Column) -> Column:
    return F.when(year.isNull(), F.lit(None).cast("string")).otherwise(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(F.coalesce(month, F.lit(1)).cast("string"), 2, "0"), F.lpad(F.coalesce(day, F.lit(1)).cast("string"), 2, "0")))


def session_title(text: Column, most: int = 36) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def strip_thinking(reply: Column) -> Column:
    return strip(F.regexp_replace(reply, r"(?s)<think>.*?</think>", ""))


def json_object(text: Column) -> Column:
    """The JSON object in a model's answer: in a fence, or between the outer braces."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.nullif(F.when(fenced != "", fenced).otherwise(F.regexp_extract(text, r"(?s)(\{.*\})", 1)), F.lit(""))


def needs_vision(text: Column, has_image: Column, thin: int = 80) -> Column:
    return has_image | (F.length(F.trim(text)) < thin)


def fingerprint16(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def biblio_score(same_doi: Column, overlap: Column, same_year: Column) -> Column:
    return F.when(same_doi, F.lit(1.0)).when((overlap >= 0.95) & same_year, F.lit(0.95)).when(overlap >= 0.95, F.lit(0.88)).when((overlap >= 0.6) & same_year, F.lit(0.55)).otherwise(F.least(overlap * 0.4, F.lit(0.4)))


# links and generated blocks -----------------------------------------------------------
def ensure_href(body: Column, title: Column, href: Column) -> Column:
    """The body with a list item that links to ``href``, unless it names it."""
    item = F.concat(F.lit("\n\n- ["), title, F.lit("]("), href, F.lit(")\n"))
    return F.when(F.contains(body, href), body).otherwise(F.concat(F.regexp_replace(body, r"\s+$", ""), item))


#: The form of a generated block, its name and its content.
BLOCK = r"<!-- generated:([A-Za-z0-9_-]+) -->\s*([\s\S]*?)\s*<!-- /generated:\1 -->"
_BLOCK_WHOLE = r"(<!-- generated:([A-Za-z0-9_-]+) -->[\s\S]*?<!-- /generated:\2 -->)"


def wrap_generated(name: Column, content: Column) -> Column:
    return F.concat(F.lit("<!-- generated:"), name, F.lit(" -->\n"), strip(content), F.lit("\n<!-- /generated:"), name, F.lit(" -->"))


def generated_blocks(body: Column) -> Column:
    """(name, content) of the generated blocks of a body, in order."""
    pairs = F.arrays_zip(F.regexp_extract_all(body, F.lit(BLOCK), F.lit(1)).alias("name"), F.regexp_extract_all(body, F.lit(BLOCK), F.lit(2)).alias("content"))
    return F.transform(pairs, lambda p: F.struct(p["name"].alias("name"), strip(p["content"]).alias("content")))


def _each_block(body: Column, decide) -> Column:
    """The body with each generated block replaced by ``decide(name, block)``."""
    found = F.arrays_zip(F.regexp_extract_all(body, F.lit(_BLOCK_WHOLE), F.lit(2)).alias("name"), F.regexp_extract_all(body, F.lit(_BLOCK_WHOLE), F.lit(1)).alias("block"))
    between = F.split(body, _BLOCK_WHOLE, -1)
    return let(found, lambda f: F.array_join(F.transform(between, lambda b, i: F.concat(b, F.coalesce(decide(F.get(f, i)["name"], F.get(f, i)["block"]), F.lit("")))), ""))


def strip_generated_blocks(body: Column, names: tuple[str, ...] | None = None) -> Column:
    """The body without its generated blocks, or without the named ones."""
    gone = (lambda name: F.lit(True)) if names is None else (lambda name: name.isin(*names))
    left = strip(F.regexp_replace(_each_block(body, lambda name, block: F.when(gone(name), F.lit("")).otherwise(block)), r"\n{3,}", "\n\n"))
    return F.when(left == "", F.lit("")).otherwise(F.concat(left, F.lit("\n")))


def merged_generated(existing: Column, incoming: Column) -> Column:
    """The existing body with its generated blocks renewed from the incoming one; new ones are appended, human text stays."""
    new = generated_blocks(incoming)

    def renewed(name: Column, block: Column) -> Column:
        found = F.filter(new, lambda b: b["name"] == name)
        return F.when(F.size(found) > 0, wrap_generated(name, F.element_at(found, -1)["content"])).otherwise(block)

    had = F.transform(generated_blocks(existing), lambda b: b["name"])
    names = F.array_distinct(F.transform(new, lambda b: b["name"]))
    more = F.filter(names, lambda n: ~F.array_contains(had, n))
    last = lambda n: F.element_at(F.filter(new, lambda b: b["name"] == n), -1)["content"]
    out = F.aggregate(more, _each_block(existing, renewed), lambda body, n: F.concat(F.regexp_replace(body, r"\s+$", ""), F.lit("\n\n"), wrap_generated(n, last(n)), F.lit("\n")))
    return F.when(F.size(new) == 0, existing).when(out.endswith("\n"), out).otherwise(F.concat(out, F.lit("\n")))


# visual sections ----------------------------------------------------------------------
#: The headings of what was read from page images and of the text layer.
VISUAL, EMBEDDED = "## Visual extracts", "## Embedded text layer"
#: Characters of a page's section below which it counts as empty.
SECTION_CHARS = 10


def strip_visual(body: Column) -> Column:
    """A body without its visual section."""
    at = F.instr(body, f"\n{VISUAL}")
    return F.when(at > 0, F.regexp_replace(F.substring(body, F.lit(1), at - 1), r"\s+$", "")).when(body.startswith(VISUAL), F.lit("")).otherwise(F.regexp_replace(body, r"\s+$", ""))


def merge_visual(layer: Column, visual: Column, scan: Column) -> Column:
    """A text layer and what was read from images: for scans the latter comes first."""
    seen, own = strip(visual), strip(strip_visual(layer))
    scanned = F.when(seen == "", own).when(own == "", F.concat(seen, F.lit("\n"))).otherwise(F.concat(seen, F.lit(f"\n\n{EMBEDDED}\n\n"), own, F.lit("\n")))
    section = F.concat(F.lit(f"{VISUAL}\n\n"), seen, F.lit("\n"))
    plain = F.when(seen == "", F.when(own == "", own).otherwise(F.concat(own, F.lit("\n")))).when(own == "", section).otherwise(F.concat(own, F.lit("\n\n"), section))
    return F.when(scan, scanned).otherwise(plain)


def visual_section(body: Column, scan: Column) -> Column:
    """What a body holds from images, or an empty text."""
    embedded, marked = F.instr(body, f"\n{EMBEDDED}"), F.instr(body, f"\n{VISUAL}")
    scanned = F.when(embedded > 0, strip(F.substring(body, F.lit(1), embedded - 1))).when(body.rlike(r"(?m)^### Page \d+"), strip(body)).otherwise("")
    after = F.when(body.startswith(VISUAL), F.substring(body, F.lit(len(VISUAL) + 1), F.length(body))).when(marked > 0, F.substring(body, marked + len(VISUAL) + 1, F.length(body))).otherwise("")
    return F.when(scan, scanned).otherwise(strip(after))


def join_visual(before: Column, more: Column) -> Column:
    return F.concat_ws("\n\n", F.nullif(strip(before), F.lit("")), F.nullif(strip(more), F.lit("")))


def vision_problem(markdown: Column, pages: Column) -> Column:
    """What is wrong with a transcript of pages: headings that lack, else sections that are as good as empty; null if nothing."""
    heading = r"### Page (\d+)\s*\n"
    numbers = F.regexp_extract_all(markdown, F.lit(heading), F.lit(1))
    bodies = F.slice(F.split(markdown, heading, -1), 2, F.size(numbers) + 1)
    place = lambda p: F.array_position(numbers, p.cast("string"))
    named = lambda some: F.array_join(F.transform(some, lambda p: p.cast("string")), ",")
    missing = F.filter(pages, lambda p: place(p) == 0)
    empty = F.filter(pages, lambda p: (place(p) > 0) & (F.length(strip(F.coalesce(F.get(bodies, (place(p) - 1).cast("int")), F.lit("")))) < SECTION_CHARS))
    return F.when(F.size(missing) > 0, F.concat(F.lit("no heading for pages "), named(missing))).when(F.size(empty) > 0, F.concat(F.lit("hardly any text for pages "), named(empty)))


def page_plan(pages: Column, most: int | None = None) -> Column:
    """Numbers of the pages (``page, text, has_image``) that need vision, the first ``most`` of them."""
    wanted = F.array_sort(F.transform(F.filter(pages, lambda p: needs_vision(p["text"], p["has_image"])), lambda p: p["page"]))
    return wanted if most is None else F.slice(wanted, 1, most)


# replies and scopes -------------------------------------------------------------------
#: Code points that are pictographs by themselves.
PICTOGRAPHS = (
    r"\u00A9\u00AE\u203C\u2049\u2122\u2139\u2194-\u2199\u21A9\u21AA\u231A\u231B\u2328\u2388\u23CF\u23E9-\u23F3\u23F8-\u23FA\u24C2\u25AA\u25AB\u25B6\u25C0\u25FB-\u25FE"
    r"\u2600-\u2605\u2607-\u2612\u2614-\u2685\u2690-\u2705\u2708-\u2712\u2714\u2716\u271D\u2721\u2728\u2733\u2734\u2744\u2747\u274C\u274E\u2753-\u2755\u2757\u2763-\u2767"
    r"\u2795-\u2797\u27A1\u27B0\u27BF\u2934\u2935\u2B05-\u2B07\u2B1B\u2B1C\u2B50\u2B55\u3030\u303D\u3297\u3299"
    r"\x{1F000}-\x{1F0FF}\x{1F10D}-\x{1F10F}\x{1F12F}\x{1F16C}-\x{1F171}\x{1F17E}\x{1F17F}\x{1F18E}\x{1F191}-\x{1F19A}\x{1F1AD}-\x{1F1E5}\x{1F201}-\x{1F20F}\x{1F21A}\x{1F22F}"
    r"\x{1F232}-\x{1F23A}\x{1F23C}-\x{1F23F}\x{1F249}-\x{1F3FA}\x{1F400}-\x{1F53D}\x{1F546}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F774}-\x{1F77F}\x{1F7D5}-\x{1F7FF}\x{1F80C}-\x{1F80F}"
    r"\x{1F848}-\x{1F84F}\x{1F85A}-\x{1F85F}\x{1F888}-\x{1F88F}\x{1F8AE}-\x{1F8FF}\x{1F90C}-\x{1F93A}\x{1F93C}-\x{1F945}\x{1F947}-\x{1FAFF}\x{1FC00}-\x{1FFFD}"
)


def strip_emoji(value: Column) -> Column:
    """A text without pictographs, their joiners and variants; the blanks that they leave shrink."""
    bare = F.regexp_replace(value, rf"[{PICTOGRAPHS}](?:[\uFE0F\uFE0E]?\u200D[{PICTOGRAPHS}])*|[\x{{1F3FB}}-\x{{1F3FF}}\u20E3\uFE0F\uFE0E]", "")
    return strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"[ \t]+\n", "\n"), " {2,}", " "), r"\n{3,}", "\n\n"))


def parse_reply(raw: Column) -> Column:
    """(thinking, answer) of a model's reply: closed thoughts, then one left open, and what remains."""
    closed = r"(?is)<think(?:ing)?\b[^>]*>(.*?)</think(?:ing)?>"
    opened = r"(?is)<think(?:ing)?\b[^>]*>(.*)$"
    rest = F.regexp_replace(raw, closed, "\n")
    thoughts = F.concat(F.regexp_extract_all(raw, F.lit(closed), F.lit(1)), F.regexp_extract_all(rest, F.lit(opened), F.lit(1)))
    answer = F.regexp_replace(F.regexp_replace(rest, opened, ""), r"(?i)</think(?:ing)?>", "")
    return F.struct(F.filter(F.transform(thoughts, strip_emoji), lambda t: t != "").alias("thinking"), strip_emoji(answer).alias("answer"))


def coverage_years(question: Column) -> Column:
    """(low, high) of the years from 1900 to 2099 that a question names; null without any."""
    years = F.regexp_extract_all(question, F.lit(r"(?<![A-Za-z0-9_])((?:19|20)\d{2})(?![A-Za-z0-9_])"), F.lit(1))
    return F.struct(F.array_min(years).alias("low"), F.array_max(years).alias("high"))


def asks_coverage(question: Column) -> Column:
    return question.rlike(r"(?i)缺口|空白|缺年|覆盖|coverage|(?<![A-Za-z0-9_])gap(?![A-Za-z0-9_])|missing year|which years|未定期")


# manuscripts --------------------------------------------------------------------------
def latex_body(markdown: Column) -> Column:
    """Headings and strong words of a body as LaTeX commands; titles are escaped line by line."""
    def line(x: Column) -> Column:
        level = F.length(F.regexp_extract(x, "^(#{1,4}) (.+)$", 1))
        command = F.get(F.array(*map(F.lit, ("", r"\section*", r"\section", r"\subsection", r"\subsubsection"))), level)
        return F.when(level > 0, F.concat(command, F.lit("{"), escape_latex_text(F.regexp_extract(x, "^(#{1,4}) (.+)$", 2)), F.lit("}"))).otherwise(x)

    return F.regexp_replace(F.array_join(F.transform(F.split(markdown, "\n"), line), "\n"), r"\*\*([^*]+)\*\*", r"\\textbf{$1}")


def escape_latex_text(value: Column) -> Column:
    """The special characters of LaTeX as commands; each is met once."""
    swaps = {"\\": r"\textbackslash{}", "{": r"\{", "}": r"\}", "$": r"\$", "&": r"\&", "#": r"\#", "^": r"\textasciicircum{}", "_": r"\_", "%": r"\%", "~": r"\textasciitilde{}"}
    table = F.create_map(*[F.lit(x) for pair in swaps.items() for x in pair])
    characters = F.filter(F.split(value, ""), lambda c: c != "")
    return F.array_join(F.transform(characters, lambda c: F.coalesce(F.try_element_at(table, c), c)), "")


def latex_document(title: Column, body: Column, stem: Column) -> Column:
    head = F.concat(F.lit("\\documentclass{article}\n\\usepackage{hyperref}\n\\title{"), escape_latex_text(title), F.lit("}\n\\begin{document}\n\\maketitle\n\n"))
    return F.concat(head, strip(latex_body(body)), F.lit("\n\n\\bibliographystyle{plain}\n\\bibliography{"), stem, F.lit("}\n\\end{document}\n"))


def pandoc_document(title: Column, body: Column) -> Column:
    return F.concat(F.lit('---\ntitle: "'), F.regexp_replace(title, r'([\\"])', r"\\$1"), F.lit('"\n---\n\n'), strip(body), F.lit("\n"))


def manuscript_stem(path: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(path, "^/*surveys/", ""), r"(?i)\.md$", "")
    return F.coalesce(F.nullif(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "-"), F.lit("")), F.lit("survey"))


# messages -----------------------------------------------------------------------------
#: The form of an image that a message holds.
DATA_URL = r"(?i)^data:image/(png|jpeg|jpg|webp|gif);base64,([A-Za-z0-9+/]+={0,2})$"


def message_text(parts: Column) -> Column:
    """The text of a message's parts (``type, text``)."""
    return F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), "")


def system_text(messages: Column) -> Column:
    """What the system messages (``role, content``) of a conversation say together; null if nothing."""
    said = F.transform(F.filter(messages, lambda m: (m["role"] == "system") & (strip(m["content"]) != "")), lambda m: m["content"])
    return F.when(F.size(said) > 0, F.array_join(said, "\n\n"))


def image_of(url: Column) -> Column:
    """(media type, bytes) of a data URL of an image, or null for anything else."""
    kind = F.lower(F.regexp_extract(strip(url), DATA_URL, 1))
    content = F.try_to_binary(F.regexp_extract(strip(url), DATA_URL, 2), F.lit("base64"))
    known = strip(url).rlike(DATA_URL) & content.isNotNull() & (F.octet_length(content) > 0)
    return F.when(known, F.struct(F.concat(F.lit("image/"), F.when(kind == "jpg", "jpeg").otherwise(kind)).alias("media"), content.alias("content")))


def remaining(planned: Column, done: Column) -> Column:
    """What is planned and not done yet, in order."""
    return F.array_except(planned, F.coalesce(done, F.array().cast("array<int>")))
