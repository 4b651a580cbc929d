"""Entity resolution of hubs: alignment keys, candidate pairs, merge reasons, canonical choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellore.functions import text
from tessellore.operators.align import TOKEN_TYPES, Index, align_keys, blocks_of, classes_of, contained, dealt, in_blocks, label_pairs, lookup, names_of
from tessellore.storage import cut

EDIT_MOST, EDIT_LENGTH = 2, 6


#: Keys of up to so many characters meet on deletion variants, those of at least so many on segments.
VARIANT_LENGTH, SEGMENT_LENGTH = 20, 18


def _segments(length: Column, parts: int) -> list[tuple[Column, Column]]:
    """(start from 1, size) of the even parts of a key of some length."""
    cut = [F.floor(length * i / parts).cast("int") for i in range(parts + 1)]
    return [(cut[i] + 1, cut[i + 1] - cut[i]) for i in range(parts)]


def segment_probes(keys: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Two sets of ``type, key, probe`` on which long keys within ``most`` edits meet.

    Of most + 1 even parts of a key one stays whole, shifted by no more than the edits. The
    first set has each key's own parts, the second what lies at the places of such parts in
    keys of about its length: a number of probes that doesn't grow with the key.
    """
    parts = most + 1
    probe = lambda length, i, piece: F.concat_ws("\x1f", F.lit("s"), length.cast("string"), F.lit(str(i)), piece)
    size = F.length("key")
    own = F.array(*[probe(size, i, F.substring("key", at, n)) for i, (at, n) in enumerate(_segments(size, parts))])
    met = []
    for change in range(-most, most + 1):
        length = size + change
        for i, (at, n) in enumerate(_segments(length, parts)):
            for shift in range(-most, most + 1):
                start = at + shift
                inside = (start >= 1) & (start + n - 1 <= size)
                met.append(F.when(inside, probe(length, i, F.substring("key", start, n))))
    long = keys.filter(size >= SEGMENT_LENGTH)
    return long.select("type", "key", F.explode(own).alias("probe")), long.select("type", "key", F.explode(F.array_distinct(F.array_compact(F.array(*met)))).alias("probe"))


def edit_keys(keys: DataFrame, most: int = EDIT_MOST) -> DataFrame:
    """``type, ka, kb, distance`` of different keys (``type, key``) of one type within ``most`` edits, ka < kb.

    Short keys meet on shared deletion variants, whose number grows with the square of the
    key, long ones on a part that stays whole; both are equi-joins, then pairs are measured.
    """
    distinct = keys.filter(F.length("key") >= EDIT_LENGTH).select("type", "key").distinct()
    probes = distinct.filter(F.length("key") <= VARIANT_LENGTH).select("type", "key", F.explode(text.deletion_variants(F.col("key"), most)).alias("probe"))
    own, near = segment_probes(distinct, most)
    left, right = probes.unionByName(own).withColumnRenamed("key", "ka"), probes.unionByName(near).withColumnRenamed("key", "kb")
    met = left.join(right, ["type", "probe"]).filter("ka <> kb").select("type", F.least("ka", "kb").alias("ka"), F.greatest("ka", "kb").alias("kb")).distinct()
    return met.withColumn("distance", F.levenshtein("ka", "kb", most)).filter("distance >= 0")


def edit_pairs(hubs: DataFrame, most: int = EDIT_MOST) -> DataFrame:
    """Pairs ``a, b, distance`` of paths of one type whose keys differ by at most ``most`` edits."""
    keyed = hubs.select("type", "path", text.align_key(F.col("title")).alias("key"))
    paths = keyed.filter(F.length("key") >= EDIT_LENGTH)
    a = edit_keys(keyed, most).join(paths.select("type", F.col("key").alias("ka"), F.col("path").alias("a")), ["type", "ka"])
    return a.join(paths.select("type", F.col("key").alias("kb"), F.col("path").alias("b")), ["type", "kb"]).select("type", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("distance").cast("int").alias("distance"))


def merge_reason(kind: Column, a_title: Column, b_title: Column, a_aliases: Column, b_aliases: Column) -> Column:
    """Why two hubs of one type may merge without a human, or null; an ordered decision list.

    Titles that differ in case only are no versions of one another: they merge by their title.
    """
    ka, kb = text.align_key(a_title), text.align_key(b_title)
    keys = lambda title, key, aliases: F.array_union(F.array(key), F.transform(names_of(title, aliases), text.align_key))
    shared = F.filter(F.array_intersect(keys(a_title, ka, a_aliases), keys(b_title, kb, b_aliases)), lambda k: (k != "") & ~text.symbol_pair(k, F.when(ka == k, kb).otherwise(ka)))
    distance = F.levenshtein(ka, kb, EDIT_MOST)
    labels = lambda title, aliases: F.transform(F.concat(F.array(title), names_of(title, aliases)), text.align_tokens)

    def of_labels(x: Column, y: Column) -> Column:
        """What two labels' tokens say."""
        within = F.coalesce(text.token_match(x, y), text.token_match(y, x))
        return F.when(within == "equal", "token:equal").when((within == "existing-in-incoming") & (F.abs(F.size(x) - F.size(y)) <= 2), "token:contain")

    # all labels of one against all of the other, in order; the first pair that says something decides
    said = F.flatten(F.transform(labels(a_title, a_aliases), lambda x: F.transform(labels(b_title, b_aliases), lambda y: of_labels(x, y))))
    return (
        F.when(text.version_pair(F.lower(a_title), F.lower(b_title)) | text.symbol_pair(ka, kb), F.lit(None).cast("string"))
        .when((ka != "") & (ka == kb), F.lit("align:title"))
        .when(F.size(shared) > 0, F.lit("align:alias"))
        .when(kind == "Gene", F.lit(None).cast("string"))
        .when((F.length(ka) >= EDIT_LENGTH) & (F.length(kb) >= EDIT_LENGTH) & (distance > 0), F.concat(F.lit("edit-distance:"), distance.cast("string")))
        .when(~kind.isin(*TOKEN_TYPES), F.lit(None).cast("string"))
        .otherwise(F.get(F.array_compact(said), F.lit(0)))
    )


#: Reasons as numbers, the least of which decides: a shared title, a shared name, edits and from this one on tokens,
#: by the places of the two labels; even for equal ones.
_TITLE, _NAME, _TOKENS = 0, 1, 16


def _reason_name(code: str) -> Column:
    c = F.col(code)
    tokens = F.when(c % 2 == 0, "token:equal").otherwise("token:contain")
    return F.when(c == _TITLE, "align:title").when(c == _NAME, "align:alias").when(c < _TOKENS, F.concat(F.lit("edit-distance:"), (c - _NAME).cast("string"))).otherwise(tokens)


def _by_keys(classes: DataFrame) -> DataFrame:
    """``x, y, on, back`` of classes that share the key of a title or name."""
    keyed = cut(classes.select("class", "type", "key", "sign", F.explode("keys").alias("k")).filter("k <> ''").select("class", "type", "sign", "k", F.expr("k = key").alias("own")))
    side = lambda name, n: keyed.select("type", "k", F.col("class").alias(name), F.col("own").alias(f"own{n}"), F.col("sign").alias(f"sign{n}"))
    mark, other = text.symbol(F.col("k")), F.when(F.col("own1"), F.col("sign2")).otherwise(F.col("sign1"))
    code = F.when(F.col("own1") & F.col("own2"), _TITLE).when(mark.isNull() | other.isNull() | (mark == other), _NAME).cast("long")
    return side("x", 1).join(side("y", 2), ["type", "k"]).filter("x <= y").select("x", "y", code.alias("on"), code.alias("back")).filter("on IS NOT NULL")


def _by_edits(classes: DataFrame) -> DataFrame:
    """``x, y, on, back`` of classes whose titles differ by few edits."""
    keyed = classes.filter("type <> 'Gene'").select("type", "key", "class")
    side = lambda name, key: keyed.select("type", F.col("key").alias(key), F.col("class").alias(name))
    met = edit_keys(dealt(keyed.select("type", "key"), "key")).join(side("x", "ka"), ["type", "ka"]).join(side("y", "kb"), ["type", "kb"])
    code = F.col("distance").cast("long") + _NAME
    return met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), code.alias("on"), code.alias("back"))


def _by_tokens(classes: DataFrame) -> DataFrame:
    """``x, y, on, back`` of classes with labels of the same tokens, or of some of the other's and no more than two others."""
    spread = classes.filter(F.col("type").isin(*TOKEN_TYPES)).select("class", "type", F.posexplode("labels").alias("at", "tokens")).filter(F.size("tokens") > 0)
    spread = cut(spread.groupBy("class", "type", "tokens").agg(F.min("at").cast("long").alias("at")))
    sets = cut(spread.select("type", "tokens").distinct().withColumn("set", F.monotonically_increasing_id()))
    held = cut(spread.join(sets, ["type", "tokens"]).select("set", "class", "at"))
    known = lambda name: sets.select("type", F.col("tokens").alias(name), F.col("set").alias(f"{name}_set"))
    telling = sets.filter((F.size("tokens") >= 2) | (F.length(F.get("tokens", F.lit(0))) >= 5))
    inside = contained(telling, sets).filter(F.size("small") < F.size("large")).filter(F.size("large") - F.size("small") <= 2)
    inside = inside.join(known("small"), ["type", "small"]).join(known("large"), ["type", "large"]).select("small_set", "large_set", F.lit(1).alias("more"))
    match = inside.unionByName(sets.select(F.col("set").alias("small_set"), F.col("set").alias("large_set"), F.lit(0).alias("more")))
    side = lambda of, name, at: held.select(F.col("set").alias(of), F.col("class").alias(name), F.col("at").alias(at))
    met = cut(match).join(side("small_set", "p", "i"), "small_set").join(side("large_set", "q", "j"), "large_set").filter("more = 1 OR p <= q")
    code = lambda i, j: F.shiftleft(i, 32) + F.shiftleft(j, 1) + F.col("more") + _TOKENS
    there, here = code("i", "j"), code("j", "i")
    turned = F.col("p") > F.col("q")
    # of one class both orders are met at once: the first label that meets another decides
    on = F.when(F.col("p") == F.col("q"), F.least(there, here)).when(turned, here).otherwise(there)
    back = F.when(F.col("p") == F.col("q"), F.least(there, here)).when(turned, there).otherwise(here)
    return met.select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"), on.alias("on"), back.alias("back"))


def merge_reasons(hubs: DataFrame) -> DataFrame:
    """``a, b, reason`` of all hubs (``type, path, title, aliases``) that may merge without a human, a < b: what ``merge_reason`` says of each pair.

    Hubs of which ``merge_reason`` reads the same are one class. Classes meet by keys, edits
    and tokens, the least number of a reason decides, for each order of the two as tokens
    go by the first one's labels; hubs are paired from classes at the very end.
    """
    title = F.col("title")
    names = F.concat(F.array("title"), names_of(title, F.col("aliases")))
    keys = F.array_sort(F.array_distinct(F.transform(names, text.align_key)))
    labels = F.transform(names, lambda t: F.array_sort(text.align_tokens(t)))
    read = {"key": text.align_key(title), "stem": text.version_stem(title), "flat": text.unspaced(F.lower(title)), "keys": keys, "labels": labels}
    rows = cut(hubs.filter("title IS NOT NULL").select("type", "path", *[c.alias(n) for n, c in read.items()]))
    by = ["type", *read]
    known = classes_of(rows, by)
    blocks = blocks_of(in_blocks(rows, known, by, "path"), "path")
    # stems count only where one of the titles has a version
    versions = known.filter(text.unspaced(F.col("stem")) != F.col("flat")).filter("stem <> ''").select("type", "stem").distinct().withColumn("versions", F.lit(True))
    several = F.col("versions").isNotNull()
    shown = {"stem": F.when(several, F.col("stem")), "flat": F.when(several, F.col("flat")), "sign": text.symbol(F.col("key"))}
    classes = cut(known.join(versions, ["type", "stem"], "left").withColumns(shown).drop("versions"))
    met = _by_keys(classes).unionByName(_by_edits(classes)).unionByName(_by_tokens(classes)).groupBy("x", "y").agg(F.min("on").alias("on"), F.min("back").alias("back"))
    members = blocks.join(classes.select("class", "n", "stem", "flat", "sign"), "class")
    side = lambda name, of, n: members.select(F.col("class").alias(name), F.col("members").alias(of), F.col("block").alias(f"block{n}"), *[F.col(c).alias(f"{c}{n}") for c in ("n", "stem", "flat", "sign")])
    near = met.join(side("x", "p", 1), "x").filter("x < y OR n1 > 1")
    near = dealt(near, "y").join(dealt(side("y", "q", 2), "y"), "y").filter("x < y OR block1 <= block2")
    apart = (F.col("stem1") == F.col("stem2")) & (F.col("flat1") != F.col("flat2")) | (F.col("sign1") != F.col("sign2"))
    near = near.filter(~F.coalesce(apart, F.lit(False))).select(F.expr("x = y AND block1 = block2").alias("one"), "p", "q", _reason_name("on").alias("on"), _reason_name("back").alias("back"))
    pairs = near.select("one", "on", "back", "q", F.explode("p").alias("p")).select("one", "on", "back", "p", F.explode("q").alias("q")).filter("NOT one OR p < q")
    return pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.when(F.col("p") < F.col("q"), F.col("on")).otherwise(F.col("back")).alias("reason"))


def near_duplicate_reason(kind: Column, a_title: Column, b_title: Column) -> Column:
    """The looser rule of the review queue: versions may pair, genes too."""
    ka, kb = text.align_key(a_title), text.align_key(b_title)
    distance = F.levenshtein(ka, kb, EDIT_MOST)
    ta, tb = text.align_tokens(a_title), text.align_tokens(b_title)
    return (
        F.when(ka == kb, F.lit("align:title"))
        .when(text.slug(a_title) == text.slug(b_title), F.lit("align:slug"))
        .when(text.stem_key(ka) == text.stem_key(kb), F.lit("align:stem"))
        .when((F.length(ka) >= EDIT_LENGTH) & (F.length(kb) >= EDIT_LENGTH) & (distance > 0) & ~text.symbol_pair(ka, kb), F.concat(F.lit("edit-distance:"), distance.cast("string")))
        .when(kind.isin(*TOKEN_TYPES) & text.tokens_equal(ta, tb), F.lit("token:equal"))
        .when(kind.isin(*TOKEN_TYPES) & F.coalesce(text.token_match(ta, tb), text.token_match(tb, ta)).isNotNull(), F.lit("token:contain"))
    )


def candidate_pairs(hubs: DataFrame) -> DataFrame:
    """``type, a, b``: hubs of one type that share a key, a deletion variant of one, or of which a label's tokens lie in a label of the other, each pair once."""
    probes = align_keys(hubs).select("type", F.col("key").alias("probe"), "path")
    met = probes.select("type", "probe", F.col("path").alias("a")).join(probes.select("type", "probe", F.col("path").alias("b")), ["type", "probe"]).filter("a < b").select("type", "a", "b")
    return met.unionByName(edit_pairs(hubs).select("type", "a", "b").filter("a < b")).unionByName(label_pairs(hubs)).distinct()


def similar_titles(titles: DataFrame, least: float) -> DataFrame:
    """``a, b, score`` of titles (``title, tokens``) whose token sets have a Jaccard similarity of at least ``least``.

    Of a set of n tokens only the n - ceil(least * n) + 1 rarest are looked up, in an order
    that all share; two sets that are similar enough have one of them in common.
    """
    spread = titles.select("title", F.explode("tokens").alias("token"))
    counts = spread.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ordered = spread.join(counts, "token").groupBy("title").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    n = F.size("t")
    prefix = ordered.select("title", F.explode(F.slice("t", 1, n - F.ceil(F.lit(least) * n - 1e-9).cast("int") + 1)).alias("p")).select("title", "p.token")
    met = prefix.withColumnRenamed("title", "a").join(prefix.withColumnRenamed("title", "b"), "token").filter("a < b").select("a", "b").distinct()
    side = lambda c: titles.select(F.col("title").alias(c), F.col("tokens").alias(f"k{c}"))
    return met.join(side("a"), "a").join(side("b"), "b").select("a", "b", text.jaccard(F.col("ka"), F.col("kb")).alias("score")).filter(F.col("score") >= least)


def canonical(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """``a, b, keep, drop``: more paper links, then the shorter path, then the lesser one (``links``: path, n)."""
    n = lambda side: links.select(F.col("path").alias(side), F.col("n").alias(f"n_{side}"))
    met = pairs.join(n("a"), "a", "left").join(n("b"), "b", "left").na.fill(0, ["n_a", "n_b"])
    first = F.struct(-F.col("n_a"), F.length("a"), F.col("a")) < F.struct(-F.col("n_b"), F.length("b"), F.col("b"))
    return met.select("a", "b", F.when(first, F.col("a")).otherwise(F.col("b")).alias("keep"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("drop"))


def vocabulary(concepts: DataFrame) -> DataFrame:
    """``type, path, title, aliases`` of the hubs that titles are aligned with: neither deprecated nor redirects."""
    from tessellore import schema

    canonical = F.col("canonical") if "canonical" in concepts.columns else F.lit(None).cast("string")
    kept = concepts.filter(F.col("type").isin(*schema.HUB_TYPES) & schema.live(F.col("status")) & canonical.isNull())
    return kept.select("type", "path", "title", "aliases")


def alias_prompts(incoming: DataFrame, known: Index, library: DataFrame, *, new: int = 24, old: int = 100) -> DataFrame:
    """``type, prompt`` for a model that names synonyms: per type, titles (``type, title``) that align with nothing and the library's titles, both cut."""
    probes = incoming.select(F.concat_ws("\x1f", "type", "title").alias("probe"), "type", "title").distinct()
    free = probes.join(lookup(known, probes).select("probe"), "probe", "left_anti")
    first = lambda frame, n: frame.withColumn("n", F.row_number().over(Window.partitionBy("type").orderBy("title"))).filter(F.col("n") <= n).groupBy("type").agg(F.array_sort(F.collect_list("title")).alias("titles"))
    a, b = first(free, new), first(library.select("type", "title").distinct(), old)
    body = F.concat(F.lit("New: "), F.to_json("titles"), F.lit("\nKnown: "), F.to_json(F.coalesce("known", F.array().cast("array<string>"))))
    return a.join(b.withColumnRenamed("titles", "known"), "type", "left").select("type", body.alias("prompt"))


def suggestion(reason: Column, left: Column, right: Column) -> Column:
    """Which side of a near-duplicate pair a reviewer is told to keep: both, left or right."""
    a, b = F.trim(left), F.trim(right)
    apart = text.symbol_pair(a, b) | text.version_pair(a, b)
    longer = F.contains(reason, F.lit("token:contain")) & (F.length(a) > F.length(b))
    return F.when(apart, "both").when(longer, "left").otherwise("right")


def biblio_gaps(papers: DataFrame) -> DataFrame:
    """One row of counts over live papers (``status, published, doi, biblio``): no date, no DOI, a bibliography hit that waits."""
    kept = papers.filter(F.coalesce("status", F.lit("")) != "deprecated")
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return kept.agg(F.count_if(empty("published")).alias("missing_published"), F.count_if(text.normalize_doi(F.coalesce("doi", F.lit(""))).isNull()).alias("missing_doi"), F.count_if(F.coalesce(F.col("biblio") == "suggested", F.lit(False))).alias("low_confidence"))


def unite(first: Column, second: Column) -> Column:
    """Two lists as one, each value once, in order."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(first, none), F.coalesce(second, none)))


def unite_aliases(first: Column, second: Column) -> Column:
    """Aliases of two pages: of those with one alignment key the first stays."""
    both = unite(first, second)
    return text.let(F.transform(both, text.align_key), lambda keys: F.filter(both, lambda a, i: F.array_position(keys, text.align_key(a)) == i + 1))
