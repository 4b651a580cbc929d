"""Quality rules: document rules, and host verdicts shrunk by an empirical beta prior.

Each document is measured by built-in expressions only. The failures of every rule are
counted by host, each host's rate is shrunk to the corpus rate by a beta prior whose
strength the spread between hosts gives (moments), and hosts whose shrunk rate is over the
limit are rejected; the verdict is joined back to the documents.

Edge cases: a null or empty text has no words and fails the base rule; a null host is a
host of its own; repeated rows count and return as often as they occur; an empty table
gives an empty result; other columns of the input never meet the operator's own names,
because each row travels as one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, WORD_GAP, Scratch, join_small, let

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW_WORDS = 5
#: A host goes when its shrunk failure rate of some rule is over this.
MAX_HOST_RATE = 0.8
#: Bounds of the prior's strength, in documents.
PRIOR_MIN, PRIOR_MAX = 2.0, 10_000.0
RULES = ("base", "symbols", "lines", "lengths")


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{WORD_GAP}]+"))


def repeated_words(words: Column) -> Column:
    """How many words lie in windows that occur at least twice in the text.

    Window hashes are sorted with their places; equal neighbours are repeats, and each
    repeat covers the words up to the next repeat or its own end. Texts whose windows all
    differ, most of them, end after the distinct count.
    """
    n = F.size(words)

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(pairs: Column) -> Column:
            last = F.size(pairs) - 1
            twin = F.filter(pairs, lambda p, j: ((j > 0) & (F.get(pairs, j - 1).h == p.h)) | ((j < last) & (F.get(pairs, j + 1).h == p.h)))
            return F.sort_array(F.transform(twin, lambda p: p.i))

        def total(at: Column) -> Column:
            steps = F.transform(at, lambda x, j: F.least(F.lit(WINDOW_WORDS), F.coalesce(F.get(at, j + 1) - x, F.lit(WINDOW_WORDS))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return let(let(placed, starts), total)

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered(hashes))

    hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW_WORDS - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW_WORDS)))
    return F.when(n < WINDOW_WORDS + 1, F.lit(0)).otherwise(let(hashes, count)).cast("long")


def duplicate_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def measure(docs: DataFrame, text: str, host: str, without: tuple[str, ...] = ()) -> DataFrame:
    """Each row, but for the columns ``without``, as a struct with its host and its measures."""
    split = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in without]).alias("row"), F.col(f"`{text}`").alias("t"), F.col(f"`{host}`").cast("string").alias("host"))
    split = split.select("row", "host", F.coalesce("t", F.lit("")).alias("t"), words_of(F.col("t")).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return split.select(
        "row",
        "host",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), duplicate_lines(x).alias("dup"))).alias("lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
    ).select("row", "host", "n_words", "word_chars", "n_symbols", F.col("lines.n").alias("n_lines"), F.col("lines.dup").alias("n_dup_lines"), "n_repeat_words")


def failures() -> dict[str, Column]:
    """For each rule whether the measured document fails it."""
    n = F.col("n_words")
    return {
        "base": (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n),
        "symbols": 2 * F.col("n_symbols") > n,
        "lines": 2 * F.col("n_dup_lines") > F.col("n_lines"),
        "lengths": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n),
    }


def host_verdicts(measured: DataFrame) -> DataFrame:
    """One row for each host: shrunk failure rate of each rule and whether the host is rejected."""
    fails = failures()
    scratch = Scratch(measured.sparkSession)
    hosts = scratch.keep(measured.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(fails[r]).alias(f"f_{r}") for r in RULES]))
    total = hosts.agg(F.sum("n").alias("docs"), F.count(F.lit(1)).alias("hosts"), *[F.sum(f"f_{r}").alias(r) for r in RULES]).first()
    docs = total.docs or 1
    mean = {r: (total[r] or 0) / docs for r in RULES}
    spread = hosts.agg(*[F.sum(F.col("n") * F.pow(F.col(f"f_{r}") / F.col("n") - F.lit(mean[r]), 2)).alias(r) for r in RULES]).first()
    rates = []
    for r in RULES:
        bernoulli = mean[r] * (1 - mean[r])
        excess = (spread[r] or 0.0) / docs - bernoulli * total.hosts / docs
        strength = min(max(bernoulli / excess - 1, PRIOR_MIN), PRIOR_MAX) if excess > 0 else PRIOR_MAX
        rates.append(((F.col(f"f_{r}") + F.lit(mean[r] * strength)) / (F.col("n") + F.lit(strength))).alias(f"rate_{r}"))
    return hosts.select("host", "n", *rates).withColumn("host_rejected", F.greatest(*[F.col(f"rate_{r}") for r in RULES]) > MAX_HOST_RATE)


def judge(docs: DataFrame, text: str = "text", host: str = "source", without: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``docs`` as the struct ``row`` with its measures, its host's rates and ``kept``."""
    scratch = Scratch(docs.sparkSession)
    measured = scratch.keep(measure(docs, text, host, without))
    verdicts = host_verdicts(measured).withColumnRenamed("host", "of").withColumnRenamed("n", "host_docs")
    verdicts = scratch.keep(verdicts)
    joined = join_small(measured, verdicts, F.col("host").eqNullSafe(F.col("of")))
    failed = failures()["base"]
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.col("host_rejected")).drop("of")


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that neither their own measures nor their host reject."""
    return judge(docs, text, host).filter("kept").select("row.*")


def quality_report(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    judged = judge(docs.select("doc_id", "source", "text"), without=("text",))
    return judged.select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected")


ORACLE = """
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
d AS (
  SELECT row_number() OVER () AS k, doc_id, source, t, w, len(w) AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM w),
g AS (
  SELECT k, i, array_to_string(w[i:i+4], ' ') AS five FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, five) AS c FROM g) WHERE c > 1),
c AS (SELECT k, count(DISTINCT j) AS n_repeat_words FROM (SELECT k, unnest(range(i, i + 5)) AS j FROM r) GROUP BY k),
m AS (
  SELECT d.k, doc_id, source, n_words, word_chars, n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN c ON d.k = c.k),
f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base, 2 * n_symbols > n_words AS symbols,
         2 * n_dup_lines > n_lines AS lines, word_chars < 2 * n_words OR word_chars > 20 * n_words AS lengths FROM m),
h AS (
  SELECT source, rule, count(*)::DOUBLE AS n, count(*) FILTER (failed)::DOUBLE AS f
  FROM (SELECT source, unnest(['base', 'symbols', 'lines', 'lengths']) AS rule, unnest([base, symbols, lines, lengths]) AS failed FROM f)
  GROUP BY ALL),
p AS (SELECT rule, sum(f) / sum(n) AS mu, sum(n) AS docs, count(*) AS hosts FROM h GROUP BY rule),
v AS (SELECT h.rule, any_value(mu) AS mu, sum(n * (f / n - mu) ** 2) / any_value(docs) - any_value(mu * (1 - mu) * hosts / docs) AS excess
      FROM h JOIN p USING (rule) GROUP BY h.rule),
s AS (SELECT rule, mu, CASE WHEN excess > 0 THEN least(greatest(mu * (1 - mu) / excess - 1, 2.0), 10000.0) ELSE 10000.0 END AS strength FROM v),
b AS (SELECT source, max((f + mu * strength) / (n + strength)) > 0.8 AS host_rejected FROM h JOIN s USING (rule) GROUP BY source)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base AS base_failed, NOT base AND NOT host_rejected AS kept, host_rejected
FROM f JOIN b ON f.source IS NOT DISTINCT FROM b.source
"""
