"""Lines that many documents share are dropped from all of them.

Built-in expressions only. Each text is split once; what goes on are 128-bit hashes of its
normalised lines. The distinct hashes of a document are exploded and counted, combined in
each task before they are shuffled. The hashes of common lines meet the exploded lines
with their positions: they are broadcast if a count shows them to be few, else both sides
shuffle and adaptive execution splits the hot lines. What is gathered by document are only
the positions of dropped lines; the text is put together from the positions that remain.

A line's key is the line without blanks at both ends, its A-Z in lower case. Two keys are
told apart by two 64-bit hashes with different seeds.

Edge cases: a null or empty text is one empty line; a key that is too short, so each blank
line, is never dropped; a line that a document repeats counts once for it, but all its
occurrences go; if all lines go, the empty text is left; each row counts as a document and
returns as often as it occurs, also with equal or null ids; texts of any length are read
whole; an empty table gives an empty result; other columns of the input never meet the
operator's own names, because each row travels as one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, Scratch, join_small

MIN_DOCS = 10
MIN_CHARS = 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Common lines that may be broadcast, two numbers each.
BROADCAST_LINES = 1_000_000


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else; a text of ASCII takes the faster function."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_hashes(text: Column, min_chars: int) -> Column:
    """For each line the hashes of its key, null for a key that is too short."""
    keys = F.transform(F.split(lower_ascii(text), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))
    return F.transform(keys, lambda k: F.when(F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), k).alias("b"))))


def name_of(of: Column, text: Column) -> list[Column]:
    """A row's name, two hashes of its id and text: rows of one name have the same lines."""
    parts = [of.isNull(), of, text]
    return [F.xxhash64(*parts).alias("r"), F.xxhash64(F.lit(1), *parts).alias("s")]


def common_lines(hashed: DataFrame, min_docs: int) -> DataFrame:
    """``a, b`` of the keys found in at least ``min_docs`` rows of ``hashes``."""
    once = hashed.select(F.explode(F.array_distinct("hashes")).alias("h")).filter("h IS NOT NULL").select("h.a", "h.b")
    return once.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs).select("a", "b")


def drop_lines(docs: DataFrame, of: str = "doc_id", text: str = "text", *, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, without: tuple[str, ...] = ()) -> DataFrame:
    """Every row of ``docs``, but for the columns ``without``, as the struct ``row``; ``n_lines``, ``n_dropped`` and the text ``kept``."""
    scratch = Scratch(docs.sparkSession)
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    hashed = scratch.keep(docs.select(*name_of(F.col(f"`{of}`"), whole), line_hashes(whole, min_chars).alias("hashes")))
    common = scratch.keep(common_lines(hashed, min_docs))
    placed = hashed.select("r", "s", F.posexplode("hashes").alias("at", "h")).filter("h IS NOT NULL").select("r", "s", "at", F.col("h.a").alias("x"), F.col("h.b").alias("y"))
    met = join_small(placed, common, (F.col("x") == F.col("a")) & (F.col("y") == F.col("b")), "inner", limit=BROADCAST_LINES)
    gone = scratch.keep(met.groupBy(F.col("r").alias("gr"), F.col("s").alias("gs")).agg(F.collect_set("at").alias("gone")))
    scratch.drop(hashed, common)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in without]).alias("row"), whole.alias("t"), *name_of(F.col(f"`{of}`"), whole))
    joined = join_small(rows, gone, (F.col("r") == F.col("gr")) & (F.col("s") == F.col("gs")), array_bytes=16 * F.size("gone"))
    lines = F.split("t", "\n")
    rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))  # both are sets of places, in the order of the first
    split = joined.select("row", "t", "gone", lines.alias("lines"), F.when(F.col("gone").isNotNull(), rest).alias("rest"))
    kept = F.when(F.col("gone").isNull(), F.col("t")).otherwise(F.array_join(F.transform("rest", lambda i: F.get("lines", i)), "\n"))
    return split.select("row", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def line_report(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    done = drop_lines(docs.select("doc_id", "text"), without=("text",))
    return done.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM d),
k AS (SELECT r, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
m AS (SELECT r, count(*) AS n_lines, count(c.key) AS n_dropped, coalesce(string_agg(CASE WHEN c.key IS NULL THEN line END, chr(10) ORDER BY pos), '') AS kept
      FROM k LEFT JOIN c ON k.key = c.key GROUP BY r)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, sha256(kept) AS kept_sha256 FROM m JOIN d USING (r)
"""
