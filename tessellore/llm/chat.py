"""Chat formatting with collapse of cumulative snapshots.

A log often holds one conversation many times, each time a turn or two longer. Every
conversation gets rolling hashes of its turn prefixes; one whose last hash is a shorter
prefix of another is dropped by an anti-join, as is all but the least id of equal ones.
What stays, the maximal conversations, is rendered.

Only built-in expressions are used. The hash of a prefix is the combination of the hashes
of its turns, each salted with its place, so one running aggregate over a conversation's
sorted rows gives all of them in linear time and no array is held. Conversations meet only
as pre-aggregated hashes (two of 64 bits and the number of turns), and only the turns of
maximal conversations are gathered, one row each, as a rendered conversation is one row.

Edge cases: a null role or text counts as empty; turns with one number are ordered by role
and text, and equal turns are one (a row logged twice); a row without a conversation id
belongs to no other, so each distinct one is a conversation of one turn; marks in a role or
text are escaped, so different conversations never render alike; an empty table gives an
empty result; only the four named columns take part, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

OPEN, SHUT = "<|", "|>"
END = "<|end|>"
#: Salts of the two hashes of a turn.
SALTS = (7, 20_240_601)


def prefixes(log: DataFrame) -> DataFrame:
    """Each distinct turn with its place ``k`` in its conversation, the hashes ``p1, p2`` of the prefix it ends and ``ends``, whether it is the last."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    turns = log.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role, text)
    alone = F.when(F.col("conv_id").isNull(), F.sha2(F.concat_ws("\x1f", F.coalesce(F.col("turn").cast("string"), F.lit("")), F.length("role").cast("string"), "role", "text"), 256))
    turns = turns.distinct().withColumn("alone", alone)
    order = Window.partitionBy("conv_id", "alone").orderBy("turn", "role", "text")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = turns.withColumn("k", F.row_number().over(order).cast("long")).withColumn("ends", F.lead("role").over(order).isNull())
    hashes = [F.bit_xor(F.xxhash64(F.lit(salt), "k", "role", "text")).over(running).alias(f"p{i + 1}") for i, salt in enumerate(SALTS)]
    return placed.select("*", *hashes)


def maximal(log: DataFrame) -> DataFrame:
    """``conv_id, turns, copies`` of the conversations that no other prolongs; equal ones count as copies of the least id."""
    rows = Scratch(log.sparkSession).keep(prefixes(log))
    least = F.min(F.struct(F.col("conv_id").isNull().alias("z"), "conv_id", "alone")).alias("m")
    equal = rows.filter("ends").groupBy("k", "p1", "p2").agg(least, F.count(F.lit(1)).alias("copies"))
    inner = rows.filter("not ends").select("k", "p1", "p2").distinct()
    stay = equal.join(inner, ["k", "p1", "p2"], "left_anti").select(F.col("m.conv_id").alias("stay_id"), F.col("m.alone").alias("stay_alone"), "copies")
    met = rows.join(stay, F.col("conv_id").eqNullSafe(F.col("stay_id")) & F.col("alone").eqNullSafe(F.col("stay_alone")))
    turns = F.array_sort(F.collect_list(F.struct("k", "role", "text"))).alias("turns")
    return met.groupBy("conv_id", "alone").agg(turns, F.first("copies").alias("copies")).drop("alone")


def escaped(content: Column, role: bool = False) -> Column:
    """The content with a backslash within each mark, or one more where there are some; readable backwards."""
    out = F.regexp_replace(content, r"<(\\*)\|", r"<$1\\|")
    return F.regexp_replace(out, r"\|(\\*)>", r"|$1\\>") if role else out


def render(turns: Column) -> Column:
    """Each turn as a role tag, a line break, its text and the end mark, line by line."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), escaped(t.role, True), F.lit(SHUT + "\n"), escaped(t.text), F.lit(END))), "\n")


def format_chats(log: DataFrame) -> DataFrame:
    """``conv_id, n_turns, copies, rendered`` of every maximal conversation."""
    return maximal(log).select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.col("copies").cast("long").alias("copies"), render(F.col("turns")).alias("rendered"))


ORACLE = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         CASE WHEN conv_id IS NULL THEN coalesce(turn::VARCHAR, '') || chr(31) || length(coalesce(role, '')) || chr(31) || coalesce(role, '') || chr(31) || coalesce(text, '') ELSE '' END AS alone
  FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text) AS k FROM t),
p AS (
  SELECT conv_id, alone, k,
         sha256(string_agg(role || chr(31) || length(role) || chr(31) || text, chr(30)) OVER (PARTITION BY conv_id, alone ORDER BY k)) AS prefix,
         max(k) OVER (PARTITION BY conv_id, alone) AS n FROM o),
w AS (SELECT conv_id, alone, n, prefix FROM p WHERE k = n),
e AS (SELECT prefix, min(conv_id) AS conv_id, CASE WHEN min(conv_id) IS NULL THEN min(alone) ELSE '' END AS alone, any_value(n) AS n, count(*) AS copies FROM w GROUP BY prefix),
s AS (SELECT * FROM e WHERE prefix NOT IN (SELECT prefix FROM p WHERE k < n))
SELECT s.conv_id, s.n::BIGINT AS n_turns, s.copies::BIGINT AS copies,
       string_agg('<|' || regexp_replace(regexp_replace(role, '<(\\\\*)\\|', '<\\1\\\\|', 'g'), '\\|(\\\\*)>', '|\\1\\\\>', 'g') || '|>' || chr(10) || regexp_replace(text, '<(\\\\*)\\|', '<\\1\\\\|', 'g') || '<|end|>', chr(10) ORDER BY k) AS rendered
FROM s JOIN o ON o.conv_id IS NOT DISTINCT FROM s.conv_id AND o.alone = s.alone GROUP BY s.conv_id, s.alone, s.n, s.copies
"""
