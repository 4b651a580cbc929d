"""Phrases whose words stand together more often than their parts would by chance.

Texts are cut into pieces that no phrase crosses, and identical pieces of a language become
one with a multiplicity, so copies are read once from there on. N-grams are counted level
by level, from words to MAX_WORDS: in each task they are combined per batch of words by
exact numbers of words, then their weighted parts are shuffled by hash bucket, and each
bucket is summed in DuckDB, which spills to its task's scratch folder when it holds more
than its memory limit. An n-gram can only be frequent if both (n-1)-grams in it are; these
are looked up in a bit table of the frequent ones, at most FILTER_BITS bits, which may let
too many through, but never stops a frequent one. At the end each candidate asks for the
counts of the parts of its cuts: requests and counts meet in shuffled joins, whose hot
parts adaptive execution splits. Scores are exact decimals.

A phrase that lies in a longer one is dropped if the longer has ``cover`` percent of its
count. That is decided by the phrases one word longer: a count never grows with the words,
so what a still longer one covers, one of these covers.

Edge cases: a null or empty text has no words; a null language is ``und``, like the
language of that name; pieces of blanks only don't count; each row counts, also copies and
equal ids; ties of scores go by count, then by the phrase's bytes; texts and pieces of any
length are read whole; an empty table gives no phrases; other columns don't take part.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, tidy
from .line_dedup import lower_ascii
from .minhash import mixed_bits

MIN_COUNT, MAX_WORDS, TOP, COVER = 100, 5, 2000, 100
BREAKS = "[.,;:!?\n\x0b\f\r]"
GAPS = "[ \t]+"
#: Words that a task combines at a time.
BATCH_WORDS = 1_000_000
#: Bits of the table of frequent n-grams for each of them, and at most (64 MB).
KEY_BITS, FILTER_BITS = 32, 1 << 29
#: Pieces of the bit table that are built apart.
CHUNK_BITS = 1 << 22
#: Rows of a hash bucket, about, and buckets at most.
BUCKET_ROWS, BUCKETS = 2_000_000, 20_000
#: What DuckDB holds of a bucket before it spills.
DUCKDB_MEMORY = "256MB"
#: Parts of a language that are ranked apart before the last ranking.
PARTS = 64
_P = np.uint64(0x9E3779B97F4A7C15)
PARTIAL = "lang string, phrase string, f bigint"


def pieces_of(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, piece, m``: the distinct pieces, their words set apart by one space, and how often they occur."""
    cut = F.split(lower_ascii(F.coalesce(F.col(f"`{text}`"), F.lit(""))), BREAKS)
    one = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.explode(cut).alias("piece"))
    one = one.select("lang", F.btrim(F.regexp_replace("piece", GAPS, " ")).alias("piece")).filter("piece <> ''")
    return one.groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("m"))


def _hashes(values: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in values.cast(pa.binary()).to_pylist()), dtype=np.uint64, count=len(values))


def _joined(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of all words but the last and of the last."""
    return mixed_bits(before * _P + word)


class Words:
    """The words of some pieces, one after the other."""

    def __init__(self, langs: pa.Array, pieces: pa.Array, times: np.ndarray) -> None:
        split = pc.split_pattern(pieces, " ")
        coded = split.flatten().dictionary_encode()
        self.words, self.word = coded.dictionary, coded.indices.to_numpy()
        sizes = np.diff(split.offsets.to_numpy())
        langs = langs.dictionary_encode()
        self.langs = langs.dictionary
        self.lang = np.repeat(langs.indices.to_numpy(), sizes)
        self.times = np.repeat(times, sizes)
        self.left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(self.word))  # words from here to the piece's end
        self._first = mixed_bits(_hashes(self.langs)[self.lang] + _hashes(self.words)[self.word] * _P)

    def starts(self, n: int, keep: np.ndarray | None) -> np.ndarray:
        """Where an n-gram starts both of whose (n-1)-grams the bit table has; the table is None for words."""
        at = np.flatnonzero(self.left >= n)
        if keep is None:
            return at
        hashes = self._first
        for k in range(1, n - 1):  # hashes of (k + 1)-grams, meaningless where the piece ends earlier
            hashes = _joined(hashes[:-1], self._first[k:])
        good = has(keep, hashes)
        return at[good[at] & good[at + 1]]

    def count(self, n: int, keep: np.ndarray | None) -> pa.RecordBatch:
        """The distinct n-grams and their weights; for words also the sum of all as the empty phrase."""
        at = self.starts(n, keep)
        code, size = np.zeros(len(at), dtype=np.int64), 1
        for ids, kinds in [(self.lang, len(self.langs))] + [(self.word[k:], len(self.words)) for k in range(n)]:
            if size * kinds >= 1 << 62:  # fewer, as only what occurs is numbered
                seen, code = np.unique(code, return_inverse=True)
                size = len(seen)
            code, size = code * kinds + ids[at], size * max(1, kinds)
        order = np.argsort(code, kind="stable")
        heads = np.flatnonzero(np.diff(code[order], prepend=-1))
        weight = np.add.reduceat(self.times[at][order], heads) if len(heads) else np.empty(0, np.int64)
        first = at[order][heads]
        parts = [self.words.take(pa.array(self.word[first + k])) for k in range(n)]
        phrase = pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]
        langs = self.langs.take(pa.array(self.lang[first]))
        if n == 1:
            total = np.bincount(self.lang, weights=None if not len(self.times) else self.times, minlength=len(self.langs)).astype(np.int64)
            langs, phrase, weight = pa.concat_arrays([langs, self.langs]), pa.concat_arrays([phrase, pa.array([""] * len(self.langs), pa.string())]), np.concatenate([weight, total])
        return pa.RecordBatch.from_arrays([langs, phrase, pa.array(weight)], names=["lang", "phrase", "f"])


def has(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit table, as bytes, has the hashes."""
    bit = hashes & np.uint64(8 * len(table) - 1)
    return (table[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0


def phrase_hashes(langs: pa.Array, phrases: pa.Array) -> np.ndarray:
    """The hashes that ``Words`` computes, from whole phrases of one length."""
    if not len(phrases):
        return np.empty(0, np.uint64)
    words = Words(langs, phrases, np.ones(len(phrases), np.int64))
    sizes = pc.list_value_length(pc.split_pattern(phrases, " ")).to_numpy()
    hashes = words._first
    for k in range(1, int(sizes[0])):
        hashes = _joined(hashes[:-1], words._first[k:])
    return hashes[np.cumsum(sizes) - sizes]


def bit_table(frequent: DataFrame, n: int) -> np.ndarray:
    """The bit table of ``n`` frequent phrases; its size is bounded, whatever their number."""
    bits = min(FILTER_BITS, max(1 << 13, 1 << (KEY_BITS * n - 1).bit_length()))
    chunk = min(bits, CHUNK_BITS)

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.unique(phrase_hashes(batch.column(0), batch.column(1)) & np.uint64(bits - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((bit // chunk).astype(np.int32)), pa.array((bit % chunk).astype(np.int32))], names=["chunk", "bit"])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            of, bit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for c in np.unique(of):
                held = made.setdefault(int(c), np.zeros(chunk // 8, np.uint8))
                mine = bit[of == c]
                np.bitwise_or.at(held, mine >> 3, (1 << (mine & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int32()), pa.array([x.tobytes() for x in made.values()], pa.binary())], names=["chunk", "bits"])

    rows = frequent.mapInArrow(tidy(spots), "chunk int, bit int").distinct().repartition(max(1, bits // chunk), "chunk").mapInArrow(tidy(chunks), "chunk int, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in rows.toLocalIterator():
        out[row.chunk * chunk // 8 : (row.chunk + 1) * chunk // 8] = np.frombuffer(row.bits, np.uint8)
    return out


def partial_counts(pieces: DataFrame, n: int, keep: np.ndarray | None) -> DataFrame:
    """Weighted n-grams of ``lang, piece, m``, combined for some words at a time."""
    shared = None if keep is None else pieces.sparkSession.sparkContext.broadcast(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if shared is None else shared.value
        held, size = [], 0

        def done() -> pa.RecordBatch:
            langs, texts, times = (pa.concat_arrays([b.column(i) for b in held]) for i in range(3))
            return Words(langs, texts, times.to_numpy()).count(n, table)

        for batch in batches:
            held.append(batch)
            size += batch.column(1).nbytes // 7
            if size >= BATCH_WORDS:
                yield done()
                held, size = [], 0
        if held:
            yield done()

    return pieces.select("lang", "piece", "m").mapInArrow(tidy(run), PARTIAL)


def bucket_sums(partial: DataFrame, buckets: int, least: int) -> DataFrame:
    """Sums of ``lang, phrase, f`` of at least ``least``, by hash bucket in DuckDB; sums of the empty phrase always."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as spill, duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": spill, "preserve_insertion_order": False}) as con:
            con.execute("CREATE TABLE parts (lang VARCHAR, phrase VARCHAR, f BIGINT)")
            for batch in batches:
                rows = pa.Table.from_batches([batch])
                con.register("rows", rows)
                con.execute("INSERT INTO parts SELECT lang, phrase, f FROM rows")
                con.unregister("rows")
            sums = con.execute("SELECT lang, phrase, sum(f)::BIGINT AS f FROM parts GROUP BY lang, phrase HAVING sum(f) >= ? OR phrase = ''", [least])
            for batch in sums.to_arrow_reader(50_000):
                yield batch.cast(pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())]))

    dealt = partial.withColumn("bucket", F.pmod(F.xxhash64("lang", "phrase"), F.lit(buckets))).repartition(buckets, "bucket")
    return dealt.select("lang", "phrase", "f").mapInArrow(tidy(run), PARTIAL)


def frequent_phrases(pieces: DataFrame, *, least: int = MIN_COUNT, max_words: int = MAX_WORDS, buckets: int | None = None) -> DataFrame:
    """``lang, phrase, n_words, f`` of all phrases that occur at least ``least`` times; with no words the sum of the language.

    ``pieces`` is read once for each length, so it should be a written table.
    """
    spark = pieces.sparkSession
    scratch = Scratch(spark)
    out, keep = None, None
    for n in range(1, max_words + 1):
        partial = scratch.keep(partial_counts(pieces, n, keep))
        rows = partial.count()
        found = scratch.keep(bucket_sums(partial, buckets or min(BUCKETS, max(2, rows // BUCKET_ROWS + 1)), least))
        scratch.drop(partial)
        here = found.select("lang", "phrase", F.when(F.col("phrase") == "", 0).otherwise(n).alias("n_words"), "f")
        out = here if out is None else out.unionByName(here)
        real = found.filter("phrase <> ''")
        n_real = real.count()
        if not n_real:  # nothing longer is frequent
            break
        if n < max_words:
            keep = bit_table(real, n_real)
    return out


def collocations(counts: DataFrame, *, top: int = TOP, cover: int = COVER) -> DataFrame:
    """The best ``top`` phrases of each language by score, from ``frequent_phrases``.

    ``a`` is the phrase's count, ``l`` and ``r`` those of the parts of its lowest-scoring
    cut, ``n`` the words of the language, ``score`` floor(1000 a n / (l r)).
    """
    scratch = Scratch(counts.sparkSession)
    phrases = counts.filter("n_words > 0").select("lang", "phrase", "n_words", "f")
    sums = counts.filter("n_words = 0").select("lang", F.col("f").alias("n"))
    words = F.split("phrase", " ")
    longer = phrases.filter("n_words > 2").select("lang", F.explode(F.array(F.array_join(F.slice(words, 1, F.col("n_words") - 1), " "), F.array_join(F.slice(words, 2, F.col("n_words") - 1), " "))).alias("phrase"), "f")
    cover_of = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    candidates = phrases.filter("n_words > 1").join(cover_of, ["lang", "phrase"], "left").filter(f"longer IS NULL OR CAST(100 AS DECIMAL(20,0)) * longer < CAST({cover} AS DECIMAL(20,0)) * f")
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"), words.alias("w"))
    asked = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("right"))
    parts = phrases.select("lang", F.col("phrase").alias("part"), "f")
    told = asked.join(parts.withColumnRenamed("f", "l").withColumnRenamed("part", "left"), ["lang", "left"]).join(parts.withColumnRenamed("f", "r").withColumnRenamed("part", "right"), ["lang", "right"])
    told = told.join(sums, "lang")
    wide = {c: F.col(c).cast("decimal(18,0)") for c in ("a", "l", "r", "n")}
    score = F.expr("(CAST(1000 AS DECIMAL(4,0)) * da * dn) div (dl * dr)")
    scored = told.select("*", *[v.alias(f"d{c}") for c, v in wide.items()]).withColumn("score", score)
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    few = best.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top).drop("part", "rank")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return scratch.keep(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")]))


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", *, least: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, cover: int = COVER) -> DataFrame:
    """The collocations of the texts of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    pieces = scratch.keep(pieces_of(docs, text, lang))
    counts = scratch.keep(frequent_phrases(pieces, least=least, max_words=max_words))
    out = collocations(counts, top=top, cover=cover)
    scratch.drop(pieces, counts)
    return out


def collocation_report(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return mine(docs.select("text", "lang"))


ORACLE = """
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
p AS MATERIALIZED (
  SELECT lang, w, count(*) AS m FROM (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM d) WHERE len(w) > 0 GROUP BY ALL),
g AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, m
  FROM (SELECT lang, w, m, size, unnest(range(1, len(w) - size + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE len(w) >= size)),
f AS MATERIALIZED (SELECT lang, size, phrase, sum(m)::HUGEINT AS f FROM g GROUP BY ALL HAVING sum(m) >= 100),
n AS (SELECT lang, sum(m * len(w))::HUGEINT AS n FROM p GROUP BY lang),
c AS MATERIALIZED (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1),
sub AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, s, unnest(range(1, size - s + 2)) AS i FROM c, (SELECT unnest([2, 3, 4]) AS s) WHERE size > s) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN sub USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
cut AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:size], ' ') AS rp FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)),
s AS (
  SELECT cut.lang, cut.phrase, a, k, x.f AS l, y.f AS r, n, (1000 * a * n) // (x.f * y.f) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = lp JOIN f y ON y.lang = cut.lang AND y.phrase = rp JOIN n ON n.lang = cut.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM o WHERE rank <= 2000
"""
