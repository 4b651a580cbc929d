"""Collocations against brute force."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessellore.llm import collocations

SCHEMA = "doc_id bigint, text string, lang string"


def brute(rows, least=100, max_words=5, top=2000, cover=100):
    f, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, max_words + 1):
                for i in range(len(w) - n + 1):
                    f[lang, tuple(w[i : i + n])] += 1
    held = {k: v for k, v in f.items() if v >= least and len(k[1]) > 1}
    covered = set()
    for (lang, w), v in held.items():
        for s in range(2, len(w)):
            for i in range(len(w) - s + 1):
                if 100 * v >= cover * f[lang, w[i : i + s]]:
                    covered.add((lang, w[i : i + s]))
    best = {}
    for (lang, w), a in held.items():
        if (lang, w) in covered:
            continue
        score, k = min((1000 * a * total[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        best.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, total[lang], -s) for lang, rows in best.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1))


def corpus(seed=2, n=400):
    rng = random.Random(seed)
    words = ["new", "york", "City", "of", "the", "a\x00b", "Été", "x|y", "𝒳", "la", "ouverte", "los", "angeles", "\xa0", "　"]
    fixed = ["new york City of the", "los\tangeles", "the the the the", "Été la ouverte"]
    docs = []
    for k in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(0, 8))]
        docs.append((k, "".join(p + rng.choice([". ", "\n", "\x0b", " \t ", "!", ",", "\r\n"]) for p in parts), rng.choice(["en", "fr", None, "und", ""])))
    docs += [(None, None, None), (1, "", "en"), (1, " . ,\n", "zz"), (2, "only words", "yy"), (3, "same piece again. " * 300, "en"), (4, "w " * 5000, "en")]
    return docs + docs[:40]


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize(("least", "max_words", "top", "cover"), [(20, 5, 2000, 100), (3, 5, 25, 100), (10, 3, 2000, 60), (1, 2, 7, 100)])
def test_equals_brute_force(spark, least, max_words, top, cover):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert rows_of(collocations.mine(docs, least=least, max_words=max_words, top=top, cover=cover)) == brute(rows, least, max_words, top, cover)


def test_small_batches_a_full_bit_table_and_spilling_change_nothing(spark, monkeypatch):
    rows = corpus(9)
    monkeypatch.setattr(collocations, "BATCH_WORDS", 50)
    monkeypatch.setattr(collocations, "FILTER_BITS", 8)
    monkeypatch.setattr(collocations, "BUCKET_ROWS", 500)
    out = rows_of(collocations.mine(spark.createDataFrame(rows, SCHEMA), least=10))
    assert out == brute(rows, 10)


def test_products_beyond_64_bits(spark):
    big = 4 * 10**15
    rows = [("en", "", 0, 9 * 10**16), ("en", "p", 1, big + 1), ("en", "q", 1, big + 3), ("en", "p q", 2, big - 1)]
    out = collocations.collocations(spark.createDataFrame(rows, "lang string, phrase string, n_words int, f bigint")).first()
    assert out.score == 1000 * (big - 1) * 9 * 10**16 // ((big + 1) * (big + 3))


def test_the_bit_table_has_every_frequent_phrase(spark):
    import numpy as np

    rng = random.Random(1)
    phrases = sorted({" ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(3)) for _ in range(3000)})
    frame = spark.createDataFrame([(rng.choice(["en", "fr"]), p) for p in phrases], "lang string, phrase string").repartition(3)
    table = collocations.bit_table(frame, len(phrases))
    rows = frame.collect()
    hashes = collocations.phrase_hashes(pa.array([r.lang for r in rows]), pa.array([r.phrase for r in rows]))
    assert collocations.has(table, hashes).all()
    others = collocations.phrase_hashes(pa.array(["xx"] * 5000), pa.array([f"a {k} c" for k in range(5000)]))
    assert collocations.has(table, others).mean() < 0.1 and np.unpackbits(table).sum() <= len(phrases)


def test_buckets_spill_and_leave_nothing_behind(spark, monkeypatch):
    monkeypatch.setattr(collocations, "DUCKDB_MEMORY", "40MB")
    n = 1_500_000
    partial = spark.range(2 * n).select(F.lit("en").alias("lang"), F.concat(F.lit("a rather long phrase "), F.col("id") % n).alias("phrase"), F.lit(1).cast("long").alias("f"))
    assert collocations.bucket_sums(partial, 2, 2).count() == n


def test_empty_table_and_clashing_names(spark):
    assert collocations.collocation_report(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = corpus(4)
    wide = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("piece", "m", "phrase", "f", "n", "rank")])
    assert rows_of(collocations.mine(wide, least=30)) == brute(rows, 30)
