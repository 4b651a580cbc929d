"""Quotes by an automaton and kinship of slugs, against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessellore.functions import text
from tessellore.operators import quotes


@pytest.mark.parametrize("part", [1_000_000, 60])
def test_quotes_of_all_lengths_equal_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(quotes, "PART_CHARS", part)
    rng = random.Random(part)
    words = ["a", "ab", "abc", "b", "été", "東京", "x y", "the", "cell"]
    texts = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for k in range(60)] + [(99, None), (100, ""), (101, "a" * 5000)]
    asked = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))[rng.randint(0, 1) :]) for k in range(40)] + [(90, ""), (91, "a"), (92, "a"), (93, "zzz"), (94, "a" * 4999), (95, None)]
    got = quotes.held_quotes(spark.createDataFrame(asked, "item int, q string"), spark.createDataFrame(texts, "doc int, e string").repartition(3))
    assert sorted(map(tuple, got.collect())) == sorted((i, d) for i, q in asked for d, e in texts if q and e is not None and q in e)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_no_quotes(spark):
    assert quotes.held_quotes(spark.createDataFrame([], "item int, q string"), spark.createDataFrame([("d", "text")], "doc string, e string")).count() == 0


def test_kinship_of_slugs(spark):
    def expected(said, slug, rule):
        x, y = (re.sub("^[0-9]{4}-", "", s) for s in (said, slug))
        if not x or not y:
            return False
        begins = x.startswith(y) or y.startswith(x)
        if rule == "target":
            return begins if min(len(x), len(y)) >= 12 else x in y or y in x
        return begins if min(len(x), len(y)) >= 8 else x == y or (len(x) >= 4 and y.startswith(x))

    rng = random.Random(4)
    parts = ["", "a", "ab", "cell", "cells", "2020-", "2021-cell", "cell-migration-in-gels", "cell-migration", "migration", "gels", "20-x"]
    pairs = [(a, b) for a in parts for b in parts] + [("".join(rng.choice(["a", "ab", "-"]) for _ in range(rng.randint(0, 9))), "".join(rng.choice(["a", "ab", "-"]) for _ in range(rng.randint(0, 9)))) for _ in range(400)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", *[text.akin(F.col("a"), F.col("b"), r).alias(r) for r in text.KIN_LENGTH]).collect()
    assert all(r[rule] == expected(r.a, r.b, rule) for r in rows for rule in text.KIN_LENGTH)
