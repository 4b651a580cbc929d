"""Unique names and ranks against the loops that define them."""

import random

import pytest

from tessellore.operators import merge, names, survey


def greedy(wanted, taken, glue):
    used, out = set(taken), {}
    for i, base in sorted(wanted):
        name, n = base, 2
        while name in used:
            name, n = f"{base}{glue}{n}", n + 1
        used.add(name)
        out[i] = name
    return out


@pytest.mark.parametrize("glue", ["-", ""])
def test_names_are_the_first_free_ones(spark, glue):
    rng = random.Random(9)
    wanted = [(f"i{k:03}", rng.choice("ab" * 9 + "c")) for k in range(60)]
    taken = [rng.choice(["a", f"a{glue}{rng.randint(2, 9)}", f"b{glue}3", f"b{glue}4", "z"]) for _ in range(8)]
    rows = names.unique_names(spark.createDataFrame(wanted, "id string, base string"), spark.createDataFrame([(t,) for t in taken], "name string"), glue)
    assert {r.id: r.name for r in rows.collect()} == greedy(wanted, taken, glue)


def test_a_base_of_very_many_names(spark):
    from pyspark.sql import functions as F

    n = 200_000
    wanted = spark.range(n).select(F.lpad("id", 7, "0").alias("id"), F.lit("hot").alias("base"))
    taken = spark.range(0, n, 3).select(F.when(F.col("id") == 0, "hot").otherwise(F.concat(F.lit("hot-"), F.col("id") + 1)).alias("name"))
    out = names.unique_names(wanted, taken).select(F.col("id").cast("long").alias("i"), F.regexp_extract("name", "([0-9]+)$", 1).cast("long").alias("n"))
    # of every three numbers the first is taken: 1, 4, 7, ...
    assert out.filter(F.col("n") != F.when(F.col("i") < 2 * ((n + 2) // 3), F.col("i") + 2 + F.floor(F.col("i") / 2)).otherwise(F.col("i") + 1 + (n + 2) // 3)).count() == 0
    assert out.select("n").distinct().count() == n


def test_numbered_names_never_meet_names_that_others_want(spark):
    wanted = [("1", "x"), ("2", "x"), ("3", "x-2"), ("4", "x-2"), ("5", "x"), ("6", "x-2-2"), ("7", "x-3")]
    rows = names.unique_names(spark.createDataFrame(wanted, "id string, base string"), spark.createDataFrame([], "name string")).collect()
    assert len({r.name for r in rows}) == len(rows) == 7
    assert {r.id: r.name for r in rows}["1"] == "x"


def test_paths_of_the_stated_cases(spark):
    paths = lambda wanted, taken: sorted(r.path for r in merge.unique_paths(spark.createDataFrame([(str(i), p) for i, p in enumerate(wanted)], "id string, path string"), spark.createDataFrame([(t,) for t in taken], "path string")).collect())
    assert len(set(paths(["x.md", "x.md", "x-2.md"], []))) == 3
    assert paths(["x.md"], ["x-5.md"]) == ["x.md"]
    assert paths(["x.md", "x.md", "x.md"], ["x.md", "x-3.md"]) == ["x-2.md", "x-4.md", "x-5.md"]


def test_ranks_of_a_large_group_and_of_null(spark):
    rows = [(None if k % 7 == 0 else "hot", k) for k in range(3000)]
    got = names.rank_within(spark.createDataFrame(rows, "g string, o int").repartition(5), "g", "o").collect()
    want, n = {}, {}
    for g, o in sorted(rows, key=lambda r: r[1]):
        n[g] = n.get(g, 0) + 1
        want[o] = n[g]
    assert {r.o: r.k for r in got} == want


def test_citation_keys_never_repeat(spark):
    rows = [("papers/a", "T", "2020"), ("papers/b", "T", "2020"), ("papers/c", "T2020b", None), ("papers/d", "T", "2020"), ("papers/b!", "T", "2020"), ("papers/-b", "T", "2020")]
    keys = {r.id: r.key for r in survey.citation_keys(spark.createDataFrame(rows, "id string, title string, published string")).collect()}
    assert len(set(keys.values())) == len(rows)
    assert keys["papers/-b"] == "t2020"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_pairs_within_edits_are_those_of_all_pairs_at_every_length(spark):
    from tessellore.operators import resolve

    rng = random.Random(12)
    titles = set()
    for size in (5, 6, 9, 16, 17, 18, 19, 20, 21, 22, 40, 90):
        for _ in range(4):
            base = "".join(rng.choice("abcd") for _ in range(size))
            titles.add(base)
            for _ in range(5):
                t = list(base)
                for _ in range(rng.randint(1, 3)):
                    at = rng.randrange(len(t))
                    rng.choice([lambda: t.pop(at), lambda: t.insert(at, "x"), lambda: t.__setitem__(at, "y")])()
                titles.add("".join(t))
    titles = sorted(titles)
    hubs = spark.createDataFrame([("Entity", t, t) for t in titles], "type string, path string, title string")
    got = {(r.a, r.b): r.distance for r in resolve.edit_pairs(hubs).collect()}
    want = {(a, b): d for i, a in enumerate(titles) for b in titles[i + 1 :] if len(a) >= 6 and len(b) >= 6 and abs(len(a) - len(b)) <= 2 and (d := levenshtein(a, b)) <= 2}
    assert got == want and len(want) > 100


def test_similar_titles_are_those_of_all_pairs(spark):
    from pyspark.sql import functions as F
    from tessellore.operators import resolve

    rng = random.Random(13)
    titles = sorted({" ".join(sorted({rng.choice("a b c d e f g hh ii jj".split()) for _ in range(rng.randint(1, 6))})) for _ in range(90)})
    frame = spark.createDataFrame([(t,) for t in titles], "title string").withColumn("tokens", F.split("title", " "))
    for least in (0.3, 0.5, 0.8, 1.0):
        got = {(r.a, r.b): round(r.score, 9) for r in resolve.similar_titles(frame, least).collect()}
        sets = {t: set(t.split()) for t in titles}
        want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 9) for i, a in enumerate(titles) for b in titles[i + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}
        assert got == want
