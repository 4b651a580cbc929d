"""Commits of several tables, segments of the index, and vectors that follow the texts."""

import threading

import pytest
from pyspark.sql import functions as F

from tessellore.operators import search
from tessellore.sources import segments, store


def docs(spark, rows):
    return spark.createDataFrame(rows, "id string, title string, body string")


def one(spark, n):
    return spark.createDataFrame([(n,)], "n int")


def size_of(kept, table):
    return kept.fs.getContentSummary(kept.path(table)).getLength()


def test_readers_see_all_of_a_commit_or_nothing(spark, tmp_path):
    kept, reader = (store.Store(spark, str(tmp_path / "lib")) for _ in range(2))
    with kept.transaction():
        kept.save("x", one(spark, 1))
        kept.save("y", one(spark, 1))
        assert not reader.exists("x") and not reader.exists("y") and kept.load("x").first().n == 1
    assert (reader.load("x").first().n, reader.load("y").first().n) == (1, 1)
    assert reader.manifest()[0] == 1


def test_a_writer_that_dies_leaves_the_last_commit(spark, tmp_path, monkeypatch):
    kept, reader = (store.Store(spark, str(tmp_path / "lib")) for _ in range(2))
    kept.save("x", one(spark, 1))

    def dies(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(kept, "create_text", dies)
    with pytest.raises(KeyboardInterrupt), kept.transaction():
        kept.save("x", one(spark, 2))
        kept.save("y", one(spark, 2))
    assert reader.load("x").first().n == 1 and not reader.exists("y")
    monkeypatch.undo()
    assert kept.clean("x") == 1 and kept.clean("y") == 1 and reader.load("x").first().n == 1
    monkeypatch.setattr(kept, "_rename", dies)  # the text is beside its place when the writer dies
    with pytest.raises(KeyboardInterrupt):
        kept.write_text("index.md", "new")
    assert reader.read_text("index.md") is None
    monkeypatch.undo()
    kept.write_text("index.md", "old")
    kept.write_text("index.md", "new")
    assert reader.read_text("index.md") == "new"


def test_two_writers_of_different_tables_both_win_and_of_one_table_one_is_refused(spark, tmp_path):
    a, b = (store.Store(spark, str(tmp_path / "lib")) for _ in range(2))
    a.save("x", one(spark, 0))
    with a.transaction():
        a.save("x", one(spark, 1))
        b.save("y", one(spark, 2))
    assert (b.load("x").first().n, a.load("y").first().n) == (1, 2)
    with pytest.raises(store.Conflict), a.transaction("y"):
        a.save("z", one(spark, 1))
        b.save("y", one(spark, 3))
    assert not a.exists("z") and a.load("y").first().n == 3
    a.upsert("k", spark.createDataFrame([("p", 1)], "k string, v int"), ["k"])
    real, first = a.put, []

    def late(table, entry, seen):
        if not first:
            first.append(1)
            b.upsert("k", spark.createDataFrame([("q", 2)], "k string, v int"), ["k"])
        real(table, entry, seen)

    a.put = late
    a.upsert("k", spark.createDataFrame([("p", 5)], "k string, v int"), ["k"])
    assert {tuple(r) for r in b.load("k").collect()} == {("p", 5), ("q", 2)}


def test_numbers_are_given_once(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path / "lib"))
    threads = [threading.Thread(target=kept.commit, args=({f"t{k}": {"version": str(k)}}, {})) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    number, tables = kept.manifest()
    assert number == 8 and sorted(tables) == [f"t{k}" for k in range(8)]
    lines = [threading.Thread(target=kept.log, args=(f"line {k}", "now")) for k in range(6)]
    [t.start() for t in lines]
    [t.join() for t in lines]
    assert sorted(r.line for r in kept.log_lines().collect()) == [f"line {k}" for k in range(6)]


def test_a_small_delta_writes_little(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path / "lib"))
    rows = spark.range(2000).select(F.col("id").cast("string").alias("id"), F.lit("t").alias("title"), F.concat_ws(" ", *[F.concat(F.lit("w"), (F.col("id") * k % 5003).cast("string")) for k in range(1, 40)]).alias("body"))
    kept.build_index(rows)
    before = size_of(kept, store.POSTINGS)
    edited = rows.withColumn("body", F.when(F.col("id").cast("int") % 100 == 0, F.concat("body", F.lit(" fresh"))).otherwise(F.col("body")))
    after = kept.refresh_index(edited)
    assert size_of(kept, store.POSTINGS) - before < 0.05 * before and len(kept.entry(store.POSTINGS)["segments"]) == 2
    ordered = lambda f: f.orderBy("token", "id").collect()
    assert ordered(after.filter("token = 'fresh' OR token LIKE 'w7%'")) == ordered(search.build_postings(edited).filter("token = 'fresh' OR token LIKE 'w7%'"))


def test_segments_agree_with_a_new_index_after_any_edits(spark, tmp_path):
    import random

    rng, kept, now = random.Random(3), store.Store(spark, str(tmp_path / "lib")), {}
    most = 0
    for _ in range(9):
        for _ in range(rng.randint(1, 6)):
            now[f"d{rng.randrange(12)}"] = " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(3))
        for gone in rng.sample(sorted(now), min(len(now), rng.randint(0, 2))):
            del now[gone]
        frame = docs(spark, [(k, "T", v) for k, v in now.items()] or [("none", "T", "x")])
        got = {tuple(r) for r in kept.refresh_index(frame).collect()}
        assert got == {tuple(r) for r in search.build_postings(frame).collect()}
        held = kept.entry(store.POSTINGS)["segments"]
        assert {r.path for r in segments.stamps(spark, f"{kept.root}/{store.POSTINGS}", held).collect()} == {r.id for r in frame.collect()}
        most = max(most, len(held))
    assert most <= 4
    kept.clean(store.POSTINGS)
    assert {tuple(r) for r in kept.load(store.POSTINGS).collect()} == got


def test_a_second_writer_of_the_index_makes_its_delta_anew(spark, tmp_path):
    a, b = (store.Store(spark, str(tmp_path / "lib")) for _ in range(2))
    a.build_index(docs(spark, [("x", "", "one")]))
    real, first = a.put, []

    def late(table, entry, seen):
        if not first:
            first.append(1)
            b.refresh_index(docs(spark, [("x", "", "one"), ("y", "", "two")]))
        real(table, entry, seen)

    a.put = late
    got = a.refresh_index(docs(spark, [("x", "", "one"), ("z", "", "three")]))
    assert {(r.token, r.id) for r in got.collect()} == {("one", "x"), ("three", "z")}


def test_vectors_follow_the_texts(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path / "lib"))
    places = F.explode(F.sequence(F.lit(0), F.size(F.split("body", " ")) - 1))
    cut = lambda d: d.select("id", "body", places.alias("n")).select(F.concat_ws("#", "id", "n").alias("chunk_id"), F.col("id").alias("source_id"), F.col("body").alias("text"))
    calls = str(tmp_path / "calls")

    def client(texts):
        with open(calls, "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        return [[float(len(t))] for t in texts]

    def sync(rows, model="m"):
        open(calls, "w").close()
        got = sorted((r.chunk_id, r.embedding[0], r.model) for r in kept.refresh_vectors(docs(spark, rows), cut, client, model).collect())
        return got, sorted(set(open(calls).read().splitlines()))

    first = [("x", "", "a bc"), ("y", "", "def"), ("z", "", "g")]
    assert sync(first) == ([("x#0", 4.0, "m"), ("x#1", 4.0, "m"), ("y#0", 3.0, "m"), ("z#0", 1.0, "m")], ["a bc", "def", "g"])
    assert sync(first)[1] == []
    kept.refresh_index(docs(spark, first))  # the index's stamps are not the vectors'
    second = [("x", "", "a"), ("y", "", "def"), ("w", "", "new one")]
    assert sync(second) == ([("w#0", 7.0, "m"), ("w#1", 7.0, "m"), ("x#0", 1.0, "m"), ("y#0", 3.0, "m")], ["a", "new one"])
    assert sync(second, "other")[1] == ["a", "def", "new one"] and {m for _, _, m in sync(second, "other")[0]} == {"other"}
