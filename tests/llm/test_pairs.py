"""Near duplicates and repeated substrings against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tessellore.llm import minhash, suffix_dedup
from tessellore.llm.components import components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéfg") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(30, 220))) for _ in range(n)]
    docs = list(base)
    for t in base[:20]:
        docs.append(t)
        for _ in range(3):
            words = t.split()
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            docs.append(" ".join(words))
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    for k in range(8):
        docs.append(f"{rng.choice(base)[:80]} {passage} {rng.choice(base)[:50 + k]}")
    docs += ["ab" * 400, "x" * 350, "Δ" * 120, "", " \t\n", "one", "one two", "ONE two", None, "one two", passage * 3]
    rng.shuffle(docs)
    return docs


def brute_near(rows, k=3, percent=85):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    ids = sorted(sets)
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            piece = raw[s : s + length]
            if piece in seen:
                gone[s : s + length] = True
            seen.add(piece)
        runs = int(gone[:1].sum() + (np.diff(gone.astype(int)) == 1).sum()) if len(raw) else 0
        rest = bytes(np.frombuffer(raw, np.uint8)[~gone]) if len(raw) else b""
        out[i] = (len(raw), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest())
    return out


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(5)


@pytest.mark.parametrize("cell", [512, 6])
def test_near_duplicates_are_those_of_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(minhash, "CELL", cell)
    monkeypatch.setattr(minhash, "PIVOTS", 2)
    texts = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_report(frame(spark, texts)).collect()}
    assert got == brute_near(list(enumerate(texts)))


def test_a_large_group_of_near_copies_is_one_component(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CELL", 16)
    monkeypatch.setattr(minhash, "PIVOTS", 2)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(120):
        w = list(words)
        w[rng.randrange(60)] = f"z{rng.randrange(9)}"
        texts.append(" ".join(w))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_report(frame(spark, texts)).collect()}
    assert got == brute_near(list(enumerate(texts)))


def test_cells_are_bounded_by_bytes_too(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CELL_BYTES", 3000)
    monkeypatch.setattr(minhash, "HELD_BYTES", 2000)
    monkeypatch.setattr(minhash, "PIVOTS", 2)
    texts = corpus(29, 40) + ["long " + " ".join(f"v{k}" for k in range(j, 900 + j)) for j in range(30)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_report(frame(spark, texts)).collect()}
    assert got == brute_near(list(enumerate(texts)))


def test_joins_that_are_too_large_to_broadcast(spark, monkeypatch):
    from tessellore.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(suffix_dedup, "JOIN_ROWS", 0)
    monkeypatch.setattr(minhash, "CANDIDATE_ROWS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = corpus(31, 30)
        rows = list(enumerate(texts))
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_report(frame(spark, texts)).collect()}
        assert got == brute_near(rows)
        cut = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeat_report(frame(spark, texts)).collect()}
        assert cut == brute_repeats(rows)
        kept = sorted(r.doc_id for r in minhash.drop_near(frame(spark, texts), minhash.Rule(3, 85)).collect())
        assert kept == sorted(i for i, x in brute_near(rows).items() if x[2])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_very_long_texts(spark):
    rng = random.Random(37)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) for _ in range(5000)]
    long = " ".join(rng.choice(words) for _ in range(150_000))
    passage = " ".join(rng.choice(words) for _ in range(40))
    texts = [long, long[:-40] + "another end", passage, passage + " x" * 10, long[500_000:500_400]]
    docs = frame(spark, texts)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_report(docs).collect()}
    assert got == brute_near(list(enumerate(texts)))
    cut = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeat_report(docs).collect()}
    assert cut == brute_repeats(list(enumerate(texts)))


def test_dropping_keeps_one_row_of_each_component(spark):
    texts = corpus(9, 25)
    docs = frame(spark, texts)
    rule = minhash.Rule(3, 85)
    kept = sorted(r.doc_id for r in minhash.drop_near(docs, rule).collect())
    assert kept == sorted(i for i, x in brute_near(list(enumerate(texts))).items() if x[2])
    twice = minhash.drop_near(docs.unionByName(docs), rule)
    assert twice.columns == docs.columns
    full = [i for i in kept if (texts[i] or "").split()]
    assert sorted(r.doc_id for r in twice.collect() if (r.text or "").split()) == full


def test_pruning_bounds_are_tail_probabilities():
    rule = minhash.Rule(3, 85)
    n, m = rule.least_matches()[0]
    assert n == minhash.BATCH and 0 < m < n
    assert all(a <= b for (_, a), (_, b) in zip(rule.least_matches(), rule.least_matches()[1:]))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 160)}}


def test_components_go_on_until_nothing_changes(spark, monkeypatch):
    monkeypatch.setattr("tessellore.llm.components.MAX_ROUNDS", 1, raising=False)
    edges = [(i, i + 1) for i in range(60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(61)}


def test_repeats_are_those_of_all_strings(spark):
    texts = corpus()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeat_report(frame(spark, texts)).collect()}
    assert got == brute_repeats(list(enumerate(texts)))


def test_repeats_with_small_batches_and_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "ARRAY_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "PARTITIONS", 3)
    texts = corpus(11, 40)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeat_report(frame(spark, texts)).collect()}
    assert got == brute_repeats(list(enumerate(texts)))


def test_repeats_when_every_shared_anchor_is_hot(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 3000)
    texts = corpus(13, 40)
    docs = frame(spark, texts)
    marked = suffix_dedup.repeated_anchors(suffix_dedup.find_anchors(docs.filter("length(text) >= 100").selectExpr("doc_id as did", "cast(text as binary) as raw")))
    assert 0 < marked.filter("place < 0").count() < marked.count()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeat_report(docs).collect()}
    assert got == brute_repeats(list(enumerate(texts)))


def test_an_anchor_is_hot_by_its_occurrences_whatever_the_batches(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 20)
    rng = random.Random(19)
    some = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage = some(160)
    texts = [some(150) + passage + some(150) for _ in range(60)] + [some(150) + some(90) * 2 for _ in range(9)]
    docs = frame(spark, texts)
    raw = docs.selectExpr("doc_id as did", "cast(text as binary) as raw")
    marked = suffix_dedup.repeated_anchors(suffix_dedup.find_anchors(raw))
    assert marked.filter("place < 0").count() >= 60
    met = raw.join(marked.groupBy("did").agg({"place": "collect_list"}).toDF("did", "places"), "did")
    # no task gets more than HOT contexts of an anchor
    for r in suffix_dedup.contexts(met, 16).filter("not spans").collect():
        sizes = np.frombuffer(r["lengths"], np.int64)
        hashes = np.frombuffer(r["hashes"], np.uint64)[sizes > 100]
        assert not len(hashes) or np.unique(hashes, return_counts=True)[1].max() <= 20
    monkeypatch.setattr(suffix_dedup, "HELD_BYTES", 4000)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeat_report(docs).collect()}
    assert got == brute_repeats(list(enumerate(texts)))


def short_periodic(seed=17):
    """Texts of 100 to 168 bytes that say a phrase twice or have a short period, and texts that share a part of them."""
    rng = random.Random(seed)
    some = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    texts = []
    for n in range(100, 169, 2):
        phrase = some(40)
        texts.append((phrase + some(n - 80) + phrase)[:n])
        for period in (1, 2, 10, 33, 50, 67):
            texts.append((some(period) * n)[:n])
        two, more = some(n), some(60)
        texts += [two, two[:100] + more, more + two[-100:]]
    rng.shuffle(texts)
    return texts


def test_repeats_in_short_texts_that_hold_an_anchor_twice(spark):
    texts = short_periodic()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeat_report(frame(spark, texts)).collect()}
    assert got == brute_repeats(list(enumerate(texts)))


def test_suffix_order_is_the_order_of_suffixes():
    rng = random.Random(1)
    for _ in range(60):
        text = bytes(rng.choice(b"aabc") for _ in range(rng.randint(1, 80))) + b"\x00" + bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 40))) + b"\x00"
        order = suffix_dedup.suffix_order(np.frombuffer(text, np.uint8))
        keys = [text[i:].split(b"\x00")[0] for i in order]
        assert sorted(order) == [i for i in range(len(text)) if text[i]]
        assert keys == sorted(keys)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None), (1, None), (1, "a b c"), (1, "a b c"), (2, "word " * 60), (2, "word " * 60), (None, "word " * 60)], "doc_id bigint, text string")
    near = minhash.near_report(docs).collect()
    assert len(near) == 7
    assert {r.component_id for r in near if r.n_shingles == 1 and r.doc_id != 1} == {2}
    cut = suffix_dedup.repeat_report(docs).collect()
    assert len(cut) == 7
    by_id = defaultdict(set)
    for r in cut:
        by_id[r.doc_id].add((r.n_bytes, r.n_removed))
    whole = len("word " * 60)
    assert by_id[2] == {(whole, whole - 5)} and by_id[None] == {(0, 0), (whole, whole)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert minhash.near_report(docs).collect() == []
    assert suffix_dedup.repeat_report(docs).collect() == []
    assert minhash.drop_near(docs).collect() == []


def test_columns_of_any_name_pass_through_the_stage(spark):
    text = " ".join(f"w{k}" for k in range(40))
    names = ["gone", "row", "k", "node", "h1", "component_id", "n_shingles", "rep", "count"]
    for repeated in (False, True):
        rows = [(1, text, *range(9)), (1 if repeated else 2, text + " more", *range(9)), (3, "other words", *range(9)), (4, None, *range(9)), (None, "", *range(9))]
        docs = spark.createDataFrame(rows, f"doc_id bigint, text string, {', '.join(f'{n} int' for n in names)}")
        out = minhash.drop_near(docs)
        assert out.columns == docs.columns and sorted(r.text or "" for r in out.collect()) == sorted(["", "", "other words", text])
