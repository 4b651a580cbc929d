"""MinHash near-duplicates with sequential Bayesian verification.

1. Each text becomes its set of hashed word shingles, a fingerprint of the set and the
   banded keys of its signature. Texts with one set are one node from here on.
2. Keys that several nodes share are buckets; buckets with the same nodes count once.
3. Each bucket is searched by nodes in cells that are small by nodes and by bytes. Signatures are compared batch by
   batch; after each batch the pairs are pruned whose posterior probability of reaching
   the similarity, a beta, is under the chosen miss probability. Survivors are verified on
   the full sets. Nodes already known to be connected are not compared again, so a cell
   yields a spanning forest, never its pairs.
4. A bucket over that size is cut into blocks that share a few pivot nodes. What the
   links so far don't connect to the bucket's largest component is then compared with
   all its other nodes, block by block, so no link between components is lost.
5. Links are joined to components by alternating stars.

Edge cases: a null text or one without words has an empty set and no link; a text with
fewer words than a shingle is one shingle; a null id takes part, and the id of a component
without any id is null; repeated rows share a component; an empty table gives an empty
result; other columns of the input don't take part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_small, tidy
from .components import components

#: Nodes of a cell, bytes of its sets, nodes that the blocks of a bucket share, and bytes that a task hands on at a time.
CELL = 512
CELL_BYTES = 64 << 20
PIVOTS = 32
HELD_BYTES = 1 << 20
MISS = 1e-6
BATCH = 24
WORD_CACHE = 100_000
CANDIDATE_ROWS = 400_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Rule:
    """What counts as near: shingle words, percent of similarity, and the banding that finds it."""

    def __init__(self, words: int = 5, percent: int = 80, rows: int | None = None, miss: float = MISS) -> None:
        self.words, self.percent, self.miss = words, percent, miss
        t = percent / 100
        self.rows = rows or (5 if t >= 0.85 else 4)
        self.bands = math.ceil(math.log(miss) / math.log(1 - t**self.rows))
        self.hashes = self.rows * self.bands
        self.factors = np.random.default_rng(20_240_601).integers(1, 1 << 63, size=self.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def least_matches(self) -> list[tuple[int, int]]:
        """(hashes compared, matches needed): with fewer, P(J >= t | matches) < miss under a uniform prior.

        The posterior after m of n is Beta(m + 1, n - m + 1), and its upper tail at t is
        the chance of at most m successes in n + 1 trials of t.
        """
        t, out = self.percent / 100, []
        for n in [*range(BATCH, self.hashes, BATCH), self.hashes]:
            tail, m = 0.0, -1
            while tail < self.miss:
                m += 1
                tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            out.append((n, m))
        return out

    def near(self, a: np.ndarray, b: np.ndarray) -> bool:
        shared = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * shared >= self.percent * (len(a) + len(b) - shared)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORD_CACHE:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def mixed_bits(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int, words: dict) -> np.ndarray:
    """The sorted distinct hashes of a text's k-word shingles; bytes.split cuts at exactly \\x20 and \\x09-\\x0D."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
    if not found:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=len(found))
    n = max(1, len(w) - k + 1)
    h = np.full(n, np.uint64(min(len(w), k)))
    for j in range(min(len(w), k)):
        h = h * _M1 + mixed_bits(w[j : j + n])
    return np.unique(mixed_bits(h))


def signature(found: np.ndarray, factors: np.ndarray) -> np.ndarray:
    out = np.full(len(factors), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(found), 4096):
        out = np.minimum(out, ((found[None, at : at + 4096] * factors[:, None]) >> np.uint64(32)).min(axis=1).astype(np.uint32))
    return out


def fingerprint(found: np.ndarray) -> tuple[int, int]:
    x = xxhash.xxh3_128_digest(found.tobytes())
    return int.from_bytes(x[:8], "little", signed=True), int.from_bytes(x[8:], "little", signed=True)


SKETCH = "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, bands array<bigint>"


def sketch(docs: DataFrame, rule: Rule) -> DataFrame:
    """For each document (``doc_id``, ``text``) its set's size, fingerprint and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        salt = mixed_bits(np.arange(1, rule.bands + 1, dtype=np.uint64) * _M1)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sizes, ones, twos, keys = [], [], [], []
                for text in part.column(1):
                    found = shingles(text.as_py(), rule.words, words)
                    sizes.append(len(found))
                    one, two = fingerprint(found)
                    ones.append(one)
                    twos.append(two)
                    rows = signature(found, rule.factors).reshape(rule.bands, rule.rows).astype(np.uint64)
                    key = salt.copy()
                    for r in range(rule.rows):
                        key = mixed_bits(key * _M1 + rows[:, r])
                    keys.append(key.view(np.int64))
                flat = pa.array(np.concatenate(keys) if keys else np.empty(0, dtype=np.int64))
                offsets = pa.array(np.arange(0, (len(keys) + 1) * rule.bands, rule.bands, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array(c, type=pa.int64()) for c in (sizes, ones, twos)), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "n_shingles", "h1", "h2", "bands"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(tidy(run), SKETCH)


class Forest:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def link_cell(rule: Rule, nodes: list[int], sets: list[np.ndarray], signatures: np.ndarray, known: list[int], late: list[bool] | None) -> list[tuple[int, int]]:
    """Links (node, a node of the joined component) that connect what ``known`` labels leave apart.

    With ``late`` only pairs with a late node are compared.
    """
    forest, bounds = Forest(), rule.least_matches()
    for node, label in zip(nodes, known, strict=True):
        forest.join(node, label)
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    flags = np.array(late) if late is not None else None
    roots = np.array([forest.root(n) for n in nodes])
    out = []
    for place, i in enumerate(order):
        before = order[:place]
        # the sizes alone bound the similarity
        before = before[np.searchsorted(sizes[before], math.ceil(rule.percent * sizes[i] / 100 - 1e-9)) :]
        before = before[roots[before] != roots[i]]
        if flags is not None and not flags[i]:
            before = before[flags[before]]
        start, matches = 0, np.zeros(len(before), dtype=np.int64)
        for n, least in bounds:
            if not len(before):
                break
            matches = matches + (signatures[before, start:n] == signatures[i, start:n]).sum(axis=1)
            keep = matches >= least
            before, matches, start = before[keep], matches[keep], n
        before = before[np.argsort(-matches, kind="stable")]
        while len(before):
            j, before = before[0], before[1:]
            if rule.near(sets[i], sets[j]):
                a, b = roots[i], roots[j]
                out.append((nodes[i], nodes[j]))
                roots[roots == max(a, b)] = min(a, b)
                before = before[roots[before] != roots[i]]
    return out


def link(cells: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """Verified links ``u, v`` within the cells (``h1, h2, rep, node, known, at array<struct<cell, late>>``).

    The sets are made anew from the texts of one document for each node, so they are
    shuffled once, to their cells, and never stored.
    """
    places = "array<struct<cell:bigint,late:boolean>>"
    wanted = cells.select(F.col("rep"), "h1", "h2", "node", "known", F.col("at").cast(places))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text"))
    found = join_small(texts, wanted, F.col("id").eqNullSafe(F.col("rep")), "inner", array_bytes=40 * F.size("at")).select("text", "h1", "h2", "node", "known", "at")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, kinds = _Words(), (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())

        def packed(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=["cell", "node", "known", "late", "bits", "sig"])

        out: list[tuple] = []
        held = 0
        for batch in batches:
            for i in range(batch.num_rows):
                text, h1, h2, node, known, places = (batch.column(c)[i].as_py() for c in range(6))
                made = shingles(text, rule.words, words)
                if fingerprint(made) != (h1, h2):
                    continue
                bits, sig = made.tobytes(), signature(made, rule.factors).tobytes()
                for p in places:
                    out.append((p["cell"], node, known, p["late"], bits, sig))
                    held += len(bits) + len(sig)
                    # a set that goes to many cells is copied a few cells at a time
                    if held >= HELD_BYTES:
                        yield packed(out)
                        out, held = [], 0
        yield packed(out)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: dict[int, tuple]) -> list[tuple[int, int]]:
            if len(rows) < 2:
                return []
            nodes = list(rows)
            sets = [np.frombuffer(rows[n][2], dtype=np.uint64) for n in nodes]
            sigs = np.frombuffer(b"".join(rows[n][3] for n in nodes), dtype=np.uint32).reshape(len(nodes), rule.hashes)
            lates = [rows[n][1] for n in nodes]
            return link_cell(rule, nodes, sets, sigs, [rows[n][0] for n in nodes], None if None in lates else lates)

        def links(out: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], type=pa.int64()) for i in (0, 1)], names=["u", "v"])

        cell, rows = None, {}
        for batch in batches:
            out: list[tuple[int, int]] = []
            columns = [batch.column(i) for i in range(6)]
            for i, at in enumerate(columns[0].to_pylist()):
                if at != cell:
                    out += solve(rows)
                    cell, rows = at, {}
                rows[columns[1][i].as_py()] = tuple(c[i].as_py() for c in columns[2:])
            yield links(out)
        yield links(solve(rows))

    dealt = found.mapInArrow(tidy(spread), "cell bigint, node bigint, known bigint, late boolean, bits binary, sig binary")
    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(tidy(search), "u bigint, v bigint")


def near_classes(docs: DataFrame, rule: Rule) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every document (``doc_id``, ``text``)."""
    scratch = Scratch(docs.sparkSession)
    sketched = scratch.keep(sketch(docs, rule))
    full = sketched.filter("n_shingles > 0")
    classes = full.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands"), F.any_value("n_shingles").alias("size"))
    nodes = scratch.keep(classes.withColumn("node", F.monotonically_increasing_id()))
    keyed = nodes.select("node", "size", F.explode("bands").alias("key"))
    # blocks of a bucket: by its nodes or, where texts are very long, by the bytes of its sets
    blocks_of = lambda n, size: F.greatest(F.ceil(n / CELL), F.ceil(8 * size / CELL_BYTES)).cast("long")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("all"), F.min("node").alias("low"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("s"), F.bit_xor(F.xxhash64("node", F.lit(7))).alias("x"))
    shared = shared.filter("n > 1")
    buckets = shared.groupBy("n", "low", "s", "x").agg(F.min("key").alias("key"), F.any_value("all").alias("all")).select("key", "n", blocks_of(F.col("n"), F.col("all")).alias("blocks"))
    members = scratch.keep(keyed.join(buckets, "key"))
    # a large bucket's blocks share its pivots
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    pivot = F.pmod(F.xxhash64("node", F.lit(3)), F.col("n")) < PIVOTS
    to = F.when((F.col("blocks") > 1) & pivot, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(block))
    dealt = members.select("node", "key", F.explode(to).alias("block"))
    late = F.lit(None).cast("boolean").alias("late")
    at = dealt.groupBy("node").agg(F.collect_list(F.struct(F.xxhash64("key", "block").alias("cell"), late)).alias("at"))
    base = nodes.select("node", "rep", "h1", "h2")
    cells = scratch.keep(at.join(base, "node").withColumn("known", F.col("node")))
    edges = scratch.keep(link(cells, docs, rule))
    made = [nodes, members, cells, edges]  # what only the steps up to the names read
    roots = components(edges)
    large = members.filter("blocks > 1")
    if not large.isEmpty():
        roots = scratch.keep(roots)
        labelled = scratch.keep(large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
        sizes = labelled.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("z"))
        main = sizes.groupBy("key").agg(F.max_by(F.struct("root", "z"), F.struct("c", "root")).alias("m"), F.max("c").alias("most"), F.sum("c").alias("n"), F.sum("z").alias("all")).filter("most < n")
        main = main.select("key", F.col("m.root").alias("main"), blocks_of(F.col("n") - F.col("most"), F.col("all") - F.col("m.z")).alias("late_blocks"))
        rest = labelled.join(main, "key").withColumn("late", F.col("root") != F.col("main"))
        blocks, late_blocks = F.col("blocks"), F.col("late_blocks")
        row, column = F.pmod(F.xxhash64("node"), blocks), F.pmod(F.xxhash64("node", F.lit(5)), late_blocks)
        every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
        own = F.transform(every(late_blocks), lambda c: F.struct(row.alias("r"), c.alias("c")))
        met = F.transform(every(blocks), lambda r: F.struct(r.alias("r"), column.alias("c")))
        rest = rest.withColumn("to", F.when(F.col("late"), F.array_union(own, met)).otherwise(own)).select("node", "root", "key", "late", F.explode("to").alias("to"))
        at = rest.groupBy("node").agg(F.min("root").alias("known"), F.collect_list(F.struct(F.xxhash64("key", "to").alias("cell"), "late")).alias("at"))
        cells = scratch.keep(at.join(base, "node"))
        made += [labelled, cells]
        if not cells.isEmpty():
            more = scratch.keep(link(cells, docs, rule))
            roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
    roots = scratch.keep(roots)
    ids = roots.join(base, "node").groupBy("root").agg(F.min("rep").alias("component_id"))
    named = scratch.keep(base.join(roots.join(ids, "root"), "node", "left").select("h1", "h2", F.coalesce("component_id", "rep").alias("component_id")))
    scratch.drop(*made)
    joined = full.select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2"]).select("doc_id", "n_shingles", "component_id", "h1", "h2")
    empty = sketched.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "h1", "h2")
    return joined.unionByName(empty)


def near_report(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """The contract's columns: three words and 85 percent unless another rule is given."""
    out = near_classes(docs.select("doc_id", "text"), rule or Rule(3, 85))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """The rows of ``docs`` but one for each component; documents without words all stay."""
    scratch = Scratch(docs.sparkSession)
    classes = scratch.keep(near_classes(docs.select("doc_id", "text"), rule or Rule()))
    twice = classes.filter("n_shingles > 0 and doc_id <=> component_id").groupBy("component_id").count().filter("count > 1")
    dropped = classes.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("gone")).distinct()
    if twice.isEmpty():
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # so that no column of theirs meets ours
        return join_small(rows, dropped, F.col("row.doc_id").eqNullSafe(F.col("gone")), "left_anti", limit=CANDIDATE_ROWS).select("row.*")
    # rows that repeat an id: number them, for the id alone no longer names the row that stays
    numbered = scratch.keep(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("k", F.monotonically_increasing_id()))
    by_row = scratch.keep(near_classes(numbered.select(F.col("k").alias("doc_id"), F.col("row.text").alias("text")), rule or Rule()))
    ids = numbered.select("k", "row.doc_id")
    placed = by_row.filter("n_shingles > 0").select(F.col("doc_id").alias("k"), "component_id").join(ids, "k")
    best = placed.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "k")).alias("b")).select(F.col("b.k").alias("k"))
    stay = best.unionByName(by_row.filter("n_shingles = 0").select(F.col("doc_id").alias("k")))
    return numbered.join(stay, "k", "left_semi").select("row.*")
