"""Best-fit packing of tokenized documents by a grouping genetic algorithm on islands.

A genome is a grouping: a list of bins. Crossover injects whole well-filled bins of one
parent into the other, removes the bins that hold a duplicate of an injected item, and
puts the displaced items back by best fit. Pieces are dealt at random over islands of
bounded size; each evolves on its own until it meets the lower bound of its items or its
generations bring nothing. After each epoch full bins are final and leave. Of the others
the elite bins migrate: they travel as whole groups to another island and are a parent
there, next to those that the island makes itself, so what one island found is crossed
into the groupings of another. The pieces of all other bins are dealt anew. The islands
get fewer from epoch to epoch, until one is left.

Edge cases: a null or empty text is one piece, the end token; the string of a special
token in a text is that token, as the tokenizer has it; documents of any length are cut
from the end so that only the first piece is short; repeated rows are packed once each;
an empty table gives an empty result; other columns of the input don't take part.
"""

from __future__ import annotations

import bisect
import functools
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, release, tidy

CAPACITY = 1024
END_TOKEN = 2
VOCABULARY = "byte_bpe_50k"
#: Pieces of an island at most, on average.
ISLAND = 6_000
POPULATION, ROUNDS = 4, 6
#: Generations at most, and those that may pass without a better grouping.
GENERATIONS, PATIENCE = 80, 20
#: A bin with no more than this many free tokens is final.
SLACK = 2
#: A bin that isn't final is an elite with no more than this many free tokens.
ELITE_SLACK = 24
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = f"uid bigint, {PIECES}, sequence_id bigint, offset bigint, final boolean, elite boolean"


@functools.lru_cache(maxsize=2)
def encoder(folder: str | None, vocabulary: str = VOCABULARY):
    """Text to ids by the named byte-level BPE, as an array.

    The rank file holds the same vocabulary as the JSON file and gives the same ids, several
    times as fast; a text that it can't take (the pattern's backtracking) goes to the JSON one.
    The strings of the added tokens that the JSON file lists are those tokens.
    """
    import base64
    import json
    import os

    import public_tokenizers
    import tiktoken

    place = public_tokenizers.path if folder is None else lambda name: os.path.join(folder, name)
    with open(place(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    with open(place(f"{vocabulary}.json"), encoding="utf-8") as file:
        added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
    fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    @functools.lru_cache(maxsize=1)
    def exact():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(place(f"{vocabulary}.json"))

    def ids(text: str) -> np.ndarray:
        try:
            if any(t in text for t in added):
                return np.array(fast.encode(text, allowed_special="all"), dtype="<u4")
            return np.array(fast.encode_ordinary(text), dtype="<u4")
        except BaseException as e:  # a panic of the pattern engine isn't an Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return np.array(exact().encode(text, add_special_tokens=False).ids, dtype="<u4")

    return ids


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n % capacity or capacity
    return [(0, min(first, n)), *((s, capacity) for s in range(first, n, capacity))]


def tokenize(docs: DataFrame, capacity: int = CAPACITY, folder: str | None = None, end_token: int = END_TOKEN) -> DataFrame:
    """The pieces of every document (``doc_id``, ``text``)."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(folder)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: list[tuple] = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    tokens = np.append(ids(text.as_py() or ""), np.array([end_token], dtype="<u4"))
                    out += [(doc_id, k, s, n, zlib.crc32(tokens[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(tokens), capacity))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(tidy(pieces), PIECES)


class Bins:
    """A grouping under construction; best fit looks the least sufficient space up."""

    def __init__(self, sizes: list[int], capacity: int) -> None:
        self.sizes, self.capacity = sizes, capacity
        self.members: list[list[int]] = []
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.spaces: list[int] = []  # distinct spaces in use, ascending

    def add(self, members: list[int], space: int) -> None:
        self.members.append(members)
        self._file(len(self.members) - 1, space)

    def _file(self, b: int, space: int) -> None:
        if space:
            if not self.by_space[space]:
                bisect.insort(self.spaces, space)
            self.by_space[space].append(b)

    def put(self, item: int) -> None:
        size = self.sizes[item]
        k = bisect.bisect_left(self.spaces, size)
        if k == len(self.spaces):
            self.add([item], self.capacity - size)
            return
        space = self.spaces[k]
        b = self.by_space[space].pop()
        if not self.by_space[space]:
            del self.spaces[k]
        self.members[b].append(item)
        self._file(b, space - size)


def fill(sizes: list[int], bins: list[list[int]], capacity: int) -> float:
    """Falkenauer's measure: the mean squared fill, which rewards full bins."""
    return sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def cross(sizes: list[int], a: list[list[int]], b: list[list[int]], capacity: int, rng: random.Random) -> list[list[int]]:
    """A child: ``b`` with well-filled bins of ``a`` injected."""
    full = [x for x in a if sum(sizes[i] for i in x) >= capacity - SLACK]
    injected = [x for x in full if rng.random() < 0.7]
    inside = {i for x in injected for i in x}
    child, displaced = Bins(sizes, capacity), []
    for x in injected:
        child.add(list(x), 0)
    for x in b:
        used = sum(sizes[i] for i in x)
        if inside.isdisjoint(x) and used >= capacity - SLACK:
            child.add(list(x), 0)
        else:
            displaced += [i for i in x if i not in inside]
    cutoff = rng.randint(0, capacity // 8)
    displaced.sort(key=lambda i: -(sizes[i] + (rng.randint(0, cutoff) if cutoff else 0)))
    for i in displaced:
        child.put(i)
    return child.members


def first_fit(sizes: list[int], order: list[int], capacity: int, groups: list[list[int]] = ()) -> list[list[int]]:
    """The grouping that best fit makes of the items in an order, beside given groups."""
    made = Bins(sizes, capacity)
    for g in groups:
        made.add(list(g), capacity - sum(sizes[i] for i in g))
    taken = {i for g in groups for i in g}
    for i in order:
        if i not in taken:
            made.put(i)
    return made.members


def evolve(sizes: list[int], capacity: int = CAPACITY, seed: int = 0, migrants: list[list[int]] = (), effort: dict | None = None) -> list[list[int]]:
    """The best grouping found of items of these sizes; never worse than best fit decreasing.

    ``migrants`` are bins that other islands hand over; they make a parent of their own.
    ``effort`` counts the crossovers.
    """
    least = -(-sum(sizes) // capacity)
    rng = random.Random(seed)
    rank = lambda g: (len(g), -fill(sizes, g, capacity))
    falling = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    scored = [first_fit(sizes, falling, capacity)]
    if migrants:
        scored.append(first_fit(sizes, falling, capacity, migrants))
    if min(map(len, scored)) == least:
        return min(scored, key=rank)
    while len(scored) < POPULATION:
        spread = 64 * len(scored)
        order = sorted(falling, key=lambda i: -(sizes[i] + rng.random() * spread))
        scored.append(first_fit(sizes, order, capacity))
    scored.sort(key=rank)
    idle = 0
    for _ in range(GENERATIONS):
        if len(scored[0]) == least or idle >= PATIENCE:
            break
        a, b = rng.sample(scored, 2)
        child = cross(sizes, a, b, capacity, rng)
        if effort is not None:
            effort["crossovers"] = effort.get("crossovers", 0) + 1
        idle = 0 if rank(child) < rank(scored[0]) else idle + 1
        scored = sorted([*scored, child], key=rank)[:POPULATION]
    return scored[0]


def island(capacity: int, last: bool, turn: int):
    """Evolves one island's pieces; says which bins are final and which others are elites."""

    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values("uid", ignore_index=True)
        sizes = items["length"].tolist()
        where = np.zeros(len(sizes), dtype=np.int64)
        offset = np.zeros(len(sizes), dtype=np.int64)
        done = np.ones(len(sizes), dtype=bool)
        elite = np.zeros(len(sizes), dtype=bool)
        uid = items["uid"].to_numpy()
        handed: dict[int, list[int]] = {}
        for i, group in enumerate(items["handed"]):
            if not pd.isna(group):
                handed.setdefault(int(group), []).append(i)
        for members in evolve(sizes, capacity, int(items["island"].iloc[0]) * 31 + turn, list(handed.values())):
            used, name = 0, min(int(uid[i]) for i in members)
            free = capacity - sum(sizes[i] for i in members)
            for i in sorted(members):
                where[i], offset[i], done[i], elite[i] = name, used, last or free <= SLACK, free <= ELITE_SLACK
                used += sizes[i]
        release()
        return items.drop(columns=["island", "handed"]).assign(sequence_id=where, offset=offset, final=done, elite=elite)

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, island_size: int = ISLAND) -> DataFrame:
    """``pieces`` with sequence_id and offset. A sequence's number is the least row number of its pieces."""
    scratch = Scratch(pieces.sparkSession)
    all_pieces = scratch.keep(pieces.withColumn("uid", F.monotonically_increasing_id()))
    own = all_pieces.filter(F.col("length") >= capacity).select(*pieces.columns, F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    done, left, names = [own], all_pieces.filter(F.col("length") < capacity).select("uid", *pieces.columns, F.lit(None).cast("long").alias("handed")), pieces.columns
    n = left.count()
    for turn in range(ROUNDS):
        islands = max(1, -(-n // island_size))
        last = islands == 1 or turn == ROUNDS - 1
        # the pieces of an elite bin travel together
        dealt = left.withColumn("island", F.pmod(F.xxhash64(F.coalesce("handed", "uid"), F.lit(turn)), F.lit(islands)))
        packed = scratch.keep(dealt.groupBy("island").applyInPandas(island(capacity, last, turn), PACKED))
        done.append(packed.filter("final").select(*names, "sequence_id", "offset"))
        if last:
            break
        left = packed.filter(~F.col("final")).select("uid", *names, F.when(F.col("elite"), F.col("sequence_id")).alias("handed"))
        n = left.count()
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, folder: str | None = None) -> DataFrame:
    """The contract's columns: every piece of every document with its place."""
    return pack(tokenize(docs.select("doc_id", "text"), capacity, folder), capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
