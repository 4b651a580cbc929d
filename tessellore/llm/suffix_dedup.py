"""Exact repeated substrings over a corpus by two-stage suffix sorting.

A byte goes if a LENGTH-byte string that covers it also starts earlier: in a document with
a smaller id, or before in the same one. The steps, all over whole texts:

1. Texts that are copies of an earlier one go whole, by their digest.
2. Anchors: every LENGTH-byte string selects the GRAM-byte string in it of least hash, so
   equal strings select equal anchors at one place. Only anchors that occur twice can lie
   in a repeat. Their hashes are counted with a combine in each task.
3. Of repeated anchors the context is sent, all LENGTH-byte strings around the anchor;
   contexts that are equal to an earlier one are wholly repeated and only counted.
4. Contexts that share an anchor but differ go into one suffix array: suffixes smaller
   than their successors are sorted directly, the others induced from them by scans over
   the first-byte buckets; adjacent common prefixes of LENGTH bytes or more are repeats.
5. The repeats of a document are merged, and its remaining bytes are digested.

Before anything is shuffled, equal contexts of a batch are combined, so that a passage that
many documents share arrives once for each batch. Of an anchor that occurs more than HOT
times each string around it is keyed by itself, so its occurrences with other surroundings
spread over all tasks and no task or suffix array gets more than HOT contexts of one anchor.

Edge cases: a null or empty text has no bytes; texts of any length are cut nowhere; rows
that repeat an id are ordered by id, then digest, and equal rows are one document; a null
id comes after all others; an empty table gives an empty result; other columns of the
input don't take part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, join_small, tidy
from .minhash import mixed_bits

LENGTH, GRAM = 100, 32
BATCH_BYTES = 2 << 20
BUCKET_BYTES = 8 << 20
#: Bytes of the texts of one suffix array, if no single anchor has more.
ARRAY_BYTES = 1 << 20
JOIN_ROWS = 400_000
#: Shuffle partitions at most; beyond as many buckets, a partition holds several, which are read one after the other.
PARTITIONS = 20_000
#: Occurrences of an anchor, and so contexts in one suffix array, before its strings are dealt one by one.
HOT = 6_000
#: Bytes of contexts that a batch holds before it hands them on.
HELD_BYTES = 8 << 20
_P = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Polynomial hashes of the ``size`` bytes from each place, a power of two, by doubling."""
    h, power, m = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(_P), _P, 1
    while m < size:
        h = h[: len(h) - m] * np.uint64(power) + h[m:]
        power, m = (power * power) & 0xFFFFFFFFFFFFFFFF, 2 * m
    return mixed_bits(h)


def _slide(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least (or largest) of ``width`` values from each place."""
    best, m = values, 1
    pick = np.minimum if least else np.maximum
    while 2 * m <= width:
        best, m = pick(best[: len(best) - m], best[m:]), 2 * m
    return best if m == width else pick(best[: len(best) - (width - m)], best[width - m :])


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of texts that lie one after the other and end at ``ends``."""
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    width = length - GRAM + 1
    hashes = gram_hashes(data)
    order = (hashes >> np.uint64(32)).astype(np.uint32)
    order = np.minimum(order, np.uint32(0xFFFFFFFE))
    valid = np.ones(len(data), dtype=bool)
    inner = np.ones(len(data), dtype=bool)
    for end in ends:
        inner[max(0, end - GRAM + 1) : end] = False
        valid[max(0, end - length + 1) : end] = False
    order[~inner[: len(order)]] = 0xFFFFFFFF
    low = _slide(order, width, True) + np.uint32(1)
    low[~valid[: len(low)]] = 0
    # a place is an anchor if it has the least value of some valid string around it
    edge = np.zeros(width - 1, dtype=np.uint32)
    top = _slide(np.concatenate([edge, low, edge]), width, False)
    at = np.flatnonzero(top[: len(order)] == order + np.uint32(1))
    at = at[inner[at]]
    return at, hashes[at]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list]]:
    """(ids, bytes, ends, further columns) of some documents at a time, about BATCH_BYTES."""
    for batch in batches:
        ids, held, more, size = [], [], [], 0
        n = batch.num_rows
        for i in range(n):
            raw = batch.column(1)[i].as_py() or b""
            ids.append(batch.column(0)[i].as_py())
            held.append(raw)
            more.append([batch.column(c)[i].as_py() for c in range(2, batch.num_columns)])
            size += len(raw)
            if size >= BATCH_BYTES or i == n - 1:
                yield np.array(ids, dtype=np.int64), np.frombuffer(b"".join(held), dtype=np.uint8), np.cumsum([len(x) for x in held]), more
                ids, held, more, size = [], [], [], 0


def find_anchors(texts: DataFrame) -> DataFrame:
    """``hash, did, place`` of the anchors of ``did, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, ends, _ in _texts(batches):
            at, hashes = anchors(data, ends)
            doc = np.searchsorted(ends, at, side="right")
            place = (at - (ends[doc] - np.diff(ends, prepend=0)[doc])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(ids[doc]), pa.array(place)], names=["hash", "did", "place"])

    return texts.mapInArrow(tidy(run), "hash bigint, did bigint, place int")


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each bucket of sorted batches, without the bucket."""
    now, rows = None, []
    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns)]
        for i, b in enumerate(columns[0].to_pylist()):
            if b != now and rows:
                yield rows
                rows = []
            now = b
            rows.append(tuple(c[i].as_py() for c in columns[1:]))
    if rows:
        yield rows


def repeated_anchors(found: DataFrame) -> DataFrame:
    """``did, place`` of the anchors that occur more than once; -1 - place of those that do more than HOT times.

    Hashes are counted with a combine in each task; only those that repeat come back to
    their occurrences, by a join whose hot hashes adaptive execution splits. No task holds the occurrences of a hash.
    """
    counts = found.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("hash").alias("of"), (F.col("n") > HOT).alias("hot"))
    counts = Scratch(found.sparkSession).keep(counts)
    met = found.join(counts, F.col("hash") == F.col("of"))  # alike at every size
    return met.select("did", F.when(F.col("hot"), -1 - F.col("place")).otherwise(F.col("place")).cast("int").alias("place"))


CONTEXTS = "bucket int, spans boolean, hashes binary, docs binary, starts binary, lengths binary, bytes binary"


def contexts(texts: DataFrame, buckets: int, length: int = LENGTH) -> DataFrame:
    """Packed contexts of ``did, text, places`` by bucket, and spans of contexts that their batch has earlier."""

    def pack(first: dict, repeats: list) -> pa.RecordBatch:
        groups: dict[int, list] = {}
        for (key, _), (h, did, start) in first.items():
            groups.setdefault(h % buckets, []).append((h, did, start, key))
        rows: list[tuple] = []
        for bucket, found in groups.items():
            h, did, start, keys = zip(*found, strict=True)
            rows.append((bucket, False, np.array(h, np.uint64).tobytes(), np.array(did, np.int64).tobytes(), np.array(start, np.int64).tobytes(), np.array([len(x) for x in keys], np.int64).tobytes(), b"".join(keys)))
        if repeats:
            did, start, end = (np.array(x, np.int64) for x in zip(*repeats, strict=True))
            rows.append((int(did[0]) % buckets, True, b"", did.tobytes(), start.tobytes(), (end - start).tobytes(), b""))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        kinds = (pa.int32(), pa.bool_(), *[pa.binary()] * 5)
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=["bucket", "spans", "hashes", "docs", "starts", "lengths", "bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, ends, more in _texts(batches):
            raw, first, repeats, within, held = data.tobytes(), {}, [], set(), 0
            begun = 0

            def again(did: int, start: int, end: int) -> None:
                """One more repeated stretch, in one with the last if they touch."""
                if repeats and repeats[-1][0] == did and repeats[-1][1] <= start <= repeats[-1][2]:
                    repeats[-1][2] = max(end, repeats[-1][2])
                else:
                    repeats.append([did, start, end])

            for k in np.argsort(ids, kind="stable"):
                end = int(ends[k])
                begun = int(ends[k - 1]) if k else 0
                did = int(ids[k])
                places = set(more[k][0])
                spread = {x for x in places if x < 0}
                around: list[tuple[int, int, int]] = []  # (start, end, 0 or the anchor's place in it)
                for place in places - spread:
                    p = begun + place
                    a, b = max(begun, p - (length - GRAM)), min(end, p + length)
                    if b - a >= length:
                        around.append((a, b, p))
                # what occurs very often is keyed by each whole string, so that no task gets all of it
                single = {a for x in spread for a in range(max(begun, begun - 1 - x - (length - GRAM)), min(end - length, begun - 1 - x) + 1)}
                around += [(a, a + length, -1) for a in single]
                for a, b, p in sorted(around):
                    key = raw[a:b]
                    # clipped contexts of several anchors may be one stretch, which is filed under each of them
                    tag = (key, b"" if p < 0 else raw[p : p + GRAM])
                    if tag not in first:
                        first[tag] = (xxhash.xxh3_64_intdigest(tag[1] or key), did, a - begun)
                        held += len(key)
                    elif first[tag][1:] != (did, a - begun):
                        again(did, a - begun, b - begun)
                    elif tag not in within:
                        # one stretch that has its anchor twice is no repeat of itself, but strings in it may be
                        within.add(tag)
                        begins = {raw[x : x + length]: x for x in range(b - length, a - 1, -1)}
                        for x in range(a, b - length + 1):
                            if begins[raw[x : x + length]] < x:
                                again(did, x - begun, x + length - begun)
                    if p < 0 and held >= HELD_BYTES:
                        yield pack(first, repeats)
                        first, repeats, within, held = {}, [], set(), 0
                if held >= HELD_BYTES:
                    yield pack(first, repeats)
                    first, repeats, within, held = {}, [], set(), 0
            yield pack(first, repeats)

    return texts.mapInArrow(tidy(run), CONTEXTS)


def suffix_order(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """The suffixes of ``text`` by their first ``depth`` bytes, those of its zero bytes left out.

    Zero bytes end the strings in it and are less than all others. Stage one sorts the
    suffixes that are smaller than their successors; stage two scans the buckets of first
    bytes upward and files before each suffix met the larger one that precedes it.
    """
    n = len(text)
    step = np.diff(text.astype(np.int16), append=0)
    kind = np.sign(step)  # of the next byte against this one; a run takes the kind of its end
    last = np.where(kind != 0, np.arange(n), n)
    last = np.minimum.accumulate(last[::-1])[::-1]
    smaller = np.zeros(n, dtype=bool)
    some = last < n
    smaller[some] = kind[last[some]] > 0
    smaller &= text != 0
    larger = ~smaller & (text != 0)
    direct = np.flatnonzero(smaller)
    padded = np.concatenate([text, np.zeros(depth, dtype=np.uint8)])
    stop = np.where(padded == 0, np.arange(len(padded)), len(padded))
    stop = np.minimum.accumulate(stop[::-1])[::-1]
    keys = np.lib.stride_tricks.sliding_window_view(padded, depth)[direct]
    keys[np.arange(depth)[None, :] >= (stop[direct] - direct)[:, None]] = 0
    direct = direct[np.argsort(keys.view(f"S{depth}").ravel(), kind="stable")]
    heads = text[direct]
    direct_of = {int(c): direct[heads == c] for c in np.unique(heads)}
    pending: dict[int, list[np.ndarray]] = {}
    out: list[np.ndarray] = []

    def induce(found: np.ndarray, c: int) -> np.ndarray:
        """File what precedes, by its byte; return what belongs to this bucket itself."""
        before = found[found > 0] - 1
        before = before[larger[before]]
        heads = text[before]
        for d in np.unique(heads):
            if d > c:
                pending.setdefault(int(d), []).append(before[heads == d])
        return before[heads == c]

    induce(np.flatnonzero(text == 0), 0)
    for c in range(1, 256):
        level = np.concatenate(pending.pop(c)) if c in pending else None
        while level is not None and len(level):
            out.append(level)
            level = induce(level, c)
        if c in direct_of:
            out.append(direct_of[c])
            induce(direct_of[c], c)
    return np.concatenate(out) if out else np.empty(0, dtype=np.int64)


def repeats_in(parts: list[bytes], docs: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(document, start) of the strings of ``length`` bytes in the contexts that also start earlier."""
    # UTF-8 has no byte 255, so all bytes move up by one and zero is free to end the contexts
    sizes = np.array([len(p) for p in parts])
    text = np.frombuffer(b"\xff".join(parts) + b"\xff", dtype=np.uint8) + np.uint8(1)
    heads = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    order = suffix_order(text, length)
    part = np.searchsorted(heads, order, side="right") - 1
    left = heads[part] + sizes[part] - order
    fits = left >= length
    order, part = order[fits], part[fits]
    if not len(order):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(text, length)
    equal = np.zeros(len(order), dtype=bool)
    for at in range(1, len(order), 20_000):
        some = windows[order[at - 1 : at + 20_000]]
        equal[at : at + len(some) - 1] = (some[1:] == some[:-1]).all(axis=1)  # common prefix of length or more
    doc, start = docs[part], starts[part] + order - heads[part]
    place = np.lexsort((start, doc))
    changed = np.ones(len(place), dtype=np.int64)
    changed[1:] = (np.diff(doc[place]) != 0) | (np.diff(start[place]) != 0)
    rank = np.empty(len(place), dtype=np.int64)
    rank[place] = np.cumsum(changed)
    groups = np.flatnonzero(~equal)
    least = np.minimum.reduceat(rank, groups)
    later = rank > np.repeat(least, np.diff(groups, append=len(rank)))
    return doc[later], start[later]


def merge_spans(docs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(docs):
        return docs, starts, ends
    by = np.lexsort((starts, docs))
    docs, starts, ends = docs[by], starts[by], ends[by]
    fresh = np.concatenate([[True], docs[1:] != docs[:-1]])
    reach = ends.copy()
    # the largest end so far within the document
    base = np.cumsum(fresh) * (int(ends.max()) + 1)
    reach = np.maximum.accumulate(ends + base) - base
    cut = fresh.copy()
    cut[1:] |= starts[1:] > reach[:-1]
    at = np.flatnonzero(cut)
    return docs[at], starts[at], np.maximum.reduceat(reach, at)


def repeated_spans(packed: DataFrame, buckets: int, length: int = LENGTH) -> DataFrame:
    """``did, start, end`` of runs of bytes that packed contexts show to be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_bucket(batches):
            known, asked = [r for r in rows if r[0]], [r for r in rows if not r[0]]
            join = lambda some, i: np.frombuffer(b"".join(r[i] for r in some), dtype=np.int64)
            spans = [(join(known, 2), join(known, 3), join(known, 3) + join(known, 4))]
            hashes, docs, starts, sizes = np.frombuffer(b"".join(r[1] for r in asked), dtype=np.uint64), join(asked, 2), join(asked, 3), join(asked, 4)
            raw = b"".join(r[5] for r in asked)
            heads = np.concatenate([[0], np.cumsum(sizes)])
            by = np.lexsort((starts, docs, hashes))
            # equal contexts: only the earliest goes on
            groups, parts, at_doc, at_start, total, now = [], [], [], [], 0, None
            seen: dict[bytes, int] = {}
            again: list[int] = []
            fresh: list[int] = []

            def close() -> None:
                nonlocal total
                if len(fresh) > 1:
                    if total + sizes[fresh].sum() > ARRAY_BYTES:
                        solve()
                    for i in fresh:
                        parts.append(raw[heads[i] : heads[i + 1]])
                        at_doc.append(docs[i])
                        at_start.append(starts[i])
                        total += len(parts[-1])
                if total >= ARRAY_BYTES:
                    solve()
                fresh.clear()
                seen.clear()

            def solve() -> None:
                nonlocal total
                if parts:
                    d, s = repeats_in(parts, np.array(at_doc, np.int64), np.array(at_start, np.int64), length)
                    spans.append(merge_spans(d, s, s + length))
                parts.clear()
                at_doc.clear()
                at_start.clear()
                total = 0

            for i in by:
                if now is not None and hashes[i] != now:
                    close()
                now = hashes[i]
                key = raw[heads[i] : heads[i + 1]]
                if key in seen:
                    again.append(i)
                else:
                    seen[key] = i
                    fresh.append(i)
            close()
            solve()
            spans.append((docs[again], starts[again], starts[again] + sizes[again]))
            d, s, e = merge_spans(*(np.concatenate([x[i] for x in spans]) for i in range(3)))
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(s), pa.array(e)], names=["did", "start", "end"])

    return packed.repartition(min(buckets, PARTITIONS), "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(run), "did bigint, start bigint, end bigint")


CUT = T.StructType([T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())])


def cut_spans(raw: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Removed bytes, maximal removed runs and what remains."""
    runs: list[list[int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    kept, at = [], 0
    for a, b in runs:
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return sum(b - a for a, b in runs), len(runs), b"".join(kept)


def _cut(keep_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for did, raw, starts, ends in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    removed, runs, rest = cut_spans(raw, list(zip(starts, ends, strict=True)))
                    rows.append((did, removed, runs, hashlib.sha256(rest).hexdigest(), rest if keep_bytes else None))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=["did", "n_removed", "n_spans", "kept_sha256", "rest"])

    return run


def repeats(docs: DataFrame, keep_bytes: bool = False) -> DataFrame:
    """For each row of ``doc_id, text``: n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the bytes that remain."""
    scratch = Scratch(docs.sparkSession)
    raw = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "utf-8")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), raw.alias("raw")).withColumn("sha", F.unhex(F.sha2("raw", 256)))
    slim = scratch.keep(texts.select("doc_id", "sha", F.octet_length("raw").cast("long").alias("n_bytes")))
    first = slim.filter(F.col("n_bytes") >= LENGTH).groupBy("sha").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id")).alias("f"), F.any_value("n_bytes").alias("n"))
    first = scratch.keep(first.select("sha", F.col("f.doc_id").alias("first_id"), "n"))
    stats = first.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("bytes"), F.count_distinct("first_id").alias("ids")).first()
    buckets = max(16, -(-int(stats.bytes or 0) // BUCKET_BYTES))
    held = slim.join(first, "sha")
    equal_rows = held.filter(F.col("doc_id").eqNullSafe(F.col("first_id"))).count() > stats.n
    copies = held.filter(~F.col("doc_id").eqNullSafe(F.col("first_id"))).select(F.col("doc_id").alias("c_id"), F.col("sha").alias("c_sha")).distinct()
    if stats.ids == stats.n:
        work = texts.withColumn("did", F.col("doc_id"))
    else:
        # ids that repeat or are null: numbers in the order of id, then digest
        numbered = scratch.keep(first.orderBy(F.col("first_id").asc_nulls_last(), "sha").select(F.col("first_id").alias("n_id"), F.col("sha").alias("n_sha")).withColumn("did", F.monotonically_increasing_id()))
        work = join_small(texts, numbered, F.col("doc_id").eqNullSafe(F.col("n_id")) & (F.col("sha") == F.col("n_sha")), "inner", limit=JOIN_ROWS)
        first = scratch.keep(first.join(numbered, F.col("first_id").eqNullSafe(F.col("n_id")) & (F.col("sha") == F.col("n_sha"))).select("sha", "first_id", "n", "did"))
    work = join_small(work.filter(F.octet_length("raw") >= LENGTH), copies, (F.col("sha") == F.col("c_sha")) & F.col("doc_id").eqNullSafe(F.col("c_id")), "left_anti", limit=JOIN_ROWS)
    work = work.select("did", "raw").dropDuplicates(["did"]) if equal_rows else work.select("did", "raw")
    found = scratch.keep(find_anchors(work))
    hits = repeated_anchors(found).groupBy("did").agg(F.collect_list("place").alias("places"))
    hits = scratch.keep(hits)
    scratch.drop(found)
    met = join_small(work, hits.withColumnRenamed("did", "h_did"), F.col("did") == F.col("h_did"), "inner", array_bytes=4 * F.size("places")).select("did", "raw", "places")
    spans = repeated_spans(contexts(met, buckets), buckets).groupBy("did").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    spans = scratch.keep(spans)
    hurt = join_small(work, spans.withColumnRenamed("did", "s_did"), F.col("did") == F.col("s_did"), "inner", array_bytes=16 * F.size("starts")).select("did", "raw", "starts", "ends")
    changed = scratch.keep(hurt.mapInArrow(tidy(_cut(keep_bytes)), "did bigint, n_removed bigint, n_spans bigint, kept_sha256 string, rest binary").dropDuplicates(["did"]))
    known = first.withColumn("did", F.col("first_id")) if stats.ids == stats.n else first
    known = scratch.keep(known.join(changed, "did", "left").select("sha", "first_id", "n_removed", "n_spans", "kept_sha256", *["rest"] * keep_bytes))
    scratch.drop(hits, spans, changed)
    all_rows = slim.join(known, "sha", "left")
    copy = F.col("n_bytes") >= LENGTH
    copy = copy & ~F.col("doc_id").eqNullSafe(F.col("first_id"))
    empty = hashlib.sha256(b"").hexdigest()
    out = [
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(empty)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
    ]
    return all_rows.select(*out, *([F.when(copy, F.lit(b"")).otherwise(F.col("rest")).alias("rest")] if keep_bytes else []))


def repeat_report(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    return repeats(docs.select("doc_id", "text"))
