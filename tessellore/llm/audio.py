"""Media columns: chroma audio fingerprints and alignment of recordings.

Samples become pitch-class frames (windowed spectra folded to twelve classes); filters over
an integral image of the frames become packed 32-bit integers, one for each place in time.
Two recordings meet by parts of these integers: BANDS overlapping selections of BAND_BITS
bits each. A part of one that equals a part of the other, or differs in one bit, votes for
the offset between their places; offsets with BAND_VOTES votes are candidates. Their bit
error rate decides, where enough of the shorter recording overlaps. A part that stays the
same from place to place votes once, where it begins, so silence doesn't vote for all.

Recordings with one fingerprint form a class and are searched as one. The stated queries
are dealt into blocks of bounded size; a block's parts are sorted and sent to all tasks,
which look up the parts of their recordings in them. Only accepted pairs are written, a row
each. Measured against the search of all offsets, on recordings with noise up to 120 % of
the signal's amplitude, no pair within the error was lost (a test asks for 0.9 at least).

Edge cases: null, empty or too short recordings have an empty fingerprint, a class of
their own and no match; null samples count as silence; repeated rows share a class; an
empty table gives an empty result; only the named columns take part, so others may have
any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, tidy

RATE, HOP, FRAME = 4096, 256, 512
LOWEST, HIGHEST = 440.0, 2000.0
SMOOTH = (0.25, 0.75, 1.0, 0.75, 0.25)
FILTERS, WIDEST = 16, 8
#: Equal integers at the offset that align() asks for unless told otherwise; bits that may differ; part of the shorter recording that must overlap.
MIN_VOTES, MAX_ERROR, MIN_OVERLAP = 4, 0.2, 0.5
#: Parts of an integer, their bits, and votes that make an offset a candidate.
BANDS, BAND_BITS, BAND_VOTES = 4, 24, 2
#: Integers of a block of recordings, and of a block of queries (its sorted parts take 64 MB).
BLOCK, QUERY_BLOCK = 1 << 14, 1 << 20
#: Parts and votes that are held at a time.
HELD = 1 << 22
MOST_TASKS = 4_000


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first class, classes, frames) of the filters, spread by a rule over shape and place."""
    out = []
    for i in range(FILTERS):
        classes = 2 + 2 * (i % 4)
        out.append((i % 6, (i * 5) % (13 - classes), classes, 4 + 2 * (i % 3)))
    return out


def chroma(samples: np.ndarray) -> np.ndarray:
    """Smoothed pitch-class frames of unit length."""
    n = (len(samples) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[:: HOP][:n] * np.hanning(FRAME)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    pitch = np.fft.rfftfreq(FRAME, 1 / RATE)
    heard = np.flatnonzero((pitch >= LOWEST) & (pitch <= HIGHEST))
    fold = np.zeros((len(pitch), 12))
    fold[heard, np.round(12 * np.log2(pitch[heard] / 440.0)).astype(int) % 12] = 1
    out = power @ fold
    out = np.stack([np.convolve(out[:, c], SMOOTH, mode="same")[:n] if n >= len(SMOOTH) else out[:, c] for c in range(12)], axis=1)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-9)


def pack(frames: np.ndarray) -> np.ndarray:
    """One integer for each place where the widest filter fits: two bits a filter, in Gray code."""
    n = len(frames) - WIDEST + 1
    if n < 1:
        return np.empty(0, dtype=np.uint32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(axis=0).cumsum(axis=1)
    t = np.arange(n)

    def area(a: float, b: float, y: float, z: float) -> np.ndarray:
        a, b, y, z = int(a), int(b), int(y), int(z)
        return image[t + b, z] - image[t + a, z] - image[t + b, y] + image[t + a, y]

    out = np.zeros(n, dtype=np.uint32)
    for kind, y, high, wide in filters():
        z, my, mt = y + high, y + high / 2, wide / 2
        all_of = area(0, wide, y, z)
        if kind == 0:
            one, other = all_of, area(0, wide, 0, 12) * high / 12
        elif kind == 1:
            one, other = area(0, wide, y, my), area(0, wide, my, z)
        elif kind == 2:
            one, other = area(0, mt, y, z), area(mt, wide, y, z)
        elif kind == 3:
            one = area(0, mt, y, my) + area(mt, wide, my, z)
            other = all_of - one
        elif kind == 4:
            one = area(0, wide, y + high // 3, z - high // 3)
            other = all_of - one
        else:
            one = area(wide // 3, wide - wide // 3, y, z)
            other = all_of - one
        value = np.log1p(one) - np.log1p(other)
        level = (value > -0.25).astype(np.uint32) + (value > 0) + (value > 0.25)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))
    return out


def render(vector: list[float] | None) -> np.ndarray:
    """A recording of a vector: each value is a note of HOP samples whose pitch class is the value's rank among twelve."""
    if not vector:
        return np.empty(0)
    v = np.nan_to_num(np.array([x or 0.0 for x in vector], dtype=float))
    scale = float(np.sqrt((v**2).mean())) or 1.0
    note = np.floor(12 * (0.5 + 0.5 * np.vectorize(math.erf)(v / scale / math.sqrt(2)))).clip(0, 11)
    time = np.arange(HOP) / RATE
    return np.concatenate([np.sin(2 * np.pi * 523.25 * 2 ** (k / 12) * time) for k in note])


def fingerprint(samples: np.ndarray) -> np.ndarray:
    return pack(chroma(samples))


def fingerprints(recordings: DataFrame, identity: str, media: str, *, vectors: bool = False) -> DataFrame:
    """``rec_id, fp`` of every row; ``media`` has samples at RATE or, with ``vectors``, values to render."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for m in batch.column(1):
                got = m.as_py() or []
                out.append(fingerprint(render(got) if vectors else np.array([x or 0.0 for x in got], dtype=float)).view(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out, pa.list_(pa.int32()))], names=["rec_id", "fp"])

    return recordings.select(F.col(f"`{identity}`").cast("bigint"), F.col(f"`{media}`").cast("array<double>")).mapInArrow(tidy(run), "rec_id bigint, fp array<int>")


def band(values: np.ndarray, k: int) -> np.ndarray:
    """Part ``k`` of integers: BAND_BITS of their bits, spread by a rule."""
    out = np.zeros_like(values)
    for i in range(BAND_BITS):
        bit = np.uint32((8 * k + 5 * i) % 32)
        out |= ((values >> bit) & np.uint32(1)) << np.uint32(i)
    return out


def parts(values: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, place) of integers that lie one recording after the other, but for those that repeat the one before."""
    own = band(values, k)
    new = np.ones(len(own), dtype=bool)
    new[1:] = own[1:] != own[:-1]
    heads = np.cumsum(sizes)[:-1]
    new[heads[heads < len(own)]] = True
    at = np.flatnonzero(new)
    return own[at], at


def voted(q: np.ndarray, q_sizes: np.ndarray, r: np.ndarray, r_sizes: np.ndarray, index: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, recording, offset) with enough votes; ``index`` has each band's sorted parts of the queries and their places."""
    q_of, r_of = np.repeat(np.arange(len(q_sizes)), q_sizes), np.repeat(np.arange(len(r_sizes)), r_sizes)
    q_at, r_at = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for n in (q_sizes, r_sizes))
    shift = int(q_sizes.max())
    span = shift + int(r_sizes.max())
    flips = np.concatenate([[0], np.uint32(1) << np.arange(BAND_BITS, dtype=np.uint32)]).astype(np.uint32)
    codes = []
    for k, (keys, places) in enumerate(index):
        own, at = parts(r, r_sizes, k)
        asked, of = (own[:, None] ^ flips).ravel(), np.repeat(at, len(flips))
        low, high = np.searchsorted(keys, asked, "left"), np.searchsorted(keys, asked, "right")
        n = high - low
        hit = np.flatnonzero(n)
        n, low, of = n[hit], low[hit], of[hit]
        there = places[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        here = np.repeat(of, n)
        codes.append((q_of[there] * len(r_sizes) + r_of[here]) * span + (r_at[here] - q_at[there] + shift))
    found, votes = np.unique(np.concatenate(codes), return_counts=True)
    found = found[votes >= BAND_VOTES]
    pair, offset = found // span, found % span - shift
    return pair // len(r_sizes), pair % len(r_sizes), offset


def measured(q: np.ndarray, q_sizes: np.ndarray, r: np.ndarray, r_sizes: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> dict[tuple[int, int], tuple[int, int, int, int]]:
    """(offset, votes, overlap, differing bits) of the candidates that the rule accepts, for each pair at its best offset.

    Most equal integers first, then least error, then the nearest offset.
    """
    i, j, offset = found
    m, n = q_sizes[i], r_sizes[j]
    first = np.maximum(0, -offset)
    overlap = np.minimum(m, n - offset) - first
    enough = (overlap >= MIN_OVERLAP * np.minimum(m, n)) & (overlap > 0)
    i, j, offset, first, overlap = (x[enough] for x in (i, j, offset, first, overlap))
    left, right = (np.cumsum(q_sizes) - q_sizes)[i] + first, (np.cumsum(r_sizes) - r_sizes)[j] + first + offset
    best: dict[tuple[int, int], tuple] = {}
    by = np.argsort(overlap, kind="stable")
    for group in np.split(by, np.flatnonzero(np.diff(overlap[by])) + 1) if len(by) else []:
        size = int(overlap[group[0]])
        for some in np.split(group, range(max(1, HELD // size), len(group), max(1, HELD // size))):
            steps = np.arange(size)
            x, y = q[left[some, None] + steps], r[right[some, None] + steps]
            bits = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            good = bits <= 32 * (MAX_ERROR + 5e-7) * size
            equal = (x[good] == y[good]).sum(axis=1)
            for k, v, w in zip(some[good].tolist(), equal.tolist(), bits[good].tolist(), strict=True):
                pair, at = (int(i[k]), int(j[k])), int(offset[k])
                key = (v, -w / size, -abs(at), at)
                if pair not in best or key > best[pair][0]:
                    best[pair] = (key, (at, v, size, w))
    return {pair: x for pair, (_, x) in best.items()}


def sorted_parts(values: np.ndarray, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each band the sorted parts of queries and their places."""
    out = []
    for k in range(BANDS):
        own, at = parts(values, sizes, k)
        order = np.argsort(own, kind="stable")
        out.append((own[order], at[order]))
    return out


def pairs_of(queries: list[np.ndarray], others: list[np.ndarray]) -> dict[tuple[int, int], tuple[int, int, int, int]]:
    """(offset, votes, overlap, differing bits) of each pair (query, other) that aligns."""
    if not queries or not others:
        return {}
    q, r = np.concatenate(queries), np.concatenate(others)
    q_sizes, r_sizes = (np.array([len(x) for x in y]) for y in (queries, others))
    return measured(q, q_sizes, r, r_sizes, voted(q, q_sizes, r, r_sizes, sorted_parts(q, q_sizes)))


def _blocks(classes: DataFrame, most: int) -> DataFrame:
    """Packed ``class_id, fp`` rows of about ``most`` integers: ids, sizes and integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> pa.RecordBatch:
            parts = (np.array(ids, np.int64), np.array([len(x) for x in prints], np.int64), np.concatenate(prints))
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names=["ids", "sizes", "ints"])

        ids, prints, n = [], [], 0
        for batch in batches:
            for i, fp in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                prints.append(fp.values.to_numpy(zero_copy_only=False).astype(np.int32))
                n += len(prints[-1])
                if n >= most:
                    yield row()
                    ids, prints, n = [], [], 0
        if ids:
            yield row()

    return classes.select("class_id", "fp").filter("class_id IS NOT NULL").mapInArrow(tidy(run), "ids binary, sizes binary, ints binary")


def _unpacked(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row[0], np.int64), np.frombuffer(row[1], np.int64), np.frombuffer(row[2], np.uint32)


def search(held: DataFrame, asked: list) -> DataFrame:
    """``q, class_id, offset, votes, overlap, bits`` of the pairs of packed recordings and the packed queries of one block."""
    ids, sizes, ints = ([x[k] for x in map(_unpacked, asked)] for k in range(3))
    q_ids, q_sizes, q = np.concatenate(ids), np.concatenate(sizes), np.concatenate(ints)
    shared = held.sparkSession.sparkContext.broadcast((q_ids, q_sizes, q, sorted_parts(q, q_sizes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q_sizes, q, index = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                r_ids, r_sizes, r = _unpacked([batch.column(c)[i].as_py() for c in range(3)])
                found = measured(q, q_sizes, r, r_sizes, voted(q, q_sizes, r, r_sizes, index))
                rows = [(int(q_ids[k]), int(r_ids[j]), *x) for (k, j), x in found.items() if q_ids[k] != r_ids[j]]
                columns = list(zip(*rows, strict=True)) or [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=["q", "class_id", "offset", "votes", "overlap", "bits"])

    return held.mapInArrow(tidy(run), "q bigint, class_id bigint, offset int, votes bigint, overlap bigint, bits bigint")


def _query_blocks(asked: DataFrame) -> Iterator[list]:
    """Rows of packed queries, about QUERY_BLOCK integers at a time; one block after the other reaches the driver."""
    held, n = [], 0
    for row in asked.toLocalIterator():
        held.append(row)
        n += len(row.ints) // 4
        if n >= QUERY_BLOCK:
            yield held
            held, n = [], 0
    if held:
        yield held


def align(recordings: DataFrame, identity: str, media: str, *, is_query: Column, vectors: bool = False, min_votes: int = MIN_VOTES) -> DataFrame:
    """``rec_id, class_id, is_query, match_id, offset, votes, bit_error``: a row for each match of a query, and one for each row without any.

    A class has the least id of the recordings with its fingerprint; ``match_id`` is another
    class that aligns with the query's. ``votes`` counts whole integers that are equal at the
    offset; ``min_votes`` asks for so many, with 0 the bit error alone decides.
    """
    scratch = Scratch(recordings.sparkSession)
    made = scratch.keep(fingerprints(recordings, identity, media, vectors=vectors).withColumn("query", is_query))
    print_of = F.sha2(F.array_join("fp", ","), 256)
    keyed = made.filter(F.size("fp") > 0).select("rec_id", "query", print_of.alias("print"), "fp")
    classes = keyed.groupBy("print").agg(F.min("rec_id").alias("class_id"), F.max(F.coalesce("query", F.lit(False))).alias("asks"), F.any_value("fp").alias("fp"))
    classes = scratch.keep(classes)
    held = scratch.keep(_blocks(classes, BLOCK))
    held = held.repartition(max(1, min(held.count(), MOST_TASKS)))
    asked = scratch.keep(_blocks(classes.filter("asks"), BLOCK))
    pairs = None
    for block in _query_blocks(asked):
        one = scratch.keep(search(held, block))
        pairs = one if pairs is None else pairs.unionByName(one)
    rows = made.select("rec_id", "query", F.when(F.size("fp") > 0, print_of).alias("print"))
    named = rows.join(classes.select("print", F.col("class_id")), "print", "left").withColumn("is_query", F.coalesce("query", F.lit(False)))
    if pairs is None:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("match_id", "bigint"), ("offset", "int"), ("votes", "bigint"), ("bit_error", "double"))]
        return named.select("rec_id", F.coalesce("class_id", "rec_id").alias("class_id"), "is_query", *none)
    rate = F.round(F.col("bits") / (32 * F.col("overlap")), 6)
    found = pairs.select(F.col("q").alias("of"), F.col("class_id").alias("match_id"), "offset", "votes", rate.alias("bit_error")).filter((F.col("bit_error") <= MAX_ERROR) & (F.col("votes") >= min_votes))
    out = named.join(found, (F.col("class_id") == F.col("of")) & F.col("is_query"), "left")
    return out.select("rec_id", F.coalesce("class_id", "rec_id").alias("class_id"), "is_query", "match_id", "offset", "votes", "bit_error")
