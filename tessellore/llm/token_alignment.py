"""Where the tokens of two tokenizers end together, and which ids lie side by side there.

A transducer reads both token sequences of a text at once. Its state is the side that
leads and the bytes that the other has not matched yet; the next token is always taken
from the side behind. Transitions are remembered by residual and next token, so bytes are
compared once for each such pair. Whenever the residual is empty, a group closes.

Texts are encoded as if whole: neither public tokenizer has a token across a lone space that
follows a character which isn't blank and precedes another, so a text is cut there, each part
with its space is encoded and aligned once, and its groups are remembered, like a transition
from one closed group to another. Other tokenizers take texts whole unless their aligner is
told where they may be cut. What a group shows, its ids as text and its id pairs, is
remembered by the group's ids as well, as most groups recur.

What two ids share is counted by document. The aligned table, one row for each document
with its distinct id pairs as packed sorted numbers, is written once; pair counts are
combined in each task, then summed by shuffle. They return to the documents as sorted
arrays: PAIRS of them at a time are sent to all executors, in as many rounds over the
aligned table as there are blocks, whose sums are added by document.

Edge cases: a text that is null or empty, or whose tokens don't give its bytes back, has
no tokens and no pairs, its numbers are zero and its digest is empty; strings of special
tokens are plain text; each row is a document, also with equal or null ids, and counts for
its pairs; texts of any length are read whole; ties for the highest count are all best; an
empty table gives an empty result; other columns of the input don't take part.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, tidy

BYTE_LEVEL, PIECES = "byte_bpe_50k", "piece_bpe_32k"
#: Transitions, and ids of groups, that a worker remembers before it starts anew.
TRANSITIONS, GROUP_IDS = 1_000_000, 1_000_000
#: Parts of texts that a worker remembers before it starts anew, and the characters of the longest of them.
PARTS, PART_CHARS = 400_000, 64
#: Where both public tokenizers begin a token, whatever stands around: Python's blanks include those of either.
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Texts that are encoded at a time, and their characters.
SLICE, SLICE_CHARS = 64, 1 << 20
#: Pairs that are sent to the executors at a time (about 50 MB).
PAIRS = 4_000_000
#: Pairs that a task combines at a time.
BATCH_PAIRS = 2_000_000
ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, times binary"


@dataclass
class Side:
    """A tokenizer: how it encodes texts, and the bytes of its ids, which spell each text after a space."""

    encode: Callable[[list[str]], list[list[int]]]
    tokens: list[bytes]


def _place(folder: str | None, name: str) -> str:
    if folder is not None:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The byte of each letter in a byte-level vocabulary: printable bytes are themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def byte_level(folder: str | None = None, vocabulary: str = BYTE_LEVEL) -> Side:
    """The byte-level BPE; a space is set before each text."""
    import json

    import tiktoken

    with open(_place(folder, f"{vocabulary}.json"), encoding="utf-8") as file:
        held = json.load(file)
    letter = _byte_letters()
    ids = held["model"]["vocab"]
    added = {t["content"]: t["id"] for t in held["added_tokens"]}
    tokens = [b""] * (1 + max([*ids.values(), *added.values()]))
    for token, i in ids.items():
        tokens[i] = token.encode() if token in added else bytes(letter[c] for c in token)
    import public_tokenizers

    ranks = {tokens[i]: i for token, i in ids.items() if token not in added}
    fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @functools.lru_cache(maxsize=1)
    def exact():
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(_place(folder, f"{vocabulary}.json"))
        out.encode_special_tokens = True
        return out

    def one(text: str) -> list[int]:
        try:
            return fast.encode_ordinary(text)
        except BaseException as e:  # a panic of the pattern engine isn't an Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return exact().encode(text, add_special_tokens=False).ids

    return Side(lambda texts: [one(f" {t}") for t in texts], tokens)


def pieces(folder: str | None = None, vocabulary: str = PIECES) -> Side:
    """The piece BPE, which sets a space before each text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=_place(folder, f"{vocabulary}.model"))
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    tokens = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
    return Side(lambda texts: model.encode(texts, num_threads=1), tokens)


class Transducer:
    """Where the tokens of two sides end together, by remembered transitions."""

    def __init__(self, a: list[bytes], b: list[bytes]) -> None:
        self.sides = (a, b)
        self.start()

    def start(self) -> None:
        """Forgets all: state 0 has no residual; of each other one its leading side and residual."""
        self.state = {(1, b""): 0}
        self.lead = [1]  # with nothing left over, the first side goes on, as if the other led
        self.rest = [b""]
        self.after: list[dict[int, int]] = [{}]
        self.known = 0

    def move(self, state: int, token: int) -> int:
        """The state after the side behind has read ``token``; -1 if its bytes differ."""
        side = 1 - self.lead[state]
        rest, new = self.rest[state], self.sides[side][token]
        if len(new) <= len(rest):
            key = (1 - side, rest[len(new) :]) if rest.startswith(new) else None
        else:
            key = (side, new[len(rest) :]) if new.startswith(rest) else None
        if key is None:
            to = -1
        elif not key[1]:
            to = 0
        else:
            to = self.state.setdefault(key, len(self.lead))
            if to == len(self.lead):
                self.lead.append(key[0])
                self.rest.append(key[1])
                self.after.append({})
        self.after[state][token] = to
        self.known += 1
        return to

    def ends(self, a: list[int], b: list[int]) -> tuple[list[int], list[int]] | None:
        """How many ids of each side are read where a group closes; None if the bytes differ."""
        if self.known > TRANSITIONS:
            self.start()
        after, lead, move = self.after, self.lead, self.move
        at_a, at_b = [], []
        i = j = state = 0
        try:
            while state or i < len(a):
                if lead[state]:  # the second side leads, or none does
                    token = a[i]
                    i += 1
                else:
                    token = b[j]
                    j += 1
                to = after[state].get(token)
                state = move(state, token) if to is None else to
                if not state:
                    at_a.append(i)
                    at_b.append(j)
                elif state < 0:
                    return None
        except IndexError:  # one side ends while the other has bytes left
            return None
        return (at_a, at_b) if j == len(b) else None


@dataclass
class Aligned:
    """The sums of a text, its groups as a string, its distinct id pairs in order and how often each is linked."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    shown: str = ""
    pairs: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))


class Aligner:
    """Aligns texts for one pair of tokenizers; a pair of ids (x, y) is the number x * (ids of the second) + y.

    ``apart`` cuts a text at spaces, which it leaves out, where no token of either side reaches from one part into the next.
    """

    def __init__(self, a: Side, b: Side, apart: Callable[[str], list[str]] | None = None) -> None:
        self.a, self.b = a, b
        self.apart = apart or (lambda text: [text])
        self.transducer = Transducer(a.tokens, b.tokens)
        self.wide = len(b.tokens)
        self.kind = np.dtype("<u4") if len(a.tokens) * self.wide < 1 << 32 else np.dtype("<i8")
        self.forget()

    def forget(self) -> None:
        self.held: dict[tuple, int] = {}  # the place of a group in the lists below
        self.shown: list[str] = []
        self.sizes = array("q")  # of each group the ids of either side
        self.ends = array("q", [0])  # where a group's distinct pairs end in the next two; the next group's begin there
        self.codes, self.times = array("q"), array("q")  # pairs, and how often each is linked
        self.parts: dict[str, tuple[bytes, str] | None] = {}  # places of a part's groups, and what they show
        self.size = 0

    def _group(self, key: tuple, p: list[int], q: list[int]) -> int:
        """A new group's place."""
        ours, theirs = Counter(p), Counter(q)
        for x, n in ours.items():
            for y, m in theirs.items():
                self.codes.append(x * self.wide + y)
                self.times.append(n * m)
        self.size += len(p) + len(q)
        self.shown.append(",".join(map(str, p)) + "|" + ",".join(map(str, q)))
        self.sizes.extend((len(p), len(q)))
        self.ends.append(len(self.codes))
        self.held[key] = len(self.shown) - 1
        return self.held[key]

    def _read(self, x: list[int], y: list[int]) -> tuple[bytes, str] | None:
        """The places of the groups of two id sequences, and what they show; None if their bytes differ."""
        ends = self.transducer.ends(x, y)
        if ends is None:
            return None
        held, places = self.held, array("q")
        i = j = 0
        for k, m in zip(*ends, strict=True):
            key = (x[i], y[j]) if k == i + 1 and m == j + 1 else (*x[i:k], -1, *y[j:m])
            got = held.get(key)
            places.append(self._group(key, x[i:k], y[j:m]) if got is None else got)
            i, j = k, m
        return places.tobytes(), ";".join([self.shown[g] for g in places])

    def _sum(self, parts: list[tuple[bytes, str]]) -> Aligned:
        """The alignment of a text of these parts."""
        places = np.frombuffer(b"".join([p for p, _ in parts]), np.int64)
        group, often = np.unique(places, return_counts=True)
        sizes, ends = np.frombuffer(self.sizes, np.int64).reshape(-1, 2)[group], np.frombuffer(self.ends, np.int64)
        first, n = ends[group], ends[group + 1] - ends[group]
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        pairs, times = np.frombuffer(self.codes, np.int64)[at], np.frombuffer(self.times, np.int64)[at] * np.repeat(often, n)
        order = np.argsort(pairs)
        pairs = pairs[order]
        heads = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        n_a, n_b = (often @ sizes).tolist()
        links = int((often * sizes[:, 0] * sizes[:, 1]).sum())
        return Aligned(n_a, n_b, len(places), links, ";".join([s for _, s in parts]), pairs[heads].astype(self.kind), np.add.reduceat(times[order], heads))

    def _align(self, x: list[int], y: list[int]) -> Aligned | None:
        found = self._read(x, y)
        return found and self._sum([found])

    def texts(self, texts: list[str | None]) -> list[Aligned]:
        """The alignment of each text; one without tokens for what is empty or isn't spelled by them."""
        if self.size > GROUP_IDS or len(self.parts) > PARTS:
            self.forget()
        known = self.parts
        cut = [self.apart(t) if t else [] for t in texts]
        new = list({p for parts in cut for p in parts if p not in known})
        spell_a, spell_b = self.a.tokens, self.b.tokens
        for p, x, y in zip(new, self.a.encode(new), self.b.encode(new), strict=True):
            raw = f" {p}".encode()
            spelled = b"".join([spell_a[i] for i in x]) == raw == b"".join([spell_b[i] for i in y])
            known[p] = self._read(x, y) if spelled else None
        out = []
        for parts in cut:
            found = [known[p] for p in parts]
            out.append(self._sum(found) if found and None not in found else Aligned())
        for p in new:
            if len(p) > PART_CHARS:
                del known[p]
        return out


@functools.lru_cache(maxsize=1)
def standard(folder: str | None) -> Aligner:
    """The aligner of the two public vocabularies, one for a worker."""
    return Aligner(byte_level(folder), pieces(folder), LONE_SPACE.split)


def _narrow(times: np.ndarray) -> bytes:
    """The numbers in as few bytes each as the largest needs; how many tells the length."""
    return times.astype(np.uint8 if not len(times) or times.max() < 1 << 8 else np.int64).tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8 if len(raw) == n else np.int64).astype(np.int64)


def align_texts(docs: DataFrame, of: str = "doc_id", text: str = "text", *, aligner: Callable[[], Aligner] | None = None, folder: str | None = None, groups: bool = False) -> DataFrame:
    """One row for each document: its numbers, the digest of its groups, its packed pairs and their times; with ``groups`` also the groups as a string."""
    make = aligner or functools.partial(standard, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = make()
        kinds = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.binary()] + [pa.string()] * groups
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"] + ["groups"] * groups
        def done(ids: list, texts: list) -> pa.RecordBatch:
            rows = []
            for i, s in zip(ids, made.texts(texts), strict=True):
                digest = hashlib.sha256(s.shown.encode()).hexdigest() if s.n_a else ""
                rows.append((i, s.n_a, s.n_b, s.n_groups, s.n_links, digest, s.pairs.astype(made.kind).tobytes(), _narrow(s.times), s.shown)[: len(names)])
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                texts.append(t.as_py())
                size += len(texts[-1] or "")
                if len(ids) == SLICE or size > SLICE_CHARS:
                    yield done(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield done(ids, texts)

    slim = docs.select(F.col(f"`{of}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return slim.mapInArrow(tidy(run), ALIGNED + ", groups string" * groups)


def pair_counts(aligned: DataFrame, kind: str, wide: int) -> DataFrame:
    """``pair, n, best``: in how many documents a pair is linked, and whether that is the highest count of its first id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def done() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate(held) if held else np.empty(0, kind), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(n.astype(np.int64))], names=["pair", "n"])

        for batch in batches:
            for raw in batch.column(0):
                held.append(np.frombuffer(raw.as_py(), kind))
                size += len(held[-1])
                if size >= BATCH_PAIRS:
                    yield done()
                    held, size = [], 0
        yield done()

    summed = aligned.select("pairs").mapInArrow(tidy(run), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    summed = Scratch(aligned.sparkSession).keep(summed.withColumn("a", F.expr(f"pair div {wide}")))
    most = summed.groupBy(F.col("a").alias("of")).agg(F.max("n").alias("most"))
    return summed.join(most, F.col("a") == F.col("of")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _block(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of a block in order, with their counts and whether they are best."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array([c.astype(t).tobytes()], pa.binary()) for c, t in zip(columns, (np.int64, np.int64, np.bool_), strict=True)], names=["pair", "n", "best"])

    rows = list(counts.mapInArrow(tidy(pack), "pair binary, n binary, best binary").toLocalIterator())
    pair, n, best = (np.frombuffer(b"".join(r[k] for r in rows), t) for k, t in enumerate((np.int64, np.int64, np.bool_)))
    order = np.argsort(pair, kind="stable")
    return pair[order], n[order], best[order]


def look_up(aligned: DataFrame, counts: DataFrame, kind: str) -> DataFrame:
    """``uid, n_best, count_sum`` of the aligned documents with pairs among the counts, which are sent to all executors."""
    shared = aligned.sparkSession.sparkContext.broadcast(_block(counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            sums: list[tuple[int, int]] = []
            for raw, often in zip(batch.column(1), batch.column(2), strict=True):
                codes = np.frombuffer(raw.as_py(), kind).astype(np.int64)
                times = _wide(often.as_py(), len(codes))
                at = np.minimum(np.searchsorted(pair, codes), max(0, len(pair) - 1))
                hit = pair[at] == codes if len(pair) else np.zeros(len(codes), bool)
                at, times = at[hit], times[hit]
                sums.append((int(times[best[at]].sum()), int((times * n[at]).sum())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in sums], pa.int64()), pa.array([y for _, y in sums], pa.int64())], names=["uid", "n_best", "count_sum"])

    return aligned.select("uid", "pairs", "times").mapInArrow(tidy(run), "uid bigint, n_best bigint, count_sum bigint")


def alignment_report(docs: DataFrame, *, aligner: Callable[[], Aligner] | None = None, folder: str | None = None) -> DataFrame:
    """The contract's columns for every document."""
    scratch = Scratch(docs.sparkSession)
    made = (aligner or functools.partial(standard, folder))()
    kind, wide = made.kind.str, len(made.b.tokens)
    aligned = scratch.keep(align_texts(docs, aligner=aligner, folder=folder).withColumn("uid", F.monotonically_increasing_id()))
    counts = scratch.keep(pair_counts(aligned, kind, wide))
    blocks = counts.count() // PAIRS + 1
    sums = None
    for k in range(blocks):
        part = look_up(aligned, counts.filter(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == k), kind)
        part = scratch.keep(part)
        sums = part if sums is None else sums.unionByName(part)
    if blocks > 1:
        sums = sums.groupBy("uid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    joined = aligned.select("uid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "uid")
    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
