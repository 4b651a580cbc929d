"""Secret scans: credential patterns plus sliding-window entropy.

Every whole text is searched for three patterns (assignments, access keys, long hex runs).
On top of them, candidate strings (long runs without blanks) are scanned by a sliding
window whose Shannon entropy is kept by incremental counts, once for each character class;
windows over the class's threshold merge into spans, which are added to those of the
patterns; both stay where they overlap. An allow list suppresses what is dense but public:
words, paths, identifiers made of words, UUIDs, numbers, published samples. Long runs of
letters count as words only if their letters are spread as in words.

Edge cases: a null or empty text has no spans; texts of any length are scanned whole and
in time linear in their length, but for one search in a sorted list a dense span; repeated
rows each get their own result; all columns of the input, whatever their names, pass
through unchanged beside the one that is added, whose name takes underscores until it is
free.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidy

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("secret", T.StringType())]))
BASE_KINDS = ("assign", "access", "hex")
#: All kinds in the order that breaks ties between spans with one start.
KINDS = (*BASE_KINDS, "entropy_hex", "entropy_upper", "entropy_base64")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HINTS = ("passw", "secret", "token", "api")

WINDOW = 20
#: Character class, its members, bits a character in a window of WINDOW that make it dense.
CLASSES = (
    ("entropy_hex", re.compile(r"[0-9a-fA-F]+"), 3.1),
    ("entropy_upper", re.compile(r"[A-Z0-9]+"), 3.4),
    ("entropy_base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 3.7),
)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]+")
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    re.compile(r"[0-9+/_=-]+"),
)
#: Shapes of words and of identifiers made of words, allowed if their long parts read like words.
WORDY = (
    re.compile(r"[-_/=+]*+(?:(?:[A-Z]?[a-z]++|[A-Z]++|[0-9]{1,4}+)[-_/=+]++)*+(?:[A-Z]?[a-z]++|[A-Z]++|[0-9]{1,4}+)?"),
    re.compile(r"(?:[A-Z]?[a-z]{2,}+)++[0-9]{0,4}"),
)
#: Samples from public documentation, and stand-ins that cut a string in two.
SAMPLES = ("wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
STAND_IN = re.compile(r"EXAMPLE|example|0123456789|abcdefghij|ABCDEFGHIJ")
#: A run of letters of this length must read like a word: enough vowels, few of the rare letters.
LONG_PART, LEAST_VOWELS, MOST_RARE = 16, 0.25, 0.16
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SELF_INFO = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def dense_windows(run: str, bits: float) -> Iterator[tuple[int, int]]:
    """Merged spans of the windows of ``run`` with at least ``bits`` of entropy a character.

    H = log2 W - (sum of c log2 c) / W; the sum changes by two counts for each step.
    """
    limit = WINDOW * (math.log2(WINDOW) - bits) + 1e-9
    counts: dict[str, int] = {}
    total, begun, end = 0.0, -1, -1
    for i, char in enumerate(run):
        c = counts.get(char, 0)
        counts[char] = c + 1
        total += _SELF_INFO[c + 1] - _SELF_INFO[c] if c < WINDOW else 0.0
        if i >= WINDOW - 1:
            if total <= limit:
                if begun >= 0 and i - WINDOW + 1 > end:
                    yield begun, end
                    begun = -1
                begun, end = (i - WINDOW + 1 if begun < 0 else begun), i + 1
            old = run[i - WINDOW + 1]
            c = counts[old]
            counts[old] = c - 1
            total += _SELF_INFO[c - 1] - _SELF_INFO[c]
    if begun >= 0:
        yield begun, end


def wordlike(part: str) -> bool:
    """Whether a run of letters may be a word: short, or with vowels and rare letters as words have them."""
    n, low = len(part), part.lower()
    if n < LONG_PART:
        return True
    vowels, rare = sum(map(low.count, "aeiouy")), sum(map(low.count, "jqxzkvw"))
    return vowels >= LEAST_VOWELS * n and rare <= MOST_RARE * n


def allowed(string: str) -> bool:
    """Whether a dense string is of a public kind."""
    if string in SAMPLES or any(p.fullmatch(string) for p in ALLOWED):
        return True
    return any(p.fullmatch(string) for p in WORDY) and all(map(wordlike, _PARTS.findall(string)))


def _between(string: str) -> Iterator[tuple[int, int]]:
    """The stretches of a candidate that no stand-in covers and that a window fits in."""
    at = 0
    for m in STAND_IN.finditer(string):
        if m.start() - at >= WINDOW:
            yield at, m.start()
        at = m.end()
    if len(string) - at >= WINDOW:
        yield at, len(string)


def dense_spans(candidate: str) -> list[tuple[int, int, str]]:
    """Dense spans of one candidate by class; a span within one of an earlier class is not said again."""
    out: list[tuple[int, int, str]] = []
    if allowed(candidate):
        return out
    earlier: list[tuple[list[int], list[int]]] = []  # for each class starts and ends, both ascending
    for kind, members, bits in CLASSES:
        starts, ends = [], []
        for x, y in _between(candidate):
            for r in members.finditer(candidate, x, y):
                if r.end() - r.start() < WINDOW or allowed(r[0]):
                    continue
                for a, b in dense_windows(r[0], bits):
                    a, b = a + r.start(), b + r.start()
                    if all((k := bisect.bisect_right(s, a) - 1) < 0 or e[k] < b for s, e in earlier):
                        out.append((a, b, kind))
                        starts.append(a)
                        ends.append(b)
        earlier.append((starts, ends))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost matches of the three patterns that are long enough."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out


def find_secrets(text: str | None) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) of one text in code points, by start, then kind."""
    if not text:
        return []
    out, at = base_spans(text), 0
    for word in text.split():
        if len(word) < WINDOW:
            continue
        at = text.index(word, at)
        if len(word) >= 32:
            out += [(at + m.start(), at + m.end(), "hex") for m in HEX.finditer(word) if m.end() - m.start() >= 32]
        for m in CANDIDATE.finditer(word):
            if m.end() - m.start() >= WINDOW:
                out += [(at + m.start() + a, at + m.start() + b, kind) for a, b, kind in dense_spans(m[0])]
        at += len(word)
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


@F.pandas_udf(SPANS)
def secret_spans(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "start": a, "end": b, "secret": t[a:b]} for a, b, k in find_secrets(t)] for t in texts], dtype=object)


def mask(text: str | None) -> str | None:
    """The text with each span, overlapping ones together, replaced by a marker.

    What a marker's place lets appear (patterns that overlapped) is masked in turn.
    """
    while found := find_secrets(text):
        parts, at = [], 0
        for a, b, kind in found:
            if a >= at:
                parts += [text[at:a], f"[{kind.upper()}]"]
            at = max(at, b)
        text = "".join([*parts, text[at:]])
    return text


def scan_secrets(docs: DataFrame, text: str = "text", into: str = "secrets") -> DataFrame:
    """Every row and column of ``docs`` and the spans found in its text."""
    taken = {c.lower() for c in docs.columns}
    while into.lower() in taken:
        into += "_"
    return docs.withColumn(into, secret_spans(F.col(text)))


def redact_secrets(docs: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """Every row and column of ``docs``, secrets replaced by markers; ``length`` is a column kept in step."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns = part.columns
                columns[place] = pa.array([mask(t.as_py()) for t in columns[place]], columns[place].type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    out = docs.mapInArrow(tidy(run), docs.schema)
    return out if length is None else out.withColumn(length, F.length(text).cast(docs.schema[length].dataType))


def spans_string(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the spans, comma-joined."""
    some = spans if kinds is None else F.filter(spans, lambda s: s.kind.isin(*kinds))
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document: counts, digest of the base spans, all spans."""
    found = scan_secrets(docs.select("doc_id", "text"))
    spans = F.col("secrets")
    count = lambda *kinds: F.size(F.filter(spans, lambda s: s.kind.isin(*kinds))).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(spans_string(spans, BASE_KINDS), 256).alias("base_sha256"),
        spans_string(spans).alias("spans"),
        count(*KINDS[3:]).alias("n_entropy"),
    )
