"""Cross-tokenizer alignment against byte offsets of whole texts."""

import functools
import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer, decoders

from tessellore.llm import token_alignment as ta

SCHEMA = "doc_id bigint, text string"


@functools.lru_cache(maxsize=1)
def tools():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@functools.lru_cache(maxsize=1)
def letters():
    """The byte of each letter of the byte-level vocabulary."""
    one, out = decoders.ByteLevel(), {}
    shown = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    n = 0
    for b in range(256):
        if b in shown:
            out[chr(b)] = b
        else:
            out[chr(256 + n)] = b
            n += 1
    assert one.decode([k for k, b in out.items() if b < 128]) == "".join(chr(b) for k, b in out.items() if b < 128)
    return out


def tokens_of(text):
    t, sp = tools()
    a = t.encode(" " + text, add_special_tokens=False).ids
    b = sp.encode(text)
    left = [bytes(letters()[c] for c in t.id_to_token(i)) for i in a]
    right = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
    return a, b, left, right


def groups_of(text):
    if not text:
        return None
    a, b, left, right = tokens_of(text)
    raw = (" " + text).encode()
    if b"".join(left) != raw or b"".join(right) != raw:
        return None

    def ends(parts):
        at, out = 0, []
        for p in parts:
            at += len(p)
            out.append(at)
        return out

    x, y = ends(left), ends(right)
    groups, low = [], 0
    for cut in sorted(set(x) & set(y)):
        groups.append(([i for i, e in zip(a, x) if low < e <= cut], [i for i, e in zip(b, y) if low < e <= cut]))
        low = cut
    return groups


def brute(rows):
    held = [(i, groups_of(t)) for i, t in rows]
    n = Counter()
    for _, g in held:
        n.update({(x, y) for p, q in g or [] for x in p for y in q})
    most = defaultdict(int)
    for (x, _), v in n.items():
        most[x] = max(most[x], v)
    out = []
    for i, g in held:
        if g is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for p, q in g for x in p for y in q]
        shown = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in g)
        out.append((i, sum(len(p) for p, _ in g), sum(len(q) for _, q in g), len(g), len(links), sum(n[e] == most[e[0]] for e in links), sum(n[e] for e in links), hashlib.sha256(shown.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed=1, n=150):
    rng = random.Random(seed)
    parts = ["Hello", "world's", "naïve", "東京", "𝒳y", "12345", "foo_bar", "...", "—", "", " ", "\n", "\n\n", "\t", "\xa0", "　", "\x85", "\x1c", " ", "\x00", "don't", "<s>", "</s>", "<unk>", "<0x0A>", "<|endoftext|>", "ÀÉ", "é", "aaaaaaaa", "🙂🙂", "\r\n", "-----", "    x", "word,", "(a)", "ﬁ", "​"]
    docs = [(k, "".join(rng.choice(parts) + rng.choice([" ", " ", "", "\n", "  "]) for _ in range(rng.randint(0, 14)))) for k in range(n)]
    docs += [(900, None), (901, ""), (902, " "), (903, "\n"), (904, "has ▁ mark"), (905, "▁"), (906, " lead"), (907, "trail "), (908, "x" * 3000), (909, "ab " * 2000), (910, "\n" * 50 + "y"), (911, "  " * 33 + "z"), (None, "no id"), (None, "no id"), (912, "東" * 700)]
    return docs + docs[:20]


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_equals_brute_force(spark):
    rows = corpus()
    assert rows_of(ta.alignment_report(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)


def test_the_documents_of_the_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(ta.alignment_report(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_blocks_of_pairs_and_small_memories_change_nothing(spark, monkeypatch):
    for name, value in (("PAIRS", 150), ("BATCH_PAIRS", 40), ("GROUP_IDS", 12), ("TRANSITIONS", 20), ("SLICE", 4), ("SLICE_CHARS", 50)):
        monkeypatch.setattr(ta, name, value)
    rows = corpus(4, 60)
    assert rows_of(ta.alignment_report(spark.createDataFrame(rows, SCHEMA).repartition(2))) == brute(rows)


def test_other_tokenizers_and_unequal_bytes(spark):
    def make():
        side = ta.Side(lambda texts: [["abc ".index(c) + 3 for c in f" {t}"] for t in texts], [b"", b"", b"?", b"a", b"b", b"c", b" "])
        pairs = ta.Side(lambda texts: [["abc ".index(c) for c in f" {t}"[: 3 if t == "aaa" else None]] for t in texts], [b"a", b"b", b"c", b" "])
        return ta.Aligner(side, pairs)

    rows = [(1, "abc"), (2, "a a"), (3, None), (4, "aaa")]
    out = rows_of(ta.align_texts(spark.createDataFrame(rows, SCHEMA), aligner=make, groups=True).select("doc_id", "n_groups", "n_links", "groups"))
    assert out == [(1, 4, 4, "6|3;3|0;4|1;5|2"), (2, 4, 4, "6|3;3|0;6|3;3|0"), (3, 0, 0, ""), (4, 0, 0, "")]


def test_transitions_are_remembered_by_residual_and_token():
    t = ta.Transducer([b"ab", b"c", b"abc"], [b"a", b"bc", b"abcabc"])
    assert t.ends([0, 1], [0, 1]) == ([2], [2])
    known = [dict(x) for x in t.after]
    assert t.ends([0, 1, 0, 1], [0, 1, 0, 1]) == ([2, 4], [2, 4]) and t.after == known
    assert t.ends([2, 2], [2]) == ([2], [1])
    assert t.ends([0], [1]) is None and t.ends([0], [0]) is None and t.ends([], []) == ([], []) and t.ends([], [0]) is None


def test_long_groups_count_pairs_without_listing_them():
    aligner = ta.Aligner(ta.Side(None, [b"aa", b"a"]), ta.Side(None, [b"aa", b"a"]))
    found = aligner._align([0] * 10_000, [1] + [0] * 9_999 + [1])
    assert (found.n_groups, found.n_links, len(found.pairs)) == (1, 10_000 * 10_001, 2)


def test_empty_table_and_clashing_names(spark):
    assert ta.alignment_report(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = corpus(6, 30)
    wide = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(c) for c in ("uid", "pairs", "times", "n_a", "n_best", "pair", "best")])
    assert rows_of(ta.alignment_report(wide)) == brute(rows)


def test_parts_between_lone_spaces_are_encoded_once():
    """Texts of the same words in another order give the tokenizers nothing new."""
    made, asked = ta.Aligner(ta.byte_level(), ta.pieces(), ta.LONE_SPACE.split), []
    for side in (made.a, made.b):
        side.encode = lambda texts, of=side.encode: (asked.extend(texts), of(texts))[1]
    words = ["alpha", "beta's", "gamma\n\ndelta", "12,5", "東京"]
    made.texts([" ".join(words)])
    assert sorted(asked) == sorted(words * 2)
    asked.clear()
    found = made.texts([" ".join(words[::-1]), " ".join(words * 3)])
    assert not asked and [s.n_a for s in found] == [sum(len(p) for p, _ in groups_of(t)) for t in (" ".join(words[::-1]), " ".join(words * 3))]


def test_blanks_of_all_kinds_beside_lone_spaces(spark, monkeypatch):
    monkeypatch.setattr(ta, "PARTS", 30)
    rng = random.Random(9)
    parts = ["a", "Zq", "'s", "1", "-", "\u6771", "\u0301", "\u2581", "\x00", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u200b", "\u202f", "\u3000", "\ufeff", "\t", "\n", "\r", "\x0b", "\U0001f642"]
    rows = [(k, "".join(rng.choice([rng.choice(parts), " ", rng.choice("abc")]) for _ in range(rng.randint(1, 40)))) for k in range(400)]
    assert rows_of(ta.alignment_report(spark.createDataFrame(rows, SCHEMA).repartition(2))) == brute(rows)
