"""Token counts under a unigram vocabulary by dynamic programming over a shared trie.

The distinct pre-tokens of a batch go into one trie whose edges carry strings, so that it
has at most two nodes a pre-token, however long that is. A walk over it carries, for each
prefix, the best score of a segmentation that ends there and how many pieces it has; it is
computed once for all pre-tokens that share the prefix, and the count is stored where a
pre-token ends. The walk holds the scores of those places only where a piece is still open,
so a step costs at most the longest piece. A document's count is the sum over its
pre-tokens; no text is shuffled.

The pieces are those of a public vocabulary file; a piece's score is the logarithm of its
share under Zipf's law of the file's rank order (nothing is trained here). A character
that no piece covers counts as its UTF-8 bytes, each at the score of the last rank less a
penalty. Among equal scores the segmentation with the longest last piece wins.

Edge cases: a null or empty text has no tokens; long texts and long pre-tokens are counted
whole; repeated rows each get their own count; an empty table gives an empty result; only
the named id and text columns take part, so others may have any name.
"""

from __future__ import annotations

import functools
import math
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
BYTE_PENALTY = 10.0
#: Pre-tokens whose counts a task remembers from batch to batch.
REMEMBERED = 1_000_000
#: Longer pre-tokens are not remembered from batch to batch.
REMEMBERED_CHARS = 64
#: Distinct pre-tokens that go into one trie.
TRIE_WORDS = 20_000


@functools.lru_cache(maxsize=2)
def pieces(folder: str | None, vocabulary: str = VOCABULARY) -> tuple[dict[str, float | None], float]:
    """The score of each piece, None for what only begins one, and the score of a byte."""
    import public_tokenizers
    import sentencepiece

    place = public_tokenizers.path(vocabulary) if folder is None else os.path.join(folder, vocabulary)
    model = sentencepiece.SentencePieceProcessor(model_file=place)
    n = model.get_piece_size()
    norm = math.log(sum(1 / (r + 2.7) for r in range(n)))
    score = {model.id_to_piece(i): -math.log(i + 2.7) - norm for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    begins: dict[str, float | None] = {p[:k]: None for p in score for k in range(1, len(p))}
    return begins | score, -math.log(n + 2.7) - norm - BYTE_PENALTY


class Trie:
    """Pre-tokens by shared prefixes; a node is [string of its edge, nodes below by first character, pre-token that ends here]."""

    def __init__(self) -> None:
        self.root: list = ["", {}, None]

    def insert(self, word: str) -> None:
        node, at = self.root, 0
        while at < len(word):
            below = node[1].get(word[at])
            if below is None:
                node[1][word[at]] = [word[at:], {}, word]
                return
            edge = below[0]
            if not word.startswith(edge, at):
                # the edge parts where the strings do
                same = len(os.path.commonprefix((edge, word[at : at + len(edge)])))
                upper = [edge[:same], {edge[same]: below}, None]
                below[0] = edge[same:]
                node[1][word[at]] = below = upper
                edge = upper[0]
            node, at = below, at + len(edge)
        node[2] = word

    def count(self, table: dict[str, float | None], byte: float) -> dict[str, int]:
        """Tokens of each pre-token.

        The walk's state after a prefix is one entry (string since then, score, tokens) for
        each place where a piece that is still open began, the last place first.
        """
        out: dict[str, int] = {}
        none, get = 1.0, table.get  # scores are negative
        stack: list[tuple[list, list[tuple[str, float, int]]]] = [(self.root, [("", 0.0, 0)])]
        while stack:
            (edge, below, word), state = stack.pop()
            for c in edge:
                size = 1 if c < "\x80" else len(c.encode("utf-8", "surrogatepass"))
                top, count = state[0][1] + size * byte, state[0][2] + size
                still = []
                for since, score, tokens in state:
                    since += c
                    s = get(since, none)
                    if s is None:
                        still.append((since, score, tokens))
                    elif s < 0:
                        still.append((since, score, tokens))
                        if score + s >= top:
                            top, count = score + s, tokens + 1
                state = [("", top, count), *still]
            if word is not None:
                out[word] = state[0][2]
            stack += [(node, state) for node in below.values()]
        return out


def pretokens(text: str) -> list[str]:
    """Blank-separated words, each with the mark of a word's begin."""
    return [MARK + w for w in text.split()]


COUNTS = "doc_id bigint, n_pretokens bigint, n_distinct bigint, n_tokens bigint"


def count_tokens(docs: DataFrame, folder: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """For each document (``doc_id``, ``text``) its pre-tokens, distinct pre-tokens and tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, byte = pieces(folder, vocabulary)
        known: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                words = [pretokens(t.as_py() or "") for t in part.column(1)]
                if len(known) > REMEMBERED:
                    known.clear()
                fresh = [w for w in {w for x in words for w in x} if w not in known]
                for k in range(0, len(fresh), TRIE_WORDS):
                    trie = Trie()
                    for w in fresh[k : k + TRIE_WORDS]:
                        trie.insert(w)
                    known.update(trie.count(table, byte))
                columns = ([len(x) for x in words], [len(set(x)) for x in words], [sum(map(known.__getitem__, x)) for x in words])
                for w in fresh:
                    if len(w) > REMEMBERED_CHARS:
                        del known[w]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "n_pretokens", "n_distinct", "n_tokens"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(tidy(run), COUNTS)
