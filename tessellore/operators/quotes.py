"""All quotes in all texts in one pass: an automaton over many patterns.

Quotes are dealt into parts of a bounded number of characters. The automaton of a part goes
over each text once, whatever the number and the lengths of its quotes, so a library reads
its texts as often as its quotes fill parts, and no quote meets a text by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellore.storage import cut

#: Characters of the quotes of one part, and what a quote counts besides: bounds an automaton to some 100 MB.
PART_CHARS, QUOTE_CHARS = 1_000_000, 20
_BUILT: dict[int, object] = {}


def _automaton(of: int, quotes: list[str]):
    """The automaton of a part, made once by each worker and let go when the next one is asked for."""
    import ahocorasick

    if of not in _BUILT:
        _BUILT.clear()
        made = ahocorasick.Automaton()
        for i, q in enumerate(quotes):
            made.add_word(q, i)
        made.make_automaton()
        _BUILT[of] = made
    return _BUILT[of]


def _found(texts: DataFrame, quotes: list[str]) -> DataFrame:
    """``doc, q`` of the quotes of one part in ``doc, e``."""
    if not quotes:  # an automaton of nothing can't be asked
        return texts.select("doc", F.col("e").alias("q")).limit(0)
    shared = texts.sparkSession.sparkContext.broadcast(quotes)
    of = shared._jbroadcast.id()
    name = texts.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _automaton(of, shared.value)
        for batch in batches:
            rows, at = [], []
            for i, e in enumerate(batch.column(1)):
                hits = {k for _, k in made.iter(e.as_py())} if e.is_valid else ()
                at += [i] * len(hits)
                rows += [shared.value[k] for k in hits]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(rows, pa.string())], names=["doc", "q"])

    return texts.select("doc", "e").mapInArrow(run, f"doc {name}, q string")


def held_quotes(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """``item, doc`` of the folded quotes (``item, q``) that folded texts (``doc, e``) hold; empty ones and null texts hold nothing.

    Each distinct quote is looked for once; items that share it meet it by an equi-join.
    """
    distinct = cut(quotes.filter("q <> ''").select("q").distinct())
    total = distinct.agg(F.sum(F.length("q") + QUOTE_CHARS)).first()[0] or 0
    parts = total // PART_CHARS + 1
    texts = cut(texts) if parts > 1 else texts
    out = None
    for k in range(parts):
        some = distinct.filter(F.pmod(F.xxhash64("q"), F.lit(parts)) == k)
        one = _found(texts, [r.q for r in some.collect()])  # a part's own bound
        out = one if out is None else out.unionByName(one)
    return out.join(quotes.select("item", "q"), "q").select("item", "doc")
