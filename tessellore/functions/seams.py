"""Where models and services plug in: plain callables over batches of rows.

Nothing here opens a connection by itself. A callable gets a batch and returns one result
for each item; it runs in the executors, batch by batch, and can fail and be retried
without any state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellore.functions import text

#: Texts of an embedding call, and rows of a chat batch.
EMBED_BATCH, CHAT_BATCH = 32, 8

Embed = Callable[[Sequence[str]], Sequence[Sequence[float]]]
Complete = Callable[[str], str]


def embed(chunks: DataFrame, client: Embed, model: str) -> DataFrame:
    """Chunks (``chunk_id, source_id, text``) with ``embedding`` and ``model``; a batch whose sizes differ is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors: list = []
            for at in range(0, len(batch), EMBED_BATCH):
                part = batch["text"].iloc[at : at + EMBED_BATCH].tolist()
                got = list(client(part))
                if len(got) != len(part) or len({len(v) for v in got}) > 1:
                    raise ValueError("the embedding service returned another number or size of vectors")
                vectors += [[float(x) for x in v] for v in got]
            yield batch.assign(embedding=vectors, model=model)

    return chunks.select("chunk_id", "source_id", "text").mapInPandas(run, "chunk_id string, source_id string, text string, embedding array<float>, model string")


def complete(prompts: DataFrame, client: Complete) -> DataFrame:
    """``id, answer`` of ``id, prompt``; an empty answer is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = [client(p) for p in batch["prompt"]]
            if not all(answers):
                raise ValueError("the model returned an empty answer")
            yield pd.DataFrame({"id": batch["id"], "answer": answers})

    return prompts.select("id", "prompt").mapInPandas(run, "id string, answer string")


def parse_answers(answers: DataFrame, schema: str, required: Sequence[str]) -> DataFrame:
    """``id, value, problem`` of JSON answers: the object in a fence or between the outer braces, read by schema."""
    value = F.from_json(text.json_object(F.col("answer")), schema)
    missing = F.filter(F.array(*[F.when(F.col(f"value.{r}").isNull(), F.lit(r)) for r in required]), lambda x: x.isNotNull())
    out = answers.select("id", value.alias("value"))
    return out.withColumn("problem", F.when(F.col("value").isNull(), "no JSON object").when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))))


def look_up(papers: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The best record of a local catalogue (``doi, title, published``) for each paper, with its score.

    Papers meet records by DOI or by a word of the title, never each with each.
    """
    key = lambda f: F.array_union(F.array(F.concat(F.lit("d:"), F.coalesce(text.normalize_doi(F.col("doi")), F.lit("-")))), F.transform(text.align_tokens(F.coalesce("title", F.lit(""))), lambda t: F.concat(F.lit("t:"), t)))
    p = papers.select("id", F.col("doi").alias("p_doi"), F.col("title").alias("p_title"), F.col("published").alias("p_published"), F.explode(key(papers)).alias("key"))
    c = catalogue.select(F.monotonically_increasing_id().alias("n"), "doi", "title", "published").withColumn("key", F.explode(key(catalogue)))
    met = p.filter("key <> 'd:-'").join(c, "key").drop("key").distinct()
    overlap = text.jaccard(text.align_tokens(F.col("p_title")), text.align_tokens(F.col("title")))
    same_doi = F.coalesce(text.normalize_doi(F.col("p_doi")) == text.normalize_doi(F.col("doi")), F.lit(False))
    same_year = F.coalesce(text.published_year(F.col("p_published")) == text.published_year(F.col("published")), F.lit(False))
    scored = met.withColumn("score", text.biblio_score(same_doi, overlap, same_year))
    return scored.groupBy("id").agg(F.max_by(F.struct("doi", "title", "published", "score"), F.struct("score", -F.col("n"))).alias("hit")).select("id", "hit.*")


def apply_biblio(papers: DataFrame, hits: DataFrame, least: float = 0.88) -> DataFrame:
    """Papers with what they lack filled from a good enough hit; what they have stays."""
    h = hits.filter(F.col("score") >= least).select("id", F.col("doi").alias("h_doi"), F.col("published").alias("h_published"))
    met = papers.join(h, "id", "left")
    return met.withColumn("doi", F.coalesce("doi", "h_doi")).withColumn("published", F.coalesce("published", "h_published")).drop("h_doi", "h_published")
