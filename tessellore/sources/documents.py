"""Documents as text: a registry of readers by extension, pages, and what needs page images.

Readers are plain functions of bytes that run in Arrow batches. Those for markdown, text,
tables and web pages are here; readers for other formats are given by the caller, as their
libraries are.
"""

from __future__ import annotations

import csv
import html
import io
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellore.functions import text
from tessellore.sources.library import FORMATS

Reader = Callable[[bytes], str]
#: A page reader gives (number, text, whether the page holds an image) for each page.
PageReader = Callable[[bytes], list[tuple[int, str, bool]]]


def _plain(content: bytes) -> str:
    return content.decode("utf-8-sig", "replace").replace("\r\n", "\n")


def _table(content: bytes) -> str:
    rows = [[c.strip().replace("|", "\\|").replace("\n", " ") for c in row] for row in csv.reader(io.StringIO(_plain(content))) if any(row)]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = [f"| {' | '.join(row + [''] * (width - len(row)))} |" for row in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def _web(content: bytes) -> str:
    bare = re.sub(r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ", _plain(content))
    marked = re.sub(r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1>", lambda m: f"\n\n{'#' * int(m[1])} {m[2]}\n\n", bare)
    marked = re.sub(r"(?i)<li\b[^>]*>", "\n- ", re.sub(r"(?i)</(p|div|section|article|ul|ol|table|tr)>|<br\s*/?>", "\n\n", marked))
    flat = html.unescape(re.sub(r"<[^>]*>", "", marked))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", flat)).strip()


READERS: dict[str, Reader] = {"md": _plain, "txt": _plain, "csv": _table, "html": _web, "htm": _web}


def extension(path):
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def gate(found: DataFrame, readers: dict[str, Reader] | None = None) -> DataFrame:
    """``path, format, readable`` of files (``path``) of a source format; others are dropped."""
    known = {**READERS, **(readers or {})}
    kind = extension(F.col("path"))
    return found.filter(kind.isin(*FORMATS, *known)).select("path", kind.alias("format"), kind.isin(*known).alias("readable"))


def extract_documents(found: DataFrame, readers: dict[str, Reader] | None = None) -> DataFrame:
    """``path, format, body, problem`` of files (``path, content``): cleaned markdown, or why there is none.

    A format without a reader, a reader that fails and an empty result are problems of their
    file and stop no other.
    """
    known = {**READERS, **(readers or {})}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bodies, problems = [], []
            for kind, content in zip(batch["format"], batch["content"], strict=True):
                body, problem = None, None
                if kind not in known:
                    problem = f"no reader for {kind}"
                else:
                    try:
                        body = known[kind](bytes(content) if content is not None else b"")
                        problem = None if body.strip() else "no text"
                    except Exception as e:  # a reader's own failure is the file's
                        problem = f"{type(e).__name__}: {e}"
                bodies.append(body if problem is None else None)
                problems.append(problem)
            yield batch[["path", "format"]].assign(body=bodies, problem=problems)

    kind = extension(F.col("path"))
    kept = found.filter(kind.isin(*FORMATS, *known)).select("path", kind.alias("format"), "content")
    out = kept.mapInPandas(run, "path string, format string, body string, problem string")
    return out.select("path", "format", text.normalize_markdown(F.col("body")).alias("body"), "problem")


def read_pages(found: DataFrame, reader: PageReader) -> DataFrame:
    """``path, page, text, has_image``: a row for each page of each file (``path, content``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = [(path, *page) for page in reader(bytes(content))]
                yield pd.DataFrame(rows, columns=["path", "page", "text", "has_image"])

    return found.select("path", "content").mapInPandas(run, "path string, page int, text string, has_image boolean")


def plan_pages(pages: DataFrame, most: int | None = None) -> DataFrame:
    """``path, pages``: the pages of each file that need vision, those of a file in one row."""
    rows = F.collect_list(F.struct("page", "text", "has_image"))
    return pages.groupBy("path").agg(text.page_plan(rows, most).alias("pages"))


def transcribe(plans: DataFrame, call: Callable[[str, list[int]], str], batch: int = 2, retries: int = 2) -> DataFrame:
    """``path, pages, markdown, problem`` of planned pages by a vision service, ``batch`` pages a call.

    A call whose answer lacks a page is tried again; after ``retries`` a batch is split into
    its pages, and a page that fails alone is its problem.
    """
    def check(markdown: str, pages: list[int]) -> str | None:
        for page in pages:
            m = re.search(rf"### Page {page}\s*\n(.*?)(?=### Page \d+\s*\n|\Z)", markdown, re.S)
            if m is None or len(m[1].strip()) < text.SECTION_CHARS:
                return f"no text for page {page}"
        return None

    def attempt(path: str, pages: list[int]) -> list[tuple[list[int], str | None, str | None]]:
        problem = None
        for _ in range(retries + 1):
            try:
                got = call(path, pages)
                problem = check(got, pages)
                if problem is None:
                    return [(pages, got, None)]
            except Exception as e:  # the service's failure
                problem = f"{type(e).__name__}: {e}"
        return [(pages, None, problem)] if len(pages) == 1 else [x for p in pages for x in attempt(path, [p])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(path, *x) for path, pages in zip(rows["path"], rows["pages"], strict=True) for at in range(0, len(pages), batch) for x in attempt(path, [int(p) for p in pages[at : at + batch]])]
            yield pd.DataFrame(out, columns=["path", "pages", "markdown", "problem"])

    return plans.select("path", "pages").mapInPandas(run, "path string, pages array<int>, markdown string, problem string")
