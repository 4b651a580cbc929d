"""Reads a folder of markdown pages as concepts and edges, and writes pages, packs and logs."""

from __future__ import annotations

import functools
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellore import schema
from tessellore.functions import text, udf

#: Extensions of the source formats, and the caps of an imported archive.
FORMATS = ("pdf", "doc", "docx", "odt", "ppt", "pptx", "rtf", "epub", "xlsx", "ods", "odp", "csv", "md", "txt")
SKIPPED = (".git", "node_modules", "__pycache__")
ZIP_ENTRIES, ZIP_ENTRY_BYTES, ZIP_BYTES = 10_000, 256 << 20, 512 << 20


def files(spark: SparkSession, root: str) -> DataFrame:
    """``path, size, mtime_ms, content`` of everything below a root; paths are relative."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.lit(root.rstrip("/").split("://")[-1].lstrip("/"))
    at = F.instr("path", root.rstrip("/").split("://")[-1].lstrip("/"))
    path = F.substring("path", at + F.length(base) + 1, F.lit(1 << 20))
    return found.select(path.alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1000).cast("long").alias("mtime_ms"), "content")


def stamps(found: DataFrame) -> DataFrame:
    return found.select("path", "size", "mtime_ms", F.sha2("content", 256).alias("sha256"))


def expand_sources(listing: DataFrame) -> DataFrame:
    """Source files (``path, pos``): known formats outside skipped folders; of equal names the first given stays."""
    from pyspark.sql import Window

    name = F.lower(F.element_at(F.split("path", "/"), -1))
    skipped = F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED)))
    kept = listing.filter(F.regexp_extract(name, r"\.([a-z0-9]+)$", 1).isin(*FORMATS) & ~skipped)
    return kept.withColumn("n", F.row_number().over(Window.partitionBy(name).orderBy("pos", "path"))).filter("n = 1").drop("n")


def _text(front: Column, name: str) -> Column:
    got = F.trim(F.get_json_object(front, f"$.{name}"))
    return F.when(got != "", got)


def concepts(pages: DataFrame) -> DataFrame:
    """Typed concepts of markdown files (``path, content``); what has no type is dropped, extract bodies are blanked."""
    parsed = pages.filter(schema.indexable(F.col("path"))).select("path", udf.front_matter_column(F.decode("content", "utf-8")).alias("d")).select("path", F.col("d.frontmatter").alias("f"), F.col("d.body").alias("body"))
    f = F.col("f")
    listed = lambda n: F.coalesce(F.from_json(F.get_json_object(f, f"$.{n}"), "array<string>"), F.array().cast("array<string>"))
    by = F.concat_ws(" ", F.get_json_object(f, "$.verified.by"), F.get_json_object(f, "$.verified[*].by"))
    typed = parsed.withColumn("type", _text(f, "type")).filter("type is not null")
    return typed.select(
        text.concept_id(F.col("path")).alias("id"),
        "path",
        "type",
        F.coalesce(_text(f, "title"), text.concept_id(F.col("path"))).alias("title"),
        text.normalize_published(_text(f, "published")).alias("published"),
        listed("tags").alias("tags"),
        schema.normal_status(F.coalesce(_text(f, "status"), F.lit("stable"))).alias("status"),
        by.rlike(r"(^|[\"\[ ])human:").alias("verified_human"),
        text.concept_id(_text(f, "paper")).alias("paper"),
        text.normalize_doi(_text(f, "doi")).alias("doi"),
        text.extract_links(F.col("body"), F.col("path")).alias("outgoing"),
        _text(f, "confidence").alias("confidence"),
        _text(f, "stance").alias("stance"),
        listed("aliases").alias("aliases"),
        F.when(F.size(listed("authors")) > 0, listed("authors")).when(_text(f, "authors").isNotNull() & ~_text(f, "authors").startswith("["), F.array(_text(f, "authors"))).otherwise(F.array().cast("array<string>")).alias("authors"),
        _text(f, "venue").alias("venue"),
        F.when(F.col("type") == "TextExtract", F.lit("")).otherwise(F.col("body")).alias("body"),
    )


def html_text(pages: DataFrame) -> DataFrame:
    """``page_id, text`` of raw web pages."""
    return pages.select("page_id", F.trim(F.regexp_replace(text.strip_tags(F.col("html")), r"\s+", " ")).alias("text"))


#: Schemes of stores that executors can write to by themselves.
DIRECT = ("file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss")


def write_pages(pages: DataFrame, root: str) -> int:
    """Writes ``path, frontmatter (JSON), body`` as page files below a root, from the executors; says how many.

    The root is qualified by Hadoop, so a path without a scheme is one of the cluster's file
    system. Each page is written beside its place and moved there. A store that only Spark
    reaches is an error that names it: save a table there (``store.Store``).
    """
    import json

    spark = pages.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    full = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    scheme = full.split(":", 1)[0]
    if scheme not in DIRECT:
        raise ValueError(f"executors can't write files to {scheme}:")
    full = f"file://{full.split(':', 1)[1]}" if scheme == "file" and "://" not in full else full

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(full)
        for batch in rows:
            for path, front, body in zip(batch["path"], batch["frontmatter"], batch["body"], strict=True):
                if path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"the page leaves its folder: {path}")
                target = f"{base}/{path}"
                store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(f"{target}.part") as out:
                    out.write(udf.serialize(json.loads(front), body or "").encode("utf-8"))
                store.move(f"{target}.part", target)
            yield pd.DataFrame({"n": [len(batch)]})

    return pages.select("path", "frontmatter", "body").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def pack(found: DataFrame, *, notes: bool = True, extracts: bool = True) -> bytes:
    """An archive of the pages (``path, content``) that an export holds; it is one file within the archive's caps."""
    from tessellore.operators.merge import pack_paths

    kept = pack_paths(found, notes=notes, extracts=extracts)
    size = kept.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("bytes")).first()
    if size.n > ZIP_ENTRIES or (size.bytes or 0) > ZIP_BYTES:
        raise ValueError("the export is too large for one archive")
    return zip_bytes([(r.path, bytes(r.content)) for r in kept.select("path", "content").collect()])  # within the caps above


def zip_bytes(entries: list[tuple[str, bytes]]) -> bytes:
    """An archive of stored entries."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for path, content in sorted(entries):
            z.writestr(zipfile.ZipInfo(path), content)
    return out.getvalue()


def unzip(archive: bytes) -> list[tuple[str, bytes]]:
    """The entries of an archive within the caps; paths that leave it and encrypted entries are errors."""
    with zipfile.ZipFile(io.BytesIO(archive)) as z:
        infos = [i for i in z.infolist() if not i.is_dir()]
        if len(infos) > ZIP_ENTRIES or any(i.file_size > ZIP_ENTRY_BYTES for i in infos) or sum(i.file_size for i in infos) > ZIP_BYTES:
            raise ValueError("the archive is too large")
        if any(i.flag_bits & 1 for i in infos):
            raise ValueError("the archive is encrypted")
        if any(i.filename.startswith("/") or ".." in i.filename.split("/") for i in infos):
            raise ValueError("the archive leaves its folder")
        return [(i.filename, z.read(i)) for i in infos]


def unzip_column(frame: DataFrame, content: str = "content") -> DataFrame:
    """One row for each entry of archives in a binary column."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for archive in batch[content]:
                yield pd.DataFrame(unzip(bytes(archive)), columns=["path", "content"])

    return frame.select(content).mapInPandas(run, "path string, content binary")


def synthetic(spark: SparkSession, papers: int = 1000, topics: int = 20, claims: int = 1, years: tuple[int, int] = (2000, 2024), saved: int = 0) -> DataFrame:
    """A made library for scale tests: ``id, type, title, published, outgoing``; ``saved`` notes, questions and surveys each."""
    span = years[1] - years[0] + 1
    year = (F.lit(years[0]) + F.col("id") % span).cast("string")
    key = F.concat(F.lit("papers/"), year, F.lit("-paper-"), F.lpad(F.col("id").cast("string"), 4, "0"))
    base = spark.range(papers).withColumn("key", key)
    claim = lambda k: F.concat(F.lit("claims/"), F.element_at(F.split("key", "/"), -1), F.lit("--"), k.cast("string"))
    numbers = F.sequence(F.lit(1), F.lit(claims)) if claims else F.array().cast("array<int>")
    links = F.concat(F.array(F.concat(F.lit("topics/topic-"), (F.col("id") % topics).cast("string"))), F.transform(numbers, claim))
    paper = base.select(F.col("key").alias("id"), F.lit("Paper").alias("type"), F.concat(F.lit("Paper "), F.col("id").cast("string")).alias("title"), F.concat(year, F.lit("-01-01")).alias("published"), links.alias("outgoing"))
    claim_rows = base.select("key", F.explode(F.transform(numbers, claim)).alias("id")).select("id", F.lit("Claim").alias("type"), F.col("id").alias("title"), F.lit(None).cast("string").alias("published"), F.array("key").alias("outgoing"))
    topic = spark.range(topics).select(F.concat(F.lit("topics/topic-"), F.col("id").cast("string")).alias("id"), F.lit("Topic").alias("type"), F.concat(F.lit("Topic "), F.col("id").cast("string")).alias("title"), F.lit(None).cast("string").alias("published"), F.array().cast("array<string>").alias("outgoing"))
    number = F.col("id").cast("string")
    pages = [spark.range(saved).select(F.concat(F.lit(f"{schema.DIRECTORIES[k]}/{k.lower()}-"), number).alias("id"), F.lit(k).alias("type"), F.concat(F.lit(f"{k} "), number).alias("title"), F.lit(None).cast("string").alias("published"), F.array(F.lit("topics/topic-0")).alias("outgoing")) for k in ("Note", "Question", "Survey")]
    extract = base.select(F.regexp_replace("key", "^papers", "extracts").alias("id"), F.lit("TextExtract").alias("type"), F.col("key").alias("title"), F.lit(None).cast("string").alias("published"), F.array("key").alias("outgoing"))
    return functools.reduce(DataFrame.unionByName, [paper, claim_rows, topic, extract, *(pages if saved else [])])


def index_page(concepts_frame: DataFrame) -> DataFrame:
    """The root page's lines: a count for each type, then the topics with most papers."""
    counts = concepts_frame.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).alias("part"), F.col("type").alias("name"), "n")
    links = concepts_frame.filter("type = 'Paper'").select(F.explode("outgoing").alias("id"))
    topics = concepts_frame.filter("type = 'Topic'").select("id", "title").join(links, "id").groupBy("id", "title").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "id").limit(12)
    return counts.unionByName(topics.select(F.lit(1).alias("part"), F.col("title").alias("name"), "n"))
