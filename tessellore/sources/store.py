"""Tables of a library that outlive a session: postings, vectors, states, caches, a log.

All tables share one sequence of numbered manifests; a manifest names the folders that hold
each table. A writer writes its folders first, then puts the next number in place, which
only one writer can do. So a reader, who takes the highest number, sees all of a commit or
nothing of it, and what a dead writer left is named by no manifest. A writer that comes
second commits on top of the other one if their tables differ; otherwise its change is made
anew or refused. Everything goes through Hadoop's file system; the store below must have a
rename that fails if the target exists (a local folder takes links instead).
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Callable, Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellore.functions import seams
from tessellore.operators import incremental, search
from tessellore.sources import segments

POSTINGS, VECTORS, STATE, CACHE = "postings", "vectors", "state", "outputs"
MANIFESTS, LINES = "manifests", "log"
#: Manifests that stay, so that a reader who has just listed them still finds the one it chose.
KEPT_MANIFESTS = 8
#: The folders that a library begins with.
ROOT_PAGES = {"index.md": "---\ntype: Index\ntitle: Library\n---\n\n# Library\n", "log.md": "# Log\n", "AGENTS.md": "# How to read\n\nStart at index.md. Cite pages by their ids.\n"}


class Conflict(RuntimeError):
    """Another writer has changed a table that this one has read."""


class Store:
    """Tables below a root folder, changed by commits."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)
        self.memo: dict[str, tuple[str, DataFrame]] = {}
        self.open: dict | None = None  # what a transaction has begun with and changed

    # files --------------------------------------------------------------------------------
    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read_text(self, name: str) -> str | None:
        at = self.path(name)
        if not self.fs.exists(at):
            return None
        stream = self.fs.open(at)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _part(self, name: str, content: str):
        part = self.path(f"{name}.{uuid.uuid4().hex}.part")
        stream = self.fs.create(part, True)
        try:
            stream.write(bytearray(content.encode("utf-8")))
        finally:
            stream.close()
        return part

    def _local(self, path):
        """The local file of a path, or None if it is in another store."""
        whole = self.fs.makeQualified(path).toUri()
        return self.jvm.java.nio.file.Paths.get(whole.getPath(), self.spark.sparkContext._gateway.new_array(self.jvm.java.lang.String, 0)) if whole.getScheme() == "file" else None

    def _rename(self, part, at, replace: bool) -> bool:
        """Moves a file in one step; False if the target is there and isn't to be replaced."""
        try:
            local = self._local(at)
            if local is not None and not replace:
                self.jvm.java.nio.file.Files.createLink(local, self._local(part))
                self.fs.delete(part, False)
            else:
                option = self.jvm.org.apache.hadoop.fs.Options.Rename
                options = self.spark.sparkContext._gateway.new_array(option, 1)
                options[0] = option.OVERWRITE if replace else option.NONE
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(part, at, options)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                self.fs.delete(part, False)
                return False
            raise
        return True

    def write_text(self, name: str, content: str) -> None:
        """Writes beside the place and renames over it: readers see the old text or the new one."""
        self._rename(self._part(name, content), self.path(name), True)

    def create_text(self, name: str, content: str) -> bool:
        """Writes only if there is nothing yet; False if there is."""
        return self._rename(self._part(name, content), self.path(name), False)

    # manifests ------------------------------------------------------------------------------
    def _numbers(self, folder: str) -> list[int]:
        at = self.path(folder)
        if not self.fs.exists(at):
            return []
        names = [x.getPath().getName() for x in self.fs.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self) -> tuple[int, dict]:
        """The newest manifest's number and tables; 0 and none before the first commit."""
        numbers = self._numbers(MANIFESTS)
        if not numbers:
            return 0, {}
        return numbers[-1], json.loads(self.read_text(f"{MANIFESTS}/{numbers[-1]:012d}.json"))

    def entry(self, table: str):
        """What the manifest, or the open transaction, says of a table."""
        if self.open is not None:
            return self.open["new"].get(table, self.open["tables"].get(table))
        return self.manifest()[1].get(table)

    def commit(self, changes: dict, seen: dict) -> int:
        """Puts the next manifest in place with ``changes`` (None removes a table) and says its number.

        ``seen`` has what the writer took for the present state of these tables; if another
        writer's commit has changed one of them, Conflict is raised and nothing has changed.
        """
        while True:
            number, tables = self.manifest()
            for table, entry in seen.items():
                if tables.get(table) != entry:
                    raise Conflict(f"table {table} was changed by another writer")
            after = {t: e for t, e in (tables | changes).items() if e is not None}
            if self.create_text(f"{MANIFESTS}/{number + 1:012d}.json", json.dumps(after, sort_keys=True)):
                for old in self._numbers(MANIFESTS)[:-KEPT_MANIFESTS]:
                    self.fs.delete(self.path(f"{MANIFESTS}/{old:012d}.json"), False)
                return number + 1

    def put(self, table: str, entry, seen) -> None:
        """One table's new entry: staged in an open transaction, else committed."""
        if self.open is not None:
            self.open["new"][table] = entry
        else:
            self.commit({table: entry}, {table: seen})

    @contextlib.contextmanager
    def transaction(self, *tables: str) -> Iterator[Store]:
        """Several tables change together by one manifest; on an error, or a conflict, none does."""
        number, held = self.manifest()
        self.open = {"tables": held, "new": {}}
        try:
            yield self
            changes = self.open["new"]
        finally:
            self.open = None
        if changes:
            self.commit(changes, {t: held.get(t) for t in {*changes, *tables}})

    def version(self, table: str) -> str | None:
        entry = self.entry(table)
        return None if entry is None else json.dumps(entry, sort_keys=True)

    def exists(self, table: str) -> bool:
        return self.entry(table) is not None

    # whole tables ---------------------------------------------------------------------------
    def save(self, table: str, frame: DataFrame, sort: str | None = None) -> DataFrame:
        """A new version of a table; with ``sort`` its files hold ranges of that column, so filters on it skip files."""
        version, seen = uuid.uuid4().hex, self.entry(table)
        out = frame if sort is None else frame.repartitionByRange(F.col(sort)).sortWithinPartitions(sort)
        out.write.parquet(f"{self.root}/{table}/{version}")
        self.put(table, {"version": version}, seen)
        return self.load(table)

    def load(self, table: str) -> DataFrame:
        entry = self.entry(table)
        if entry is None:
            raise FileNotFoundError(f"{self.root}/{table}")
        if "segments" in entry:
            return segments.live(self.spark, f"{self.root}/{table}", entry["segments"])
        return self.spark.read.parquet(f"{self.root}/{table}/{entry['version']}")

    def clean(self, table: str) -> int:
        """Removes the folders that none of the kept manifests names, of dead writers too; says how many.

        To be called while no writer is at work, as a folder is written before it is named.
        """
        held = set()
        for number in self._numbers(MANIFESTS)[-2:]:
            entry = json.loads(self.read_text(f"{MANIFESTS}/{number:012d}.json")).get(table) or {}
            held |= {entry.get("version")} | {s["name"] for s in entry.get("segments", [])}
        at = self.path(table)
        gone = [x.getPath() for x in self.fs.listStatus(at) if x.getPath().getName() not in held] if self.fs.exists(at) else []
        for path in gone:
            self.fs.delete(path, True)
        return len(gone)

    # index --------------------------------------------------------------------------------
    def refresh(self, table: str, docs: DataFrame, build: Callable[[DataFrame], DataFrame], sort: str | None = None, label: str = "") -> DataFrame:
        """A log-structured table of rows made from documents (``id, title, body``), brought up to date.

        ``build`` gives rows with ``id`` of the documents that are new or changed; nothing
        else is made anew or written, but for small segments that are merged. Rows of another
        ``label`` (a model) don't count. If another writer was first, the change is made anew.
        """
        root = f"{self.root}/{table}"
        while True:
            seen = self.entry(table)
            held = seen["segments"] if seen is not None and seen.get("label", "") == label else []
            after = segments.extend(self.spark, root, held, docs, build, sort)
            if seen is not None and after == seen.get("segments") and label == seen.get("label", ""):
                return self.load(table)
            try:
                self.put(table, {"segments": after, "label": label}, seen)
                return self.load(table)
            except Conflict:
                continue

    def build_index(self, docs: DataFrame) -> DataFrame:
        """Postings of documents (``id, title, body``), whatever was there before."""
        seen = self.entry(POSTINGS)
        self.put(POSTINGS, {"segments": segments.extend(self.spark, f"{self.root}/{POSTINGS}", [], docs, search.build_postings, "token"), "label": ""}, seen)
        return self.load(POSTINGS)

    def refresh_index(self, docs: DataFrame) -> DataFrame:
        """The postings brought up to date: only changed documents are tokenised, and nothing is written if none changed."""
        return self.refresh(POSTINGS, docs, search.build_postings, "token")

    def refresh_vectors(self, docs: DataFrame, cut: Callable[[DataFrame], DataFrame], client, model: str) -> DataFrame:
        """``chunk_id, source_id, text, embedding, model`` of documents, with stamps of their own.

        ``cut`` makes chunks (``chunk_id, source_id, text``) of documents; only those of new
        and changed documents go to the client. Another model begins anew.
        """
        made = self.refresh(VECTORS, docs, lambda delta: seams.embed(cut(delta), client, model).withColumn("id", F.col("source_id")), label=model)
        return made.select("chunk_id", "source_id", "text", "embedding", "model")

    # states and caches ----------------------------------------------------------------------
    def upsert(self, table: str, rows: DataFrame, keys: list[str]) -> DataFrame:
        """Rows by key: new ones replace old ones; made anew if another writer was first."""
        while True:
            whole = rows
            if self.exists(table):
                whole = rows.unionByName(self.load(table).join(rows.select(*keys).distinct(), keys, "left_anti"))
            try:
                return self.save(table, whole)
            except Conflict:
                continue

    def cached_outputs(self, wanted: DataFrame, version: int) -> DataFrame:
        """``key, output`` of compile outputs that are cached for texts (``path, text, stages``) under a schema version."""
        keyed = wanted.select("path", output_key(version).alias("key"))
        if not self.exists(CACHE):
            return keyed.select("path", "key", F.lit(None).cast("string").alias("output"))
        return keyed.join(self.load(CACHE).select("key", "output"), "key", "left").select("path", "key", "output")

    def memoized(self, name: str, stamps: DataFrame, build) -> DataFrame:
        """``build()`` once for each state of the stamps (``path, sha256``); a changed state builds it anew."""
        got = stamps.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("path", "sha256")).alias("x"), F.sum(F.xxhash64("path", "sha256").cast("decimal(20,0)")).alias("s")).first()
        state = repr(tuple(got))
        if name not in self.memo or self.memo[name][0] != state:
            self.memo[name] = (state, self.save(f"memo-{name}", build()))
        return self.memo[name][1]

    # root pages -----------------------------------------------------------------------------
    def bootstrap(self) -> list[str]:
        """Creates the root pages that lack and says which."""
        made = [name for name in ROOT_PAGES if self.read_text(name) is None]
        for name in made:
            self.write_text(name, ROOT_PAGES[name])
        return made

    def log(self, line: str, at: str) -> None:
        """Adds a line to the log: a file of its own under the next free number, so writers lose none of each other's lines."""
        flat = " ".join(line.split())
        while True:
            number = (self._numbers(LINES) or [0])[-1] + 1
            if self.create_text(f"{LINES}/{number:012d}.json", json.dumps({"at": at, "line": flat})):
                return

    def log_lines(self) -> DataFrame:
        """``n, at, line`` of the log."""
        shape = "at string, line string"
        if not self._numbers(LINES):
            return self.spark.createDataFrame([], f"n long, {shape}")
        rows = self.spark.read.schema(shape).json(f"{self.root}/{LINES}/*.json")
        return rows.select(F.regexp_extract(F.col("_metadata.file_name"), "([0-9]+)", 1).cast("long").alias("n"), "at", "line")

    def log_page(self) -> str:
        """The log as a page, which a library's own life bounds."""
        lines = self.log_lines().orderBy("n").collect()
        return "\n".join([(self.read_text("log.md") or ROOT_PAGES["log.md"]).rstrip(), *[f"- {r.at} {r.line}" for r in lines]]) + "\n"


def output_key(version: int):
    """The cache key of ``text, stages``: schema version, stages and a hash of the text."""
    return F.sha2(F.concat_ws("\x1f", F.lit(str(version)), F.array_join(F.array_sort("stages"), ","), F.sha2("text", 256)), 256)
