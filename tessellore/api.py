"""One object with the questions a library answers; every answer is a DataFrame.

A library is its concepts (``schema.CONCEPTS``) and, optionally, the texts that the index
holds beyond them and the vectors of a model. Nothing is collected but what an answer's
own caps bound.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessellore import schema
from tessellore.functions import text
from tessellore.operators import compile as compiling
from tessellore.operators import align, context, coverage, graph, incremental, integrity, links, merge, merging, pages, resolve, search, survey
from tessellore.sources import documents, store
from tessellore.sources import library as source


class Library:
    def __init__(self, concepts: DataFrame, texts: DataFrame | None = None, chunks: DataFrame | None = None, model: str | None = None) -> None:
        """``texts`` has ``id, title, body`` of indexed pages whose bodies the concepts leave out; ``chunks`` has ``source_id, embedding, model``."""
        self.concepts, self._texts, self.chunks, self.model = concepts, texts, chunks, model
        self.store: store.Store | None = None
        self._held: list[DataFrame] = []

    def __enter__(self) -> Library:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """Lets go of what this object cached."""
        for frame in self._held:
            frame.unpersist()
        self._held.clear()
        self.__dict__.pop("postings", None)

    @classmethod
    def read(cls, spark: SparkSession, root: str) -> Library:
        """The library in a folder of markdown pages."""
        pages = source.files(spark, root)
        return cls(source.concepts(pages))

    def with_index(self, root: str) -> Library:
        """The library with an index kept below a root: made once, refreshed by what changed."""
        self.store = store.Store(self.concepts.sparkSession, root)
        self.__dict__.pop("postings", None)
        return self

    @cached_property
    def edges(self) -> DataFrame:
        return graph.edge_list(self.concepts).select("src", "dst")

    @cached_property
    def adjacent(self) -> DataFrame:
        """The links from both ends, written once for all questions about neighbourhoods."""
        return graph.adjacency(self.edges)

    @cached_property
    def texts(self) -> DataFrame:
        own = self.concepts.filter(F.coalesce("body", F.lit("")) != "").select("id", "title", "body")
        return own if self._texts is None else own.unionByName(self._texts.select("id", "title", "body"))

    @cached_property
    def postings(self) -> DataFrame:
        if self.store is not None:
            return self.store.refresh_index(self.texts)
        made = search.build_postings(self.texts).persist()
        self._held.append(made)
        return made

    @cached_property
    def n_docs(self) -> int:
        return self.texts.count()

    @property
    def papers(self) -> DataFrame:
        return self.concepts.filter(F.col("type") == "Paper")

    # retrieval ------------------------------------------------------------------------
    def ranked(self, query: str, vector: Sequence[float] | None = None, model: str | None = None) -> DataFrame:
        """``id, rank`` of the first 40 hits; vectors join in if they are of the library's model."""
        if not query.strip():
            raise ValueError("the query is empty")
        words = search.ranked(search.fts_search(self.postings, self.n_docs, query))
        if vector is None or self.chunks is None or model != self.model:
            return words
        near = search.ranked(search.vector_search(self.chunks, vector))
        return search.ranked(search.fuse(words, near))

    def ranked_of_type(self, query: str, kind: str) -> DataFrame:
        """``id, score`` of the hits of one kind that a reader may be shown; the cut to 40 comes before the kind."""
        hits = search.fts_search(self.postings, self.n_docs, query)
        kept = self.concepts.filter((F.col("type") == kind) & schema.stable_only(F.col("status"))).select("id")
        return hits.join(kept, "id", "left_semi")

    def search(self, query: str, *, kind: str | None = None, low: str | None = None, high: str | None = None, tags: Sequence[str] = (), vector: Sequence[float] | None = None, model: str | None = None) -> DataFrame:
        """At most 16 pages. The cut to 40 hits comes before every filter, so filters never widen it."""
        hits = self.ranked(query, vector, model)
        records = search.inherit(self.concepts, self.papers)
        met = search.retrieve(records.join(F.broadcast(hits), "id"), kind="TextExtract" if kind == "TextExtract" else None, low=low, high=high, tags=tags)
        extract = (F.col("type") == "TextExtract") & F.lit(kind != "TextExtract")
        target = met.withColumn("target", F.when(extract, F.col("paper")).otherwise(F.col("id"))).groupBy("target").agg(F.min("rank").alias("rank"))
        pages = self.concepts.select(F.col("id").alias("target"), "type", "title", "path", "published", "paper", F.slice("outgoing", 1, schema.CAPS["links"]).alias("outgoing"))
        out = pages.join(F.broadcast(target), "target")  # at most 40 hits
        out = out if kind is None else out.filter(F.col("type") == kind)
        return out.orderBy("rank", "target").limit(schema.CAPS["search_hits"]).withColumnRenamed("target", "id")

    def get(self, page: str, full: bool = False) -> DataFrame:
        most = 80_000 if full else 4_000
        rows = self.concepts.filter(F.col("id") == page)
        rows = rows if full else rows.filter(F.col("type") != "TextExtract")
        return rows.withColumn("truncated", F.length("body") > most).withColumn("body", F.substring("body", 1, most))

    def evidence(self, query: str, low: str | None = None, high: str | None = None) -> DataFrame:
        records = search.inherit(self.concepts, self.papers).join(F.broadcast(self.ranked(query)), "id")
        claims = search.retrieve(records, kind="Claim", low=low, high=high)
        return claims.orderBy("rank", "id").limit(schema.CAPS["evidence"]).select("id", "title", "paper", "confidence", "stance", "published", "rank")

    def evidence_papers(self, query: str) -> DataFrame:
        return self.evidence(query).groupBy("paper").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "paper")

    def passages(self, query: str) -> DataFrame:
        return search.best_passages(self.texts, query)

    def context(self, question: str, mode: str = "ask") -> str:
        """What a model is given to answer a question, at most 24 000 characters."""
        asked = self.concepts.sparkSession.range(1).select(text.asks_coverage(F.lit(question)).alias("a"), text.coverage_years(F.lit(question)).alias("y")).first()
        gaps = None
        if mode == "gap" or asked.a:
            topic = self.ranked_of_type(question, "Topic").orderBy(F.round("score", 6).desc(), "id").first()
            gaps = [] if topic is None else [f"{r.kind}: {r.gap_id}" for r in self.gaps(topic.id).limit(context.GAPS).collect()]
        titles = [f"- {r.id} {r.title}" for r in self.papers.filter(schema.stable_only(F.col("status"))).orderBy(*pages.workbench_order()).select("id", "title").limit(context.TITLES).collect()]
        return context.assemble(question, context.retrieval(self, question), mode, gaps, titles)

    def cite_ids(self, question: str) -> dict[str, list[str]]:
        return context.cite_ids(self, question)

    def sync_vectors(self, client, model: str) -> DataFrame:
        """Vectors of the first passages of extracts and of claims with their quotes, by a client.

        Only what is new or has changed since the last call is cut and embedded; vectors of
        removed pages and of another model go.
        """
        if self.store is None:
            raise ValueError("vectors need an index: call with_index first")
        kinds = self.concepts.filter(F.col("type").isin("TextExtract", "Claim")).select("id", "type")
        sources = self.texts.join(kinds.select("id"), "id", "left_semi")
        claims = self.concepts.filter("type = 'Claim'").select("id", "title", "body").join(sources.select("id"), "id", "left_anti")  # without a body, a title is embedded
        cut = lambda delta: search.chunks(delta.join(kinds, "id"), delta)
        self.chunks, self.model = self.store.refresh_vectors(sources.unionByName(claims), cut, client, model), model
        return self.chunks

    # pages ----------------------------------------------------------------------------
    def open(self, page: str) -> DataFrame:
        return pages.open_page(self.concepts, page)

    def cards(self) -> DataFrame:
        return pages.cards(self.concepts).orderBy("type", "title", "id")

    def shelf(self, low: str | None = None, high: str | None = None, query: str = "") -> DataFrame:
        return pages.paper_filter(self.papers, low, high, query).orderBy(*pages.workbench_order())

    def root_page(self) -> str:
        return pages.root_page(self.concepts)

    def save_note(self, title: str, body: str) -> DataFrame:
        return compiling.save_page(self.concepts, "Note", title, body)

    def save_survey(self, title: str, body: str) -> DataFrame:
        return compiling.save_page(self.concepts, "Survey", title, body)

    # graph ----------------------------------------------------------------------------
    def backlinks(self, page: str, kind: str | None = None) -> DataFrame:
        return graph.backlinks(self.concepts, self.edges, page, kind)

    def neighbors(self, page: str, kind: str | None = None) -> DataFrame:
        out = graph.neighbors(self.concepts, self.edges, page)
        return (out if kind is None else out.filter(F.col("type") == kind)).orderBy("rank", "title", "id")

    def neighborhood(self, seeds: Sequence[str], depth: int = 1) -> DataFrame:
        return graph.neighborhood(self.concepts, self.edges, seeds, depth, self.adjacent)

    def walk(self, start: str, depth: int = 1) -> DataFrame:
        return graph.walk(self.concepts, self.edges, start, depth)

    def graph(self, page: str | None = None, depth: int = 1, claims: bool = False, query: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Nodes (at most 48) and the links among them (at most 80): around a page, of a search (with its claims), or of the whole library."""
        if page is not None and pages.sealed(page):
            raise ValueError("this path is not served")
        allowed = None
        if page is not None:
            allowed = self.neighborhood([page], depth)
        elif query is not None:
            hits = self.ranked(query).filter(F.col("rank") < schema.CAPS["search_hits"])
            allowed, claims = graph.search_scope(self.concepts, graph.edge_list(self.concepts), hits), True
        return graph.tool_graph(self.concepts, self.edges, allowed, claims)[:2]

    def filtered(self, **options) -> DataFrame:
        """``id`` of the nodes of a view; see ``graph.filter_graph``."""
        query = options.pop("query", None)
        if query:
            shown = schema.graph_node(F.col("type"), F.col("status"), F.col("confidence"))
            met = self.concepts.filter(schema.stable_only(F.col("status"))).join(F.broadcast(self.ranked(query)), "id")
            options["seeds"] = met.select(F.when(shown, F.col("id")).otherwise(F.col("paper")).alias("id")).filter("id is not null")
        return graph.filter_graph(self.concepts, self.edges, **options)[0]

    def workbench(self, cap: int = schema.CAPS["overview"]) -> DataFrame:
        return graph.select_capped(self.concepts, self.edges, min(cap, 20_000))

    def compare(self, papers: Sequence[str] | None = None, query: str | None = None) -> DataFrame:
        """Hubs that papers share: the given ones (at most 48), or the first 24 of a query."""
        if papers is None and not query:
            raise ValueError("name papers or a query to compare")
        if papers is None:
            found = graph.papers_from_hits(self.concepts, self.edges, self.ranked(query)).orderBy("rank", "step", "id").limit(schema.CAPS["compare"])
            papers = [r.id for r in found.collect()]  # 24 at most
        if len(papers) > schema.CAPS["compare_explicit"]:
            raise ValueError(f"at most {schema.CAPS['compare_explicit']} papers can be compared")
        return graph.shared_hubs(self.concepts, coverage.hub_links(self.concepts, self.edges), papers).orderBy(F.col("n_papers").desc(), "hub").limit(schema.CAPS["shared"])

    def comparison(self, papers: Sequence[str] | None = None, query: str | None = None) -> dict:
        """Papers side by side: ``papers`` (cards), ``shared`` hubs and ``tags``, ``missing`` ids, ``truncated``, ``nodes`` and ``edges`` among the papers and what they share.

        The given papers (48 at most), those of a query (24), or all of a library of up to 24;
        a larger one has to say which.
        """
        cap, missing, truncated = schema.CAPS["compare"], [], False
        if papers:
            asked = list(dict.fromkeys(p.strip().lstrip("/").removesuffix(".md") for p in papers if p.strip()))
            there = {r.id for r in self.papers.filter(F.col("id").isin(*asked)).select("id").collect()}  # no more than were asked for
            missing, chosen, cap = [p for p in asked if p not in there], [p for p in asked if p in there], schema.CAPS["compare_explicit"]
        elif query and query.strip():
            found = graph.papers_from_hits(self.concepts, self.edges, self.ranked(query)).orderBy("rank", "step", "id").limit(cap + 1)
            chosen = [r.id for r in found.collect()]
            if not chosen:
                raise ValueError("the query matches no paper")
        else:
            chosen = [r.id for r in self.papers.orderBy(F.coalesce("published", F.lit("")).desc(), "id").select("id").limit(cap + 1).collect()]
            if len(chosen) > cap:
                raise ValueError(f"the library has more than {cap} papers: name some, or ask a query")
        truncated, chosen = len(chosen) > cap, chosen[:cap]
        hub_links = coverage.hub_links(self.concepts, self.edges)
        every = graph.shared_hubs(self.concepts, hub_links, chosen)
        rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.col("n_papers").desc(), "hub"))
        shared = every.withColumn("place", rank).filter(F.col("place") <= schema.CAPS["shared"]).drop("place")
        tags = graph.shared_tags(self.papers, chosen).orderBy(F.col("n_papers").desc(), "tag").limit(schema.CAPS["shared"])
        title = self.concepts.select("id", "type", F.coalesce("title", "id").alias("title"))
        order = F.array_position(F.array(*map(F.lit, chosen)), F.col("id"))
        nodes = title.filter(F.col("id").isin(*chosen)).withColumn("o", order).unionByName(title.join(every.select(F.col("hub").alias("id")), "id").withColumn("o", F.lit(len(chosen) + 1).cast("long")))
        nodes = nodes.orderBy("o", "type", "id").limit(schema.CAPS["graph_nodes"]).select("id", "type", "title")
        ends = hub_links.filter(F.col("paper").isin(*chosen)).join(every.select("hub"), "hub").select(F.col("paper").alias("src"), F.col("hub").alias("dst")).distinct()
        return {"papers": graph.paper_cards(self.concepts, self.edges, hub_links, chosen), "shared": shared, "tags": tags, "missing": missing, "truncated": truncated, "nodes": nodes, "edges": ends.orderBy("src", "dst").limit(schema.CAPS["graph_edges"])}

    def shared_tags(self, papers: Sequence[str]) -> DataFrame:
        return graph.shared_tags(self.papers, papers)

    def check(self) -> DataFrame:
        return graph.issues(self.concepts, self.edges)

    # coverage -------------------------------------------------------------------------
    def coverage(self) -> DataFrame:
        return coverage.topic_years(self.concepts, self.edges)

    def gaps(self, topic: str) -> DataFrame:
        return coverage.gaps(self.concepts, self.edges, topic).orderBy("gap_id")

    def hotspots(self) -> DataFrame:
        return coverage.hotspots(self.concepts, self.edges)

    def stats(self) -> dict[str, DataFrame]:
        return {"counts": coverage.census(self.concepts), "years": coverage.papers_by_year(self.concepts), "tags": coverage.tag_census(self.concepts), "hubs": coverage.hub_ranking(self.concepts, self.edges)}

    # integrity and change ---------------------------------------------------------------
    def cite_check(self, body: str) -> DataFrame:
        one = self.concepts.sparkSession.createDataFrame([("draft", body)], "id string, body string")
        return integrity.cite_check(one, self.concepts)

    def near_duplicates(self, dismissed: DataFrame | None = None) -> DataFrame:
        """``a, b, reason`` of live hubs that a reviewer may find to be one, but for the ``dismissed`` pairs (``a, b``)."""
        hubs = self.concepts.filter(F.col("type").isin(*schema.HUB_TYPES) & schema.live(F.col("status"))).select("type", "path", "title", "aliases")
        side = lambda s: hubs.select("type", F.col("path").alias(s), F.col("title").alias(f"t{s}"))
        met = resolve.candidate_pairs(hubs).join(side("a"), ["type", "a"]).join(side("b"), ["type", "b"])
        judged = met.select("a", "b", resolve.near_duplicate_reason(F.col("type"), F.col("ta"), F.col("tb")).alias("reason")).filter("reason IS NOT NULL")
        return judged if dismissed is None else integrity.without_dismissed(judged, dismissed)

    def consolidate(self) -> DataFrame:
        """``gone, into``: hubs that may merge without a human, the best linked first; see ``merging.consolidate``."""
        hubs = self.concepts.filter(F.col("type").isin(*schema.HUB_TYPES) & schema.live(F.col("status")))
        slim = hubs.select("type", "path", "title", "aliases")
        side = lambda s: slim.select("type", F.col("path").alias(s), F.col("title").alias(f"t{s}"), F.col("aliases").alias(f"l{s}"))
        met = resolve.candidate_pairs(slim).join(side("a"), ["type", "a"]).join(side("b"), ["type", "b"])
        judged = met.filter(resolve.merge_reason(F.col("type"), F.col("ta"), F.col("tb"), F.col("la"), F.col("lb")).isNotNull()).select("a", "b")
        paths = self.concepts.select("id", "path")
        counted = self.edges.join(self.papers.select(F.col("id").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n")).join(paths, "id").select("path", "n")
        pairs = resolve.canonical(judged, counted).select(F.concat_ws("\x1f", "a", "b").alias("place"), "keep", "drop")
        return merging.consolidate(pairs, hubs.filter("verified_human").select(F.col("path").alias("id"))).select("gone", "into")

    def canonicalize(self, moves: DataFrame) -> DataFrame:
        """Concepts after moves (``from_id, to_id``); see ``merging.canonicalize``."""
        return merging.canonicalize(self.concepts, moves)

    def merge(self, other: Library) -> DataFrame:
        """What a merge of another library's papers into this one would do."""
        return merge.merge_papers(other.papers.withColumn("verified", F.col("verified_human")), self.papers.withColumn("verified", F.col("verified_human")))

    def merge_pages(self, other: Library, moves: DataFrame) -> DataFrame:
        """``path, action, conflict`` of hubs, notes, questions and surveys of another library; ``moves`` are its papers' new ids."""
        mine = self.concepts.withColumn("verified", F.col("verified_human"))
        of = lambda frame, *kinds: frame.filter(F.col("type").isin(*kinds))
        out = merge.merge_hubs(of(other.concepts, *schema.HUB_TYPES), of(mine, *schema.HUB_TYPES)).select("path", "action", "conflict")
        for kind in ("Note", "Question", "Survey"):
            out = out.unionByName(merge.merge_slug_pages(of(other.concepts, kind), of(mine, kind), kind).select("path", "action", "conflict"))
        bare = F.lit(None).cast("string").alias("quote")
        claims = lambda frame: of(frame, "Claim").select("path", "paper", "title", bare, "body", "verified_human", "confidence").withColumnRenamed("verified_human", "verified")
        return out.unionByName(merge.merge_claims(claims(other.concepts).drop("verified", "confidence"), claims(self.concepts), moves).select("path", "action", "conflict"))

    def bibtex(self, ids: Sequence[str] | None = None) -> DataFrame:
        none = F.lit(None).cast("string")
        rows = self.papers if ids is None else self.papers.filter(F.col("id").isin(*ids))
        have = set(rows.columns)
        authors = F.nullif(F.array_join("authors", " and "), F.lit("")) if "authors" in have else none
        return survey.bibtex(rows.select("id", "title", "published", "doi", authors.alias("authors"), (F.col("venue") if "venue" in have else none).alias("venue")))

    def export(self, page: str, style: str = "md") -> DataFrame:
        """``id, text, bibtex`` of a survey as a manuscript: links to papers, and to claims of papers, are citations."""
        surveys = self.concepts.filter(F.col("id") == page).select("id", "path", "title", "body")
        keys = survey.citation_keys(self.papers)
        claims = self.concepts.filter(F.col("type") == "Claim").select("id", "paper").join(keys.select(F.col("id").alias("paper"), "key"), "paper").select("id", "key")
        cited = links.body_links(surveys.select("id", "body")).select(F.regexp_replace("target", r"\.md$", "").alias("id")).distinct()
        known = keys.select("id", "key").unionByName(claims).join(cited, "id", "left_semi")
        woven = survey.manuscript(surveys.select("id", text.strip_generated_blocks(F.col("body"), ("coverage",)).alias("body")), known, "tex-body" if style == "tex" else "md")
        stem = text.manuscript_stem(F.col("path"))
        shown = text.latex_document(F.col("title"), F.col("text"), stem) if style == "tex" else text.pandoc_document(F.col("title"), F.col("text"))
        papers = keys.select(F.col("id").alias("paper"), "key").join(known.select("key").distinct(), "key").select("paper")
        entries = self.bibtex().join(papers, F.col("id") == F.col("paper"), "left_semi").agg(F.array_join(F.array_sort(F.collect_list("entry")), "\n\n").alias("bibtex"))  # what one survey cites
        return surveys.join(woven, "id").select("id", shown.alias("text")).join(entries)

    def compile_survey(self, topic: str, low: str | None = None, high: str | None = None) -> dict[str, DataFrame]:
        """What a survey of a topic is written from: papers in scope, claims in two parts, year buckets, ids that it may cite."""
        scope = coverage.survey_scope(self.concepts, self.edges, topics=[topic], low=low, high=high)
        dated = scope.filter("dated")
        return {"papers": scope, "claims": coverage.survey_claims(self.concepts, dated), "buckets": coverage.survey_buckets(self.concepts, self.edges, topic), "allowed": coverage.allowed_ids(scope, self.concepts)}

    def ingest(self, files: DataFrame, state: DataFrame, version: int, readers: dict | None = None) -> DataFrame:
        """``path, format, body, problem`` of the source files (``path, content``) whose content or compile version is new to the state."""
        stamped = files.select("path", F.sha2("content", 256).alias("sha256"))
        todo = incremental.to_compile(stamped, state, version).select("path")
        return documents.extract_documents(files.join(todo, "path", "left_semi"), readers)

    def compile(self, items: DataFrame) -> DataFrame:
        """Pages that hub items of compiled outputs (``title, type, tags, body, paper_title, paper_href``) become: titles align with the library's hubs first, and all items that go to one page are kept."""
        vocabulary = resolve.vocabulary(self.concepts)
        probes = items.select(F.concat_ws("\x1f", "type", "title").alias("probe"), "type", "title").distinct()
        found = align.lookup(align.index(vocabulary), probes).select("probe", "path")
        folders = F.create_map(*[F.lit(x) for pair in schema.DIRECTORIES.items() for x in pair])
        own = F.concat(F.try_element_at(folders, F.col("type")), F.lit("/"), text.slug(F.col("title")), F.lit(".md"))
        incoming = items.withColumn("probe", F.concat_ws("\x1f", "type", "title")).join(found, "probe", "left").withColumn("path", F.coalesce("path", own)).withColumn("incoming_title", F.col("title"))
        return compiling.upsert_pages(incoming, self.concepts.withColumn("verified", F.col("verified_human")))

    def pack(self, files: DataFrame, **options) -> bytes:
        return source.pack(files, **options)

    def cited(self, page: str) -> DataFrame:
        return self.concepts.filter(F.col("id") == page).select(F.explode(text.cite_ids(F.col("body"))).alias("id"))
