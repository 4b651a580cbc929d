"""Column layouts, caps and liveness predicates of a document library."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONCEPTS = (
    "id string, path string, type string, title string, published string, tags array<string>, status string, "
    "verified_human boolean, paper string, doi string, outgoing array<string>, confidence string, stance string, "
    "aliases array<string>, body string"
)
EDGES = "src string, pos int, dst string"
FILES = "path string, size bigint, mtime_ms bigint, sha256 string"
STATE = "path string, sha256 string, extract string, paper string, extractor string, status string, error string"

#: Graph types in rank order, and the folder of every page type.
GRAPH_TYPES = ("Paper", "Topic", "Method", "Entity", "Dataset", "Gene", "Pathway", "Claim")
DIRECTORIES = {
    "Paper": "papers", "Topic": "topics", "Method": "methods", "Entity": "entities", "Dataset": "datasets", "Gene": "genes",
    "Pathway": "pathways", "Claim": "claims", "TextExtract": "extracts", "Note": "notes", "Question": "questions", "Survey": "surveys",
}
HUB_TYPES = ("Topic", "Method", "Entity", "Dataset", "Gene", "Pathway")
RESERVED = ("index.md", "log.md", "AGENTS.md")
#: How many rows the answers hold at most.
CAPS = {
    "index_hits": 40, "search_hits": 16, "links": 12, "neighbors": 12, "stats": 16, "evidence": 12, "compare": 24, "compare_explicit": 48,
    "shared": 24, "graph_nodes": 48, "graph_edges": 80, "review": 40, "questions": 50, "sessions": 40, "passages": 3, "chunks": 16,
    "survey_claims": 24, "featured": 6, "overview": 8000,
}


def type_rank(kind: Column) -> Column:
    out = F.lit(len(GRAPH_TYPES))
    for i, name in reversed(list(enumerate(GRAPH_TYPES))):
        out = F.when(kind == name, F.lit(i)).otherwise(out)
    return out


def live(status: Column) -> Column:
    """Counted by coverage and census: not deprecated."""
    return ~status.eqNullSafe(F.lit("deprecated"))


def graph_node(kind: Column, status: Column, confidence: Column) -> Column:
    """Shown in graphs: a graph type, not deprecated, and no disputed claim."""
    return kind.isin(*GRAPH_TYPES) & live(status) & ~((kind == "Claim") & confidence.eqNullSafe(F.lit("disputed")))


def stable_only(status: Column) -> Column:
    return status == "stable"


def normal_status(status: Column) -> Column:
    return F.when(status.isin("draft", "stable", "deprecated"), status).otherwise(F.lit("stable"))


def indexable(path: Column) -> Column:
    folders = "|".join(DIRECTORIES.values())
    name = F.element_at(F.split(path, "/"), -1)
    return path.rlike(rf"^({folders})/.*\.md$") & ~name.isin(*RESERVED) & ~path.rlike(r"(^|/)\.")
