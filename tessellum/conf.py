"""Engine settings: every tunable number in one frozen object."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values of the data model: words, priorities and kinds that results must agree on.
STOPWORDS = ("this", "that", "with", "from", "have", "file", "files", "docs", "document", "documents", "guide", "notes", "readme", "config", "setting", "settings")

#: Document graph: lower is kept first.
EDGE_PRIORITY = {"links_to": 0, "mentions_path": 1, "shared_symbol": 2, "same_series": 3}
#: Neighbours through the entity graph; other kinds have OTHER_PRIORITY.
EXPANSION_PRIORITY = {"references": 0, "imports": 1, "links_to": 2, "mentions_path": 3, "rationale_for": 4, "semantically_related": 5, "shared_symbol": 6, "same_series": 7}
OTHER_PRIORITY = 18
INFERRED = ("shared_symbol", "same_series", "rationale_for", "semantically_related")
ATTACHED = ("concept", "decision", "query_note")
#: Edges that make files one community.
STRONG = ("links_to", "mentions_path", "references", "imports")
ITEM_PRIORITY = {"symbol": 5, "file": 4, "section": 3, "concept": 3, "decision": 3}
PAGE_PRIORITY = {"query": 4, "entity": 3, "community": 2, "file": 1, "index": 0}


@dataclass(frozen=True)
class EngineConf:
    """Defaults of retrieval, graphs, chunking and chat windows."""

    top_k: int = 6
    chunk_size: int = 1200
    overlap_lines: int = 3
    k1: float = 1.5
    b: float = 0.75
    rrf_k: int = 60
    weights: dict = field(default_factory=lambda: {"ast": 1.0, "grep": 0.9, "bm25": 0.85, "glob": 0.6, "vector": 0.5})
    priorities: dict = field(default_factory=lambda: {"ast": 5, "grep": 4, "bm25": 3, "vector": 2, "glob": 1})
    exact_symbol_bonus: float = 0.25
    exact_path_bonus: float = 0.15
    per_source: int = 2
    neighbors: int = 8
    shared_df: tuple = (2, 5)
    window_minutes: int = 30
    quiet_minutes: int = 120
    min_chars: int = 800
    max_chars: int = 3000
    context_lines: int = 4
    max_hops: int = 1
    max_extra: int = 12
    rerank_pool: int = 30
    rerank_chars: int = 600
    semantic_chars: int = 2500
    #: Rows of a query-side table that are sent to every executor at once; more go in several such blocks.
    block: int = 2000


CONF = EngineConf()
