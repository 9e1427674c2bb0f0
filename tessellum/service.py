"""The engine behind a service: one object that answers, lists, saves and reloads itself when the stored corpus changes.

Each method takes plain values and returns plain values (what an HTTP layer would send as JSON); bad requests raise ValueError.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import engine, store, wiki
from .operators import community, entity, graph, search
from .operators.search import Bundle


class Service:
    def __init__(self, spark: SparkSession, root: str, embed: Callable = search.hash_embedding, model: Callable | None = None, planner: Callable | None = None, attempts: int = 3):
        self.spark, self.root, self.embed, self.model, self.planner, self.attempts = spark, root, embed, model, planner, attempts
        self._seen: tuple | None = None
        self._bundle: Bundle | None = None

    def bundle(self) -> Bundle:
        """The current build, loaded anew when its signature has changed; a build that changes while it is read is read again."""
        for _ in range(self.attempts):
            seen = store.signature(self.spark, self.root)
            if seen == self._seen and self._bundle is not None:
                return self._bundle
            found = store.load(self.spark, self.root)
            if store.signature(self.spark, self.root) == seen:
                self._seen, self._bundle = seen, found
                return found
        raise RuntimeError("the stored corpus kept changing while it was read")

    def health(self) -> dict:
        """Whether there is a build, and its manifest."""
        place = store.current(self.spark, self.root)
        return {"ready": place is not None, "manifest": store.about(self.spark, place) if place else None}

    def kbs(self) -> list[str]:
        """Names of the knowledge bases, sorted."""
        return [r["kb"] for r in self.bundle().files.select("kb").where("kb <> ''").distinct().orderBy("kb").collect()]

    def ask(self, question: str, mode: str = "hybrid", kb: str | None = None, top_k: int | None = None) -> dict:
        """hits, context, sources and trace of one question."""
        if not isinstance(question, str) or not question.strip():
            raise ValueError("a question is needed")
        if mode not in engine.MODES:
            raise ValueError(f"mode is one of {', '.join(engine.MODES)}")
        if top_k is not None and not 1 <= top_k <= 50:
            raise ValueError("top_k is from 1 to 50")
        if kb is not None and kb not in self.kbs():
            raise ValueError(f"there is no knowledge base {kb}")
        asked = self.spark.createDataFrame([(0, question.strip(), kb)], "query_id long, text string, kb string")
        found = engine.retrieve(self.bundle(), asked, mode, top_k, self.embed, self.planner, self.model)
        listed = lambda df, order: [r.asDict(recursive=True) for r in df.orderBy(order).collect()]  # noqa: E731  top_k rows
        return {"hits": listed(found.hits, "rank"), "context": found.contexts.first()["context"], "sources": listed(found.sources, "rank"), "trace": listed(found.trace, "step"), "wiki": listed(found.wiki, "rank")}

    def ask_stream(self, question: str, answer: Callable[[str], Iterator[str]], **options) -> Iterator[str]:
        """Pieces of an answer as ``answer`` gives them for the question and its evidence."""
        yield from answer(f"{question}\n\n{self.ask(question, **options)['context']}")

    def wiki_index(self) -> dict:
        """The index page and how many pages of each kind there are."""
        pages = self.bundle().pages
        index = pages.where("kind = 'index'").select("text").first()
        return {"text": index["text"] if index else "", "counts": {r["kind"]: r["n"] for r in wiki.kind_counts(pages).collect()}}

    def wiki_page(self, relpath: str) -> dict:
        """A page by its path; KeyError if there is none."""
        if relpath.startswith("/") or ".." in relpath.split("/"):
            raise ValueError("the path of a page stays inside the wiki")
        row = self.bundle().pages.where(F.col("relpath") == relpath).first()
        if row is None:
            raise KeyError(relpath)
        return row.asDict()

    def save_query(self, question: str, answer: str, sources: list[str], tags: list[str] = ()) -> str:
        """Saves an answer as a note, refreshes the graph with it, and returns its path."""
        path = wiki.save_note(self.spark, self.root, question, answer, sources, tags)
        store.refresh_notes(self.spark, self.root)
        return path

    def graph_report(self) -> str:
        """Communities, hubs and bridges in Markdown."""
        b = self.bundle()
        relations = graph.cut(entity.project_files(b.doc_edges, b.nodes, b.edges))
        place = store.current(self.spark, self.root)
        member, summary = store.checked(self.spark, place, "members"), store.checked(self.spark, place, "communities")
        return community.report(summary, community.god_nodes(relations), community.bridges(member, relations), community.semantic_counts(b.nodes, b.edges))
