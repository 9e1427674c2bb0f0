"""The engine: questions in, ranked hits, contexts and traces out, for as many questions as are asked at once.

A search step is one dataflow over all questions; what the questions need (a retry without scope, wider vectors, feedback)
is decided for each by rows, not on the driver. A second step runs for the questions that the first left open.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .conf import CONF, EngineConf
from .functions import text as T
from .operators import graph, planning, search
from .operators.search import Bundle

MODES = ("vector", "hybrid", "agentic")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def expand_sources(b: Bundle, seeds: DataFrame, plan: DataFrame, allowed: DataFrame | None = None, conf: EngineConf = CONF) -> DataFrame:
    """(query_id, source, hop, src, kind, reason, strategy): what the graphs add to the seeds (query_id, source, ord).

    The entity graph first; for questions to which it adds nothing, the document graph; then files of the same folder and
    series. Only files in scope are entered.
    """
    first = graph.cut(seeds.select("query_id", F.col("source").alias("node"), "ord"))
    out = []
    left = first
    series = graph.same_series(b.files, first.select(F.col("node").alias("src"))).withColumn("kind", F.lit("same_series")).withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("dst")))
    for name, edges, hops in (("entity_graph", b.neighbors, conf.max_hops), ("document_graph", b.doc_edges, conf.max_hops), ("heuristic", series, 1)):
        reach = graph.expand(edges, left, hops, extra=conf.max_extra).where("hop > 0")
        near = edges.select("src", F.col("dst").alias("node"), "kind", "reason")
        found = reach.join(near, ["src", "node"]).select("query_id", F.col("node").alias("source"), "hop", "src", "kind", "reason", "place")
        found = graph.cut(search.scoped(found, plan, allowed).withColumn("strategy", F.lit(name)))
        out.append(found)
        left = left.join(found.select("query_id").distinct(), "query_id", "left_anti")
    return _union(out)


@dataclass
class Step:
    """What a search step found: plans as used, hits of every kind (HIT), the fused ones, wiki pages, graph additions and facts of each question."""

    plan: DataFrame
    grouped: DataFrame
    fused: DataFrame
    wiki: DataFrame
    graph: DataFrame
    facts: DataFrame


def search_step(b: Bundle, plan: DataFrame, k: int, allowed: DataFrame | None = None, embed: Callable = search.hash_embedding, conf: EngineConf = CONF) -> Step:
    """One hop for all plans: names of the corpus, wiki, five retrievers, graph, fusion, wider vectors, feedback."""
    wide = max(2 * k, 8)
    used = graph.cut(planning.expanded(plan, b.items, allowed))
    wiki = graph.cut(search.wiki_hits(b, used, allowed, conf=conf))
    wiki_sources = wiki.select("query_id", F.explode("source_refs").alias("source"), "rank").groupBy("query_id", "source").agg(F.min("rank").alias("ord"))
    globs = graph.cut(search.glob_hits(b, used, allowed, conf))
    scope = graph.cut(wiki_sources.select("query_id", "source").unionByName(globs.select("query_id", "source")).distinct())
    narrow = scope if allowed is None else scope.unionByName(allowed.select("query_id", "source").join(scope.select("query_id").distinct(), "query_id", "left_anti"))
    greps = graph.cut(search.grep_hits(b, used, narrow, conf))
    retry = used.join(scope.select("query_id").distinct(), "query_id", "left_semi").join(greps.select("query_id").distinct(), "query_id", "left_anti")
    retry = graph.cut(retry)
    if not retry.isEmpty():
        greps = greps.unionByName(graph.cut(search.grep_hits(b, retry, allowed, conf)))
    symbols = graph.cut(search.symbol_hits(b, used, allowed, conf))
    bm25 = graph.cut(search.bm25_hits(b, used, wide, allowed, conf))
    lexical = _union([globs, greps, symbols, bm25])
    first = search.candidate_sources(lexical, 3).withColumn("ord", F.col("ord") + 1000)
    seeds = wiki_sources.unionByName(first.select("query_id", "source", "ord")).groupBy("query_id", "source").agg(F.min("ord").alias("ord"))
    added = graph.cut(expand_sources(b, seeds, used, allowed, conf))
    narrowed = _union([x.select("query_id", "source") for x in (wiki_sources, globs, search.candidate_sources(_union([greps, symbols, bm25]), 4), seeds, added)]).distinct()
    narrowed = graph.cut(narrowed if allowed is None else narrowed.unionByName(allowed.select("query_id", "source").join(narrowed.select("query_id").distinct(), "query_id", "left_anti")))
    vectors = graph.cut(search.vector_hits(b, used, wide, narrowed, embed, conf))
    grouped = lexical.unionByName(vectors)
    fused = graph.cut(search.fused(grouped, k, conf))

    # questions of a narrow scope whose best hits are few and unsure get the nearest of all
    n_files = b.files.count()
    sure = lexical.where("match_kind <> 'bm25'").where("exact_path or exact_symbol").select("query_id").distinct().withColumn("sure", F.lit(True))
    spread = fused.groupBy("query_id").agg(F.count("*").alias("n_hits"), F.count_distinct(F.when(F.col("rank") <= 3, F.col("source"))).alias("n_top"))
    size = narrowed.groupBy("query_id").agg(F.count("*").alias("n_scope"))
    facts = used.select("query_id", "question", "symbols", "path_globs", "wants_symbol", "kb").join(spread, "query_id", "left").join(size, "query_id", "left").join(sure, "query_id", "left")
    facts = facts.fillna({"n_hits": 0, "n_top": 0, "n_scope": 0, "sure": False}).withColumn("narrow", (F.col("n_scope") > 0) & (F.col("n_scope") < n_files))
    facts = graph.cut(facts.withColumn("broaden", F.col("narrow") & ~F.col("sure") & ((F.col("n_hits") == 0) | (F.col("n_top") < F.least(F.lit(2), F.col("n_hits"))))))
    broad = graph.cut(used.join(facts.where("broaden").select("query_id"), "query_id", "left_semi"))
    if not broad.isEmpty():
        more = search.merge_lists(search.vector_hits(b, broad, wide, allowed, embed, conf), vectors.join(broad.select("query_id"), "query_id", "left_semi"), max(3 * k, 12))
        vectors = graph.cut(vectors.join(broad.select("query_id"), "query_id", "left_anti").unionByName(more))
        grouped = lexical.unionByName(vectors)
        fused = graph.cut(search.fused(grouped, k, conf))

    # questions that named nothing and met nothing exact learn names from their nearest texts, and ask again
    exact = lexical.where("match_kind in ('grep', 'ast')").select("query_id").distinct()
    best = fused.where("rank = 1").select("query_id", F.col("match_kind").alias("best"))
    ask = facts.where("size(symbols) = 0 and size(path_globs) = 0 and not sure").join(exact, "query_id", "left_anti").join(best, "query_id").where("wants_symbol or best = 'vector'")
    ask = ask.join(vectors.select("query_id").distinct(), "query_id", "left_semi")
    fed = graph.cut(planning.fed_back(used.join(ask.select("query_id"), "query_id", "left_semi"), vectors, b.neighbors, b.symbols))
    same = fed.join(used.select("query_id", F.col("keywords").alias("k0"), F.col("symbols").alias("s0"), F.col("path_globs").alias("g0")), "query_id")
    fed = graph.cut(same.where("keywords <> k0 or symbols <> s0 or path_globs <> g0").drop("k0", "s0", "g0"))
    if not fed.isEmpty():
        again = _union([search.glob_hits(b, fed, allowed, conf), search.grep_hits(b, fed, allowed, conf), search.symbol_hits(b, fed, allowed, conf), search.bm25_hits(b, fed, wide, allowed, conf)])
        own = lexical.join(fed.select("query_id"), "query_id", "left_semi")
        lexical = graph.cut(lexical.join(fed.select("query_id"), "query_id", "left_anti").unionByName(search.merge_lists(again, own, wide)))
        grouped = lexical.unionByName(vectors)
        fused = graph.cut(search.fused(grouped, k, conf))
    marks = [(retry, "grep_retried"), (broad, "vector_broadened"), (fed, "fed_back")]
    for rows, name in marks:
        facts = facts.join(rows.select("query_id").withColumn(name, F.lit(True)), "query_id", "left").fillna({name: False})
    return Step(used, grouped, fused, wiki, added, facts)


def stops(fused: DataFrame, plan: DataFrame) -> DataFrame:
    """(query_id, stopped, reason): whether the first step is enough: two files among the first three, an exact symbol, or a clear lead."""
    at = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    own = fused.groupBy("query_id").agg(F.count_distinct(F.when(F.col("rank") <= 3, F.col("source"))).alias("n_top"), at(1, "exact_symbol").alias("exact"), at(1, "match_kind").alias("kind"), at(1, "score").alias("s1"), F.coalesce(at(2, "score"), F.lit(0.0)).alias("s2"))
    reason = F.when(F.col("n_top").isNull(), "no_hits").when(F.col("n_top") >= 2, "top3_cover_two_files").when(F.col("exact"), "exact_symbol_hit").when(F.col("kind").isin("ast", "grep") & (F.col("s1") >= F.col("s2") + 0.1), "dominant_exact_hit").otherwise("needs_followup")
    return plan.select("query_id").join(own, "query_id", "left").select("query_id", ~reason.isin("no_hits", "needs_followup").alias("stopped"), reason.alias("reason")).withColumn("stopped", F.col("reason").isin("top3_cover_two_files", "exact_symbol_hit", "dominant_exact_hit"))


@dataclass
class Answer:
    """hits (HIT), contexts (query_id, context), sources, trace (a row a question and step), wiki pages and bridges on the way."""

    hits: DataFrame
    contexts: DataFrame
    sources: DataFrame
    trace: DataFrame
    wiki: DataFrame
    bridges: DataFrame


def retrieve(
    b: Bundle, questions: DataFrame, mode: str = "hybrid", k: int | None = None, embed: Callable = search.hash_embedding, planner: Callable[[str], dict | None] | None = None, model: Callable[[str], str] | None = None, conf: EngineConf = CONF
) -> Answer:
    """The k best hits of each question (query_id, text[, kb]), with what they rest on.

    vector: nearest chunks alone. hybrid: one search step. agentic: a second step, within the files that two hops reach from the
    first one's, for questions that it left open, by the plan that ``planner`` adds. ``model`` reranks, if there is one.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    k = max(1, k or conf.top_k)
    pool = max(k, conf.rerank_pool) if model else k
    plan = graph.cut(planning.plans(questions))
    if mode == "vector":
        hits = graph.cut(search.vector_hits(b, plan, pool, embed=embed, conf=conf))
        trace = plan.select("query_id", F.lit("step1").alias("step"), F.lit(True).alias("stopped"), F.lit("vector_mode").alias("reason"))
        none = b.pages.sparkSession.createDataFrame([], "query_id long, relpath string, kind string, title string, score double, matched array<string>, source_refs array<string>, rank long")
        wiki, ways = none, None
    else:
        step = search_step(b, plan, pool, embed=embed, conf=conf)
        stop = graph.cut(stops(step.fused, plan))
        trace = stop.select("query_id", F.lit("step1").alias("step"), (F.col("stopped") | F.lit(mode != "agentic")).alias("stopped"), F.when(F.col("stopped") | F.lit(mode != "agentic"), F.col("reason")).otherwise("followup_requested").alias("reason"))
        hits, wiki, ways = step.fused, step.wiki, step.graph
        left = graph.cut(plan.join(stop.where("not stopped").select("query_id"), "query_id", "left_semi"))
        if mode == "agentic" and not left.isEmpty():
            seeds = search.candidate_sources(step.fused.join(left.select("query_id"), "query_id", "left_semi"))
            far = EngineConf(**{**conf.__dict__, "max_hops": 2, "max_extra": 20})
            added = expand_sources(b, seeds, left, conf=far)
            allowed = graph.cut(seeds.select("query_id", "source").unionByName(added.select("query_id", "source")).distinct())
            more = planning.followed(left, planner) if planner else left
            second = search_step(b, graph.cut(more), pool, allowed, embed, far)
            both = search.merge_steps([step.grouped.join(left.select("query_id"), "query_id", "left_semi"), second.grouped])
            hits = graph.cut(step.fused.join(left.select("query_id"), "query_id", "left_anti").unionByName(search.fused(both, pool, conf)))
            trace = trace.unionByName(left.select("query_id", F.lit("step2").alias("step"), F.lit(True).alias("stopped"), F.lit("bounded_agentic_complete").alias("reason")))
            wiki, ways = wiki.unionByName(second.wiki), ways.unionByName(second.graph)
    ranked, status = search.reranked(hits, questions, k, model, conf)
    ranked = graph.cut(ranked)
    trace = trace.join(status.withColumnRenamed("status", "rerank"), "query_id", "left")
    if ways is None:
        bridges = questions.select("query_id").limit(0).selectExpr("query_id", "'' AS id", "'' AS type", "'' AS name", "'' AS relation")
    else:
        on = b.neighbors.select("src", F.col("dst").alias("source"), F.explode("bridges").alias("b"))
        bridges = ways.where("strategy = 'entity_graph'").join(on, ["src", "source"]).select("query_id", "b.*").distinct()
    return Answer(ranked, search.contexts(ranked, questions), search.sources_of(ranked), trace, wiki, bridges)


def ask(b: Bundle, question: str, answer: Callable[[str], str] | None = None, **options) -> tuple[str, list]:
    """(answer or context, sources) of one question; ``answer`` takes the prompt of question and evidence."""
    spark = b.files.sparkSession
    found = retrieve(b, spark.createDataFrame([(0, question)], "query_id long, text string"), **options)
    context = found.contexts.first()["context"]
    sources = [r.asDict() for r in found.sources.orderBy("rank").collect()]  # top_k rows
    return (answer(f"{question}\n\n{context}") if answer else context), sources


def bundle_summary(b: Bundle) -> DataFrame:
    """(table, n): rows of each table of the bundle."""
    named = ("files", "chunks", "symbols", "doc_edges", "nodes", "edges", "items", "pages")
    return _union([getattr(b, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name in named])


def in_kb(df: DataFrame, kb: str, source: Column | None = None) -> DataFrame:
    """Rows whose source belongs to a knowledge base."""
    return df.where(T.kb_of(F.col("source") if source is None else source) == kb)
