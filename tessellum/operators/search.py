"""Retrieval of many questions at once over a stored corpus: five retrievers, the wiki, fusion, expansion, reranking.

Hits are rows of HIT. Every retriever takes plans (planning.PLAN) and a scope: rows (query_id, source) that restrict the
questions that have any, and no others. Where a pattern, keyword or vector must be held against all rows, the question side
is counted and sent in blocks of ``conf.block`` rows; the corpus side is never moved for it.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..conf import CONF, PAGE_PRIORITY, STOPWORDS, EngineConf
from ..functions import text as T
from . import graph, lexical, planning, retrieve
from .retrieve import top

HIT = "query_id long, match_kind string, source string, line_start long, line_end long, snippet string, score double, exact_symbol boolean, exact_path boolean, rank long"
_COLUMNS = [c.split()[0] for c in HIT.split(", ")]


@dataclass
class Bundle:
    """The tables of a stored corpus, as ``store.load`` reads them."""

    files: DataFrame  # rel_path, kb, suffix, text
    chunks: DataFrame  # source, kb, chunk_index, line_start, line_end, label, kind, text
    symbols: DataFrame  # source, kind, name, qualified_name, line_start, line_end, signature
    postings: DataFrame  # term, source, chunk_index, tf, length
    terms: DataFrame  # term, df
    corpus: DataFrame  # doc_count, avg_length: one row
    vectors: DataFrame  # source, chunk_index, embedding
    doc_edges: DataFrame  # src, dst, kind, priority, reason, rank
    nodes: DataFrame
    edges: DataFrame
    neighbors: DataFrame  # src, dst, kind, priority, reason, bridges, rank
    items: DataFrame
    pages: DataFrame  # relpath, kind, title, text, source_refs
    manifest: dict = field(default_factory=dict)


def hash_embedding(texts: list[str], size: int = 48) -> list[list[float]]:
    """Counts of hashed lower-case tokens, of length one: an embedding that needs no model and never changes."""
    out = []
    for text in texts:
        v = [0.0] * size
        for token in re.findall(r"[A-Za-z0-9_]+|[㐀-鿿]", (text or "").lower()):
            v[xxhash.xxh64_intdigest(token.encode()) % size] += 1.0
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        out.append([x / norm for x in v])
    return out


def embedded(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]] = hash_embedding, batch: int = 64, retries: int = 8) -> DataFrame:
    """``texts`` (.., text) with their embedding, in batches; a failing batch is tried again up to ``retries`` times, with doubling waits."""
    keys = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for rows in batches:
            vectors = []
            for at in range(0, len(rows), batch):
                for attempt in range(retries):
                    try:
                        vectors += embed(rows["text"].iloc[at : at + batch].tolist())
                        break
                    except Exception:
                        if attempt + 1 == retries:
                            raise
                        time.sleep(min(60.0, 0.05 * 2**attempt))
            yield rows[keys].assign(embedding=vectors)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema if f.name != "text")
    return texts.mapInPandas(run, f"{schema}, embedding array<float>")


def blocks(asked: DataFrame, conf: EngineConf = CONF) -> Iterator[DataFrame]:
    """The rows of a question-side table in broadcast blocks of about ``conf.block`` rows."""
    n = asked.count()
    parts = -(-n // conf.block)
    for k in range(parts):
        yield F.broadcast(asked if parts == 1 else asked.where(F.pmod(F.xxhash64(*asked.columns), F.lit(parts)) == k))


def _met(corpus: DataFrame, asked: DataFrame, condition: Column, conf: EngineConf) -> DataFrame:
    """Every row of the corpus beside every asked row that meets the condition."""
    out = None
    for block in blocks(graph.cut(asked), conf):
        found = corpus.join(block, condition)
        out = found if out is None else out.unionByName(found)
    return corpus.join(asked, F.lit(False)) if out is None else out


def scoped(hits: DataFrame, plan: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Hits (query_id, source, ..) of the question's kb and, for questions that ``allowed`` speaks of, of its sources."""
    own = hits.join(plan.select("query_id", F.col("kb").alias("asked_kb")), "query_id").where(F.col("asked_kb").isNull() | (T.kb_of(F.col("source")) == F.col("asked_kb"))).drop("asked_kb")
    return own if allowed is None else within(own, allowed)


def within(hits: DataFrame, allowed: DataFrame) -> DataFrame:
    """Hits of questions that ``allowed`` does not speak of, and of the others those of its sources."""
    bound = allowed.select("query_id").distinct().withColumn("bound", F.lit(True))
    inside = allowed.select("query_id", "source").distinct().withColumn("inside", F.lit(True))
    return hits.join(bound, "query_id", "left").join(inside, ["query_id", "source"], "left").where("bound is null or inside").drop("bound", "inside")


def _hits(df: DataFrame, kind: str, order: list) -> DataFrame:
    """Rows shaped as HIT, ranked in each question."""
    for name, value in (("exact_symbol", F.lit(False)), ("exact_path", F.lit(False)), ("line_start", F.lit(None)), ("line_end", F.lit(None))):
        if name not in df.columns:
            df = df.withColumn(name, value)
    ranked = df.withColumn("match_kind", F.lit(kind)).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    types = dict(c.split() for c in HIT.split(", "))
    return ranked.select(*[F.col(c).cast(types[c]).alias(c) for c in _COLUMNS])


def _regex(pattern: str) -> Column:
    """The regexes of a column of shell patterns, lower-cased; of the question side only."""

    def run(patterns: pd.Series) -> pd.Series:
        return patterns.map(lambda p: T.glob_regex(p.lower()))

    return F.pandas_udf(run, "string")(F.col(pattern))


def first_lines(text: Column, n: int = 3, most: int | None = None) -> Column:
    """The first n lines that are not blank, trimmed, cut at ``most`` characters."""
    joined = F.array_join(F.slice(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, n), "\n")
    return joined if most is None else F.substring(joined, 1, most)


def glob_hits(b: Bundle, plan: DataFrame, allowed: DataFrame | None = None, conf: EngineConf = CONF) -> DataFrame:
    """Files by the first pattern of a plan that their path or basename matches or holds; no limit."""
    asked = plan.select("query_id", F.posexplode("path_globs").alias("at", "pattern")).withColumn("bare", F.lower(F.regexp_replace("pattern", r"^\*+|\*+$", ""))).withColumn("regex", _regex("pattern"))
    files = b.files.select(F.col("rel_path").alias("source"), F.lower("rel_path").alias("path"), "text").withColumn("base", T.basename(F.col("path")))
    meets = F.expr("path rlike regex or base rlike regex or (bare <> '' and contains(path, bare))")
    met = _met(files.drop("text"), asked, meets, conf).groupBy("query_id", "source", "path", "base").agg(F.min(F.struct("at", "bare")).alias("p"))
    found = scoped(met, plan, allowed).join(files.select("source", "text"), "source")
    snippet = first_lines(F.col("text"))
    exact = (F.col("p.bare") == F.col("path")) | (F.col("p.bare") == F.col("base"))
    return _hits(found.withColumn("exact_path", exact).withColumn("snippet", F.when(snippet == "", F.col("source")).otherwise(snippet)).withColumn("score", F.lit(1.0)), "glob", ["source"])


def grep_hits(b: Bundle, plan: DataFrame, allowed: DataFrame | None = None, conf: EngineConf = CONF) -> DataFrame:
    """Lines that hold a keyword or symbol: the best keyword's score and 0.05 for each different one; with the lines around; no limit.

    Whole texts are held against the keywords; only files that hold one are split, and each row cuts its context from itself.
    """
    words = T.ordered_distinct(F.concat("keywords", "symbols"))
    asked = plan.select("query_id", F.col("kb").alias("asked_kb"), F.explode(words).alias("keyword")).withColumn("low", F.lower("keyword"))
    files = b.files.select(F.col("rel_path").alias("source"), "text").where("text is not null")
    in_kb = F.col("asked_kb").isNull() | (T.kb_of(F.col("source")) == F.col("asked_kb"))  # here, so that no text is shuffled for it
    met = _met(files, asked, in_kb & F.contains(F.lower("text"), F.col("low")), conf).drop("asked_kb")
    met = met if allowed is None else within(met, allowed)
    own = met.withColumn("lines", F.split("text", "\n", -1))
    places = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.contains(F.lower(F.get("lines", i)), F.col("low")))
    around = lambda i: F.array_join(F.slice("lines", F.greatest(i + 1 - conf.context_lines, F.lit(1)), F.least(i, F.lit(conf.context_lines)) + conf.context_lines + 1), "\n")
    line = own.select("query_id", "source", "keyword", F.explode(F.transform(places, lambda i: F.struct((i + 1).alias("no"), F.get("lines", i).alias("line"), around(i).alias("around")))).alias("h"))
    word = F.col("keyword").rlike("^[A-Za-z0-9_]+$") & F.expr(r"h.line rlike concat('(?iU)\\b', keyword, '\\b')")
    score = F.when(F.col("h.line") == F.col("keyword"), 1.2).when(word, 1.0).otherwise(0.75)
    found = line.withColumn("s", score).groupBy("query_id", "source", F.col("h.no").alias("line_start")).agg(F.max("s").alias("best"), F.count("*").alias("n"), F.min("h.around").alias("snippet"))
    shaped = found.withColumn("score", F.round(F.col("best") + 0.05 * F.col("n"), 6)).withColumn("exact_symbol", F.col("best") >= 1.0).withColumn("line_end", F.col("line_start"))
    return _hits(shaped, "grep", [F.desc("score"), "line_start", "source"])


def lines_of(text: Column, first: Column, last: Column) -> Column:
    """Lines first to last (from 1), kept inside the text."""
    lines = F.split(text, "\n", -1)
    start = F.greatest(F.least(first.cast("int"), F.size(lines)), F.lit(1))
    return F.array_join(F.slice(lines, start, F.greatest(F.least(last.cast("int"), F.size(lines)) - start + 1, F.lit(0))), "\n")


def symbol_score(name: Column, qualified: Column, term: Column) -> Column:
    """1.5 for the name or the qualified name, 1.4 for the last part of either, 0.9 inside of either, else 0; all in lower case."""
    last = lambda x: F.element_at(F.split(x, r"\."), -1)
    return F.when((name == term) | (qualified == term), 1.5).when((last(name) == term) | (last(qualified) == term), 1.4).when(F.contains(name, term) | F.contains(qualified, term), 0.9).otherwise(0.0)


def symbol_hits(b: Bundle, plan: DataFrame, allowed: DataFrame | None = None, conf: EngineConf = CONF, most: int = 120) -> DataFrame:
    """Symbols that a symbol or keyword of the plan names, with up to ``most`` of their lines; no limit."""
    asked = plan.select("query_id", F.explode(F.array_distinct(F.transform(F.concat("symbols", "keywords"), lambda x: F.regexp_replace(F.lower(x), r"[()]+$", "")))).alias("term")).where("term <> ''")
    known = b.symbols.select("source", F.lower("name").alias("low"), F.lower(F.coalesce("qualified_name", "name")).alias("qlow"), "line_start", "line_end", "kind")
    met = _met(known, asked, F.expr("contains(low, term) or contains(qlow, term)"), conf)
    score = symbol_score(F.col("low"), F.col("qlow"), F.col("term"))
    best = met.groupBy("query_id", "source", "low", "qlow", "line_start", "line_end", "kind").agg(F.max(score).alias("score"))
    own = scoped(best, plan, allowed).join(b.files.select(F.col("rel_path").alias("source"), "text"), "source")
    end = F.least("line_end", F.col("line_start") + (most - 1), F.size(F.split("text", "\n", -1)).cast("long"))
    found = own.withColumn("line_end", end).withColumn("snippet", F.trim(lines_of(F.col("text"), F.col("line_start"), F.col("line_end")))).where("snippet <> ''").withColumn("exact_symbol", F.col("score") >= 1.4)
    return _hits(found, "ast", [F.desc("score"), "line_start", "source", "qlow", "kind"])


def bm25_hits(b: Bundle, plan: DataFrame, k: int, allowed: DataFrame | None = None, conf: EngineConf = CONF) -> DataFrame:
    """The k best chunks of each plan from the stored postings: only the postings of asked terms are read on.

    Number, lengths and frequencies are those of the whole corpus, whatever the scope. Postings lie sorted by term, so the
    scan skips what no question asks for.
    """
    asked = graph.cut(planning.query_terms(plan))
    own = b.chunks.where("trim(text) <> ''").select("source", "chunk_index", "line_start", "line_end", F.col("text").alias("snippet"))
    held = lexical.held(asked)
    kbs = {r["query_id"]: r["kb"] for r in plan.where("kb is not null").select("query_id", "kb").limit(lexical.HELD_PAIRS).collect()} if held is not None and allowed is None else {}  # no more than questions that are held
    if held is None or allowed is not None:
        total = _bm25_joined(b, plan, asked, allowed, conf).join(own.select("source", "chunk_index"), ["source", "chunk_index"], "left_semi")
        best = top(total, ["query_id"], [F.desc("score"), "source", "chunk_index"], k, "nth")
        return _hits(best.join(own, ["source", "chunk_index"]), "bm25", ["nth"])
    place = sorted({t for a in held for t in a.terms})
    known = plan.sparkSession.createDataFrame([(t, i) for i, t in enumerate(place)], "term string, t int")
    one = b.corpus.first()
    df = {r["t"]: r["df"] for r in b.terms.join(F.broadcast(known), "term").select("t", "df").collect()}  # one row an asked term
    # a chunk's postings of asked terms become one row
    counts = b.postings.join(F.broadcast(known), "term").groupBy("source", "chunk_index").agg(F.max("length").alias("length"), F.array_sort(F.collect_list(F.struct("t", "tf"))).alias("x"))
    counts = counts.join(own.select("source", "chunk_index"), ["source", "chunk_index"], "left_semi")
    counts = counts.select("source", "chunk_index", T.kb_of(F.col("source")).alias("kb"), "length", F.col("x.t").alias("terms"), F.col("x.tf").alias("tfs"))
    scored = lexical.bm25_best(counts, ["source", "chunk_index"], held, place, df, one["doc_count"], one["avg_length"], k, kbs, conf)
    best = graph.cut(top(scored, ["query_id"], [F.desc("score"), "source", "chunk_index"], k, "nth"))
    return _hits(own.join(F.broadcast(best) if best.count() <= lexical.TERMS else best, ["source", "chunk_index"]), "bm25", ["nth"])


def _bm25_joined(b: Bundle, plan: DataFrame, asked: DataFrame, allowed: DataFrame | None, conf: EngineConf) -> DataFrame:
    """(query_id, source, chunk_index, score) of every chunk in scope that shares a term with a question."""
    found = None
    for block in blocks(asked.select("term").distinct(), conf):
        part = b.postings.join(block, "term")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = b.postings.limit(0)
    idf = F.log(1 + (F.col("doc_count") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (conf.k1 + 1) / (F.col("tf") + conf.k1 * (1 - conf.b + conf.b * F.col("length") / F.col("avg_length")))
    weighed = found.join(b.terms, "term").crossJoin(F.broadcast(b.corpus)).select("term", "source", "chunk_index", part.alias("part"))  # one row
    return scoped(asked.join(weighed, "term").groupBy("query_id", "source", "chunk_index").agg(F.round(F.sum("part"), 6).alias("score")), plan, allowed)


def vector_hits(b: Bundle, plan: DataFrame, k: int, allowed: DataFrame | None = None, embed: Callable = hash_embedding, conf: EngineConf = CONF) -> DataFrame:
    """The k nearest chunks by exact squared distance, score 1 / (1 + d).

    Of the max(4 k, 3 x sources in scope, 12) nearest of all, those in scope; if fewer than min(2, k) are, the nearest others of the question's kb follow.
    """
    asked = embedded(plan.select("query_id", F.col("semantic_query").alias("text")), embed).withColumnRenamed("embedding", "q")
    near = _met(b.vectors, asked, F.lit(True), conf).select("query_id", "source", "chunk_index", F.round(retrieve.squared_l2(F.col("embedding"), F.col("q")), 6).alias("d"))
    pairs = plan.select("query_id", "kb").join(F.broadcast(b.files.groupBy("kb").agg(F.count("*").alias("n")).withColumnRenamed("kb", "k2")), F.col("kb").isNull() | (F.col("kb") == F.col("k2")), "left")  # one row a kb
    count = pairs.groupBy("query_id", "kb").agg(F.sum("n").alias("n"))
    if allowed is not None:
        count = count.join(allowed.select("query_id", "source").distinct().groupBy("query_id").agg(F.count("*").alias("m")), "query_id", "left").withColumn("n", F.coalesce("m", "n"))
    bound = count.withColumn("restricted", F.col("kb").isNotNull() | (F.col("m").isNotNull() if allowed is not None else F.lit(False)))
    fetch = F.when(F.col("restricted"), F.greatest(F.lit(4 * k), 3 * F.coalesce("n", F.lit(0)), F.lit(12))).otherwise(F.greatest(F.lit(4 * k), F.lit(12)))
    order = Window.partitionBy("query_id").orderBy("d", "source", "chunk_index")
    first = near.withColumn("nth", F.row_number().over(order)).join(bound.select("query_id", fetch.alias("fetch")), "query_id").where("nth <= fetch")
    first = graph.cut(scoped(first.select("query_id", "source", "chunk_index", "d"), plan))
    inside = scoped(first, plan, allowed).withColumn("inside", F.lit(True))
    placed = first.join(inside.select("query_id", "source", "chunk_index", "inside"), ["query_id", "source", "chunk_index"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    placed = placed.withColumn("n_in", F.count_if("inside").over(Window.partitionBy("query_id"))).where(F.col("inside") | (F.col("n_in") < min(2, k)))
    best = top(placed, ["query_id"], [F.desc("inside"), "d", "source", "chunk_index"], k, "nth")
    own = b.chunks.select("source", "chunk_index", "line_start", "line_end", F.col("text").alias("snippet"))
    return _hits(best.join(own, ["source", "chunk_index"]).withColumn("score", 1 / (1 + F.greatest("d", F.lit(0.0)))), "vector", ["nth"])


def wiki_hits(b: Bundle, plan: DataFrame, allowed: DataFrame | None = None, k: int = 5, conf: EngineConf = CONF) -> DataFrame:
    """(query_id, relpath, kind, title, score, matched, source_refs, rank): the k best pages of each plan.

    A phrase (question, semantic query) in the text is worth 2, in a saved query 3; a token (symbol, keyword, pattern) 1, or 1.5 if
    the title holds it; a file page that a pattern fits, 1.5 once more. References count if they are in scope and, where the plan
    names sources, are among those; only the index may have none.
    """
    clean = lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"^\*+|\*+$", ""), r"^[.,:;!?()\[\]{}]+|[.,:;!?()\[\]{}]+$", "")
    tokens = F.filter(F.transform(F.concat("symbols", "keywords", "path_globs"), clean), lambda x: (F.length(x) >= 2) & ~F.lower(x).isin(*STOPWORDS))
    phrases = F.filter(F.array(F.trim("question"), F.trim("semantic_query")), lambda x: F.length(x) >= 2)
    listed = lambda items, phrase: F.transform(T.ordered_distinct(items), lambda x: F.struct(x.alias("needle"), F.lit(phrase).alias("phrase")))
    asked = plan.select("query_id", F.explode(F.concat(listed(phrases, True), listed(tokens, False))).alias("n")).select("query_id", "n.*").withColumn("low", F.lower("needle"))
    page = b.pages.select("relpath", "kind", "title", "text", "source_refs")
    met = _met(page.select("relpath", "kind", F.lower("title").alias("tlow"), F.lower("text").alias("xlow")), asked, F.contains(F.col("xlow"), F.col("low")), conf)
    value = F.when(F.col("phrase"), F.when(F.col("kind") == "query", 3.0).otherwise(2.0)).otherwise(F.when(F.contains("tlow", F.col("low")), 1.5).otherwise(1.0))
    said = met.groupBy("query_id", "relpath").agg(F.sum(value).alias("said"), F.array_sort(F.collect_set("needle")).alias("matched"))
    refs = page.select("relpath", "kind", F.explode("source_refs").alias("source"))
    globs = plan.select("query_id", F.explode("path_globs").alias("pattern")).withColumn("regex", _regex("pattern")).withColumn("bare", F.lower(F.regexp_replace("pattern", r"^\*+|\*+$", "")))
    named = F.filter(F.concat("keywords", "symbols"), lambda x: x.rlike(r"[*/\\]|^\.[^./]{1,7}$") | F.lower(x).rlike(r".\.(" + "|".join(planning.SUFFIXES + planning.BINARY) + ")$"))
    specific = plan.select("query_id", F.explode(F.transform(named, lambda x: F.lower(x))).alias("bare")).withColumn("regex", F.lit("(?!)")).unionByName(globs.where(~F.col("bare").rlike(r"^\.[^./\\]*$")).select("query_id", "bare", "regex"))
    known = refs.select("source").distinct().withColumn("path", F.lower("source")).withColumn("base", T.basename(F.col("path")))
    fits = graph.cut(_met(known, specific, F.expr("path rlike regex or base rlike regex or (bare <> '' and contains(path, bare))"), conf).select("query_id", "source").distinct())
    picky = specific.select("query_id").distinct().withColumn("picky", F.lit(True))
    hit = said.select("query_id", "relpath").unionByName(graph.cut(_met(refs.where("kind = 'file'").select("relpath", F.lower("source").alias("path")).withColumn("base", T.basename(F.col("path"))), globs, F.expr("path rlike regex or base rlike regex"), conf).select("query_id", "relpath"))).distinct()
    scoped_refs = scoped(hit.join(refs, "relpath"), plan, allowed)
    scoped_refs = scoped_refs.join(picky, "query_id", "left").join(fits.withColumn("fits", F.lit(True)), ["query_id", "source"], "left").where("picky is null or fits")
    good = scoped_refs.groupBy("query_id", "relpath").agg(F.array_sort(F.collect_set("source")).alias("source_refs"))
    bonus = _met(refs.where("kind = 'file'").select("relpath", F.lower("source").alias("path")).withColumn("base", T.basename(F.col("path"))), globs, F.expr("path rlike regex or base rlike regex"), conf).groupBy("query_id", "relpath").agg(F.min("pattern").alias("pattern"))
    every = hit.join(page.select("relpath", "kind", "title"), "relpath").join(said, ["query_id", "relpath"], "left").join(good, ["query_id", "relpath"], "left").join(bonus, ["query_id", "relpath"], "left")
    every = every.where(F.col("source_refs").isNotNull() | (F.col("kind") == "index"))
    score = F.round(F.coalesce("said", F.lit(0.0)) + F.when(F.col("pattern").isNotNull() & F.col("source_refs").isNotNull(), 1.5).otherwise(0.0), 3)
    priority = F.coalesce(F.create_map(*[x for name, p in PAGE_PRIORITY.items() for x in (F.lit(name), F.lit(p))])[F.col("kind")], F.lit(0))
    none = F.array().cast("array<string>")
    ranked = every.withColumn("score", score).where("score > 0").withColumn("source_refs", F.coalesce("source_refs", none)).withColumn("matched", F.concat(F.coalesce("matched", none), F.array_compact(F.array("pattern"))))
    return top(ranked.withColumn("p", priority), ["query_id"], [F.desc("score"), F.desc("p"), F.size("source_refs"), "relpath"], k).select("query_id", "relpath", "kind", "title", "score", "matched", "source_refs", "rank")


# ---- fusion and lists

def identity() -> Column:
    """What makes two hits the same: source, lines and the snippet with its white space folded, case ignored."""
    return F.sha2(F.to_json(F.struct("source", F.coalesce("line_start", F.lit(-1)).alias("a"), F.coalesce("line_end", F.lit(-1)).alias("b"), F.lower(F.trim(F.regexp_replace("snippet", r"\s+", " "))).alias("s"))), 256)


def fused(hits: DataFrame, k: int, conf: EngineConf = CONF) -> DataFrame:
    """HIT rows: the k best of each question by weighted reciprocal ranks, shown as their most telling kind found them."""
    keyed = graph.cut(hits.withColumn("key", identity()))
    best = retrieve.fuse(keyed, k, conf).select("query_id", "key", F.col("score").alias("fused"), F.col("rank").alias("place"))
    priority = F.create_map(*[x for kind, p in conf.priorities.items() for x in (F.lit(kind), F.lit(p))])[F.col("match_kind")]
    shown = top(keyed.join(best, ["query_id", "key"]), ["query_id", "key"], [priority.desc(), "rank"], 1, "one")
    flags = keyed.groupBy("query_id", "key").agg(F.max("exact_symbol").alias("any_symbol"), F.max("exact_path").alias("any_path"))
    return shown.join(flags, ["query_id", "key"]).select("query_id", "match_kind", "source", "line_start", "line_end", "snippet", F.col("fused").alias("score"), F.col("any_symbol").alias("exact_symbol"), F.col("any_path").alias("exact_path"), F.col("place").cast("long").alias("rank"))


def merge_lists(primary: DataFrame, secondary: DataFrame, limit: int) -> DataFrame:
    """Hits of the first list, then those of the second that it lacks, up to ``limit`` of each question and kind."""
    both = primary.withColumn("list", F.lit(0)).unionByName(secondary.withColumn("list", F.lit(1))).withColumn("key", identity()).withColumnRenamed("rank", "old")
    first = top(both, ["query_id", "match_kind", "key"], ["list", "old"], 1, "one")
    return top(first, ["query_id", "match_kind"], ["list", "old", "key"], limit).select(*[F.col(c).cast("long").alias(c) if c == "rank" else F.col(c) for c in _COLUMNS])


def merge_steps(steps: list[DataFrame]) -> DataFrame:
    """Hits of several steps as one list a kind: the ranks of a later step go on where the one before ended."""
    every = None
    for n, hits in enumerate(steps):
        own = hits.withColumn("step", F.lit(n))
        every = own if every is None else every.unionByName(own)
    place = F.row_number().over(Window.partitionBy("query_id", "match_kind").orderBy("step", "rank"))
    return every.withColumn("rank", place.cast("long")).select(*_COLUMNS)


def candidate_sources(hits: DataFrame, first: int | None = None) -> DataFrame:
    """(query_id, source, ord): sources of the hits (of the first ``first`` of each kind), each once, by their best place."""
    own = hits if first is None else hits.where(F.col("rank") <= first)
    return own.groupBy("query_id", "source").agg(F.min(F.struct("rank", "match_kind")).alias("o")).select("query_id", "source", F.row_number().over(Window.partitionBy("query_id").orderBy("o", "source")).alias("ord"))


def sources_of(hits: DataFrame, most: int = 240) -> DataFrame:
    """(query_id, source, line_start, line_end, place, match_kind, snippet, rank): where hits stand, each place once, snippets cut."""
    one = top(hits, ["query_id", "source", "line_start", "line_end"], ["rank"], 1, "one")
    cut = F.when(F.length("snippet") > most, F.concat(F.substring("snippet", 1, most), F.lit("..."))).otherwise(F.col("snippet"))
    return one.select("query_id", "source", "line_start", "line_end", T.line_label(F.col("line_start"), F.col("line_end")).alias("place"), "match_kind", cut.alias("snippet"), "rank")


def contexts(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, context): the hits of each question as numbered evidence; a fixed sentence where there is none."""
    place = T.line_label(F.col("line_start"), F.col("line_end"))
    block = F.concat(F.lit("[证据"), "rank", F.lit("] "), "source", F.when(place == "", "").otherwise(F.concat(F.lit(":"), place)), F.lit("\n"), "snippet")
    own = hits.select("query_id", "rank", block.alias("b")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "b"))).alias("bs"))  # top_k of each question
    joined = F.array_join(F.transform("bs", lambda x: x["b"]), "\n\n")
    return questions.select("query_id").join(own, "query_id", "left").select("query_id", F.coalesce(joined, F.lit("未找到直接匹配的参考资料。")).alias("context"))


# ---- reranking

def json_blob(text: str) -> dict:
    """The JSON object in a model's answer, with or without a code fence around it; ValueError if there is none."""
    start, end = text.find("{"), text.rfind("}")
    if start < 0 or end < start:
        raise ValueError("no JSON object in the answer")
    found = json.loads(text[start : end + 1])
    if not isinstance(found, dict):
        raise ValueError("the answer is no JSON object")
    return found


def rankings(text: str, n: int) -> list[tuple[int, float, bool]]:
    """(index, score, relevant) of a model's answer; indexes outside 0..n-1 are dropped, a missing ``relevant`` is true."""
    listed = json_blob(text).get("rankings")
    if not isinstance(listed, list):
        raise ValueError("no rankings in the answer")
    out = []
    for x in listed:
        try:
            index = int(x["index"])
        except (KeyError, TypeError, ValueError):
            continue
        try:
            score = float(x.get("score", 0.0))
        except (TypeError, ValueError):
            score = 0.0
        said = x.get("relevant", True)
        if 0 <= index < n:
            out.append((index, score, str(said).strip().lower() not in ("false", "0", "no") if isinstance(said, str) else bool(said)))
    return out


def reranked(hits: DataFrame, questions: DataFrame, keep: int, model: Callable[[str], str] | None, conf: EngineConf = CONF) -> tuple[DataFrame, DataFrame]:
    """(HIT rows in the model's order, (query_id, status)): relevant ones by score, then those it said nothing of, then the others.

    ``model`` takes a prompt and answers with rankings of the first ``rerank_pool`` hits; what lies behind them keeps its
    place. Without a model (disabled), without hits (no_hits) or if it fails or ranks nothing (fallback), the order stays.
    """
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.substring("snippet", 1, conf.rerank_chars).alias("snippet"), "source"))).alias("hits"))  # top_k of each question
    asked = questions.select("query_id", F.col("text").alias("question")).join(listed, "query_id", "left").select("query_id", "question", F.coalesce(F.to_json("hits"), F.lit("[]")).alias("hits"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for query_id, question, text in zip(batch["query_id"], batch["question"], batch["hits"]):
                own = json.loads(text)
                pool, found, status = own[: conf.rerank_pool], [], "ok" if own else "no_hits"
                if model is None:
                    status = "disabled" if own else status
                elif own:
                    prompt = f"Question: {question}\n" + "\n".join(f"[{i}] {h['source']}\n{h['snippet']}" for i, h in enumerate(pool)) + '\nAnswer with {"rankings": [{"index": 0, "score": 1.0, "relevant": true}]}'
                    try:
                        found = rankings(model(prompt), len(pool))
                    except Exception:  # whatever a model's client raises: the order stays
                        found = []
                    status = "ok" if found else "fallback"
                first: dict[int, tuple[float, bool]] = {}
                for index, score, good in sorted(found, key=lambda x: -x[1]):
                    first.setdefault(index, (score, good))
                order = [i for i, (_, good) in first.items() if good] + [i for i in range(len(pool)) if i not in first] + [i for i, (_, good) in first.items() if not good] + list(range(len(pool), len(own)))
                rows += [(query_id, own[i]["rank"], place + 1, status) for place, i in enumerate(order)] or [(query_id, None, None, status)]
            yield pd.DataFrame(rows, columns=["query_id", "rank", "place", "status"]).astype({"rank": "Int64", "place": "Int64"})

    placed = graph.cut(asked.mapInPandas(run, "query_id long, rank long, place long, status string"))
    moved = hits.join(placed.where("place is not null").select("query_id", "rank", "place"), ["query_id", "rank"]).where(F.col("place") <= keep)
    return moved.select(*[F.col("place").alias("rank") if c == "rank" else F.col(c) for c in _COLUMNS]), placed.select("query_id", "status").distinct()
