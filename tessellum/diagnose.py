"""What a stored corpus looks like and how well it answers: audits, probes and a verdict."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import engine, store
from .conf import STOPWORDS
from .operators import chunk, graph, search
from .operators.search import Bundle


def audit_tables(spark: SparkSession, root: str) -> DataFrame:
    """(table, exists, n): every table that a build should have."""
    place = store.current(spark, root)
    rows = []
    for name in store.SCHEMAS:
        there = bool(place) and store.exists(spark, f"{place}/{name}")
        rows.append((name, there, spark.read.parquet(f"{place}/{name}").count() if there else 0))
    return spark.createDataFrame(rows, "table string, exists boolean, n long")


def audit_tokens(extracted: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """((status, n, total_tokens), the k sources with most tokens and their share of all) of extracted sections (id, status, total_tokens)."""
    from .operators import entity

    by_source = extracted.groupBy(F.regexp_extract("id", r"^section:(.*):\d+$", 1).alias("source")).agg(F.sum("total_tokens").alias("total_tokens"))
    total = by_source.agg(F.sum("total_tokens").alias("all"))
    shared = by_source.crossJoin(F.broadcast(total)).select("source", "total_tokens", (F.col("total_tokens") / F.nullif("all", F.lit(0))).alias("share"))  # one row
    return entity.extraction_stats(extracted), shared.orderBy(F.desc("total_tokens"), "source").limit(k)


def audit_manifest(manifest: DataFrame) -> DataFrame:
    """One row: files, chunks, truncated files, and low, middle, p90 and high of chunks a file."""
    counts = chunk.percentiles(manifest.select(F.col("chunks").alias("n")))
    totals = manifest.agg(F.count("*").alias("files"), F.sum("chunks").alias("chunks"), F.count_if("truncated").alias("truncated"))
    return totals.crossJoin(F.broadcast(counts))  # one row each


def red_flags(manifest: DataFrame, chunks: DataFrame, k: int = 15) -> DataFrame:
    """(flag, name, value): up to k files each with many tiny chunks, with one chunk of a large file, with nothing but unlabelled chunks."""
    tiny = manifest.where((F.col("chunks") > 50) & (F.col("size_kb") / F.col("chunks") < 2)).select(F.lit("many_tiny_chunks").alias("flag"), "name", F.col("chunks").cast("double").alias("value"))
    lone = manifest.where((F.col("chunks") == 1) & (F.col("size_kb") > 50)).select(F.lit("one_large_chunk").alias("flag"), "name", F.col("size_kb").alias("value"))
    plain = chunks.groupBy(F.col("source").alias("name")).agg(F.bool_and(F.col("kind").isin("", "chunk")).alias("all"), F.count("*").cast("double").alias("value")).where("all").select(F.lit("all_generic").alias("flag"), "name", "value")
    every = tiny.unionByName(lone).unionByName(plain)
    rank = F.row_number().over(Window.partitionBy("flag").orderBy(F.desc("value"), "name"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def auto_probes(b: Bundle, n: int, seed: int = 0) -> DataFrame:
    """(query_id, text, kind, expected): n questions with known answers: two fifths file stems of the largest files, two fifths symbols, the rest headings.

    Symbols and headings are drawn by a seeded hash, so the same seed gives the same probes.
    """
    n_file = n_symbol = max(1, int(0.4 * n))
    order = F.xxhash64(F.lit(seed), "text", "expected")
    stem = graph.stem(F.col("rel_path"))
    files = b.files.select(stem.alias("text"), F.col("rel_path").alias("expected"), F.length("text").alias("size")).where((F.length("text") >= 4) & ~F.col("text").isin(*STOPWORDS))
    files = files.groupBy("text").agg(F.max_by("expected", "size").alias("expected"), F.max("size").alias("size")).orderBy(F.desc("size"), "text").limit(n_file).select("text", F.lit("filename").alias("kind"), "expected")
    symbols = b.symbols.where("kind in ('class', 'function') and length(name) >= 5").groupBy(F.col("name").alias("text")).agg(F.min("source").alias("expected")).orderBy(order, "text").limit(n_symbol).select("text", F.lit("symbol").alias("kind"), "expected")
    heading = F.trim(F.regexp_replace(F.regexp_extract("text", r"(?m)^\s{0,3}#{1,6}\s+(.+)$", 1), r"#+\s*$", ""))
    heads = b.files.where("suffix in ('md', 'markdown')").select(heading.alias("text"), F.col("rel_path").alias("expected")).where("text <> ''").orderBy(order, "text").limit(max(0, n - n_file - n_symbol)).select("text", F.lit("heading").alias("kind"), "expected")
    every = files.unionByName(symbols).unionByName(heads)
    return every.withColumn("query_id", F.row_number().over(Window.orderBy("kind", "text", "expected")).cast("long"))  # n rows


def user_probes(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text, kind, expected) of a JSON list of {question, expected_source}; blank questions are dropped."""
    raw = spark.read.schema("question string, expected_source string").option("multiLine", True).json(path)
    kept = raw.where("trim(question) <> ''").select(F.trim("question").alias("text"), F.lit("user").alias("kind"), F.col("expected_source").alias("expected"))
    return kept.withColumn("query_id", F.row_number().over(Window.orderBy("text", "expected")).cast("long"))  # a list that somebody wrote


def run_probes(b: Bundle, probes: DataFrame, modes: tuple[str, ...] = engine.MODES, k: int = 10, **options) -> DataFrame:
    """(mode, query_id, kind, expected_rank, n_hits, flagged, overlap): how each mode answers each probe.

    expected_rank: the first hit of the expected source, or null; flagged: hits whose snippet is empty, under 60 characters or
    without a word of the question; overlap: Jaccard of the sources with those of hybrid.
    """
    out = []
    found = {mode: graph.cut(engine.retrieve(b, probes.select("query_id", "text"), mode, k, **options).hits) for mode in dict.fromkeys((*modes, "hybrid"))}
    base = found["hybrid"].groupBy("query_id").agg(F.collect_set("source").alias("base"))  # k of each question
    for mode in modes:
        hits = probes.join(found[mode].select("query_id", "source", "snippet", "rank"), "query_id", "left")
        word = F.exists(F.split(F.lower("text"), r"\W+"), lambda w: (w != "") & F.contains(F.lower("snippet"), w))
        bad = F.col("source").isNotNull() & ((F.trim("snippet") == "") | (F.length("snippet") < 60) | ~word)
        each = hits.groupBy("query_id", "kind").agg(F.min(F.when(F.col("source") == F.col("expected"), F.col("rank"))).alias("expected_rank"), F.count("source").alias("n_hits"), F.count_if(bad).alias("flagged"), F.collect_set("source").alias("own"))
        both = each.join(base, "query_id", "left").withColumn("base", F.coalesce("base", F.array().cast("array<string>")))
        union = F.size(F.array_union("own", "base"))
        overlap = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("own", "base")) / union)
        out.append(both.select(F.lit(mode).alias("mode"), "query_id", "kind", "expected_rank", "n_hits", "flagged", F.round(overlap, 6).alias("overlap")))
    return engine._union(out)


def recall(results: DataFrame) -> DataFrame:
    """(mode, kind, n, found, recall): how many probes were answered by their source."""
    return results.groupBy("mode", "kind").agg(F.count("*").alias("n"), F.count("expected_rank").alias("found")).withColumn("recall", F.col("found") / F.col("n"))


def verdict(tables: DataFrame, top_tokens: DataFrame | None, results: DataFrame | None, stale_share: float = 0.0) -> list[str]:
    """Plain sentences on what is amiss: missing tables, tokens gathered in five files, stale cache, probes that all modes miss, poor snippets."""
    out = []
    missing = [r["table"] for r in tables.where("not exists").collect()]
    if missing:
        out.append(f"missing tables: {', '.join(missing)}")
    if top_tokens is not None:
        share = sum(r["share"] or 0.0 for r in top_tokens.orderBy(F.desc("total_tokens")).limit(5).collect())
        if share > 0.5:
            out.append(f"five files take {share:.0%} of the tokens")
    if stale_share > 0.2:
        out.append(f"{stale_share:.0%} of the cached extractions are stale")
    if results is not None:
        lost = results.groupBy("query_id", "kind").agg(F.count("expected_rank").alias("n")).where("n = 0").groupBy("kind").agg(F.count("*").alias("n"))
        out += [f"{r['n']} {r['kind']} probes are missed by every mode" for r in lost.orderBy("kind").collect()]
        hits = results.agg(F.sum("flagged").alias("bad"), F.sum("n_hits").alias("n")).first()
        if hits["n"] and hits["bad"] / hits["n"] > 0.3:
            out.append(f"{hits['bad']} of {hits['n']} snippets are poor")
    return out or ["nothing to report"]


def render(tables: DataFrame, results: DataFrame | None, lines: list[str]) -> str:
    """A short report for people."""
    out = ["tables:", *[f"  {r['table']}: {r['n'] if r['exists'] else 'missing'}" for r in tables.orderBy("table").collect()]]
    if results is not None:
        out += ["recall:", *[f"  {r['mode']} {r['kind']}: {r['found']}/{r['n']}" for r in recall(results).orderBy("mode", "kind").collect()]]
    return "\n".join([*out, "verdict:", *[f"  {x}" for x in lines]])


def diagnose(spark: SparkSession, root: str, n: int = 10, model: Callable | None = None) -> str:
    """Audits the current build, probes it and says what is amiss."""
    b = store.load(spark, root)
    tables = audit_tables(spark, root)
    results = graph.cut(run_probes(b, graph.cut(auto_probes(b, n)), model=model))
    return render(tables, results, verdict(tables, None, results))


__all__ = ["search", "audit_tables", "audit_tokens", "audit_manifest", "red_flags", "auto_probes", "user_probes", "run_probes", "recall", "verdict", "render", "diagnose"]
