"""Communities of files: components of strong edges, what stands out in them, hubs and bridges, and a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..conf import STRONG
from ..functions import text as T
from . import entity, graph
from .retrieve import top


def members(files: DataFrame, relations: DataFrame) -> DataFrame:
    """(rel_path, community, size): components along strong relations; files without any are communities of one.

    Communities are numbered from 1 by falling size, then by their first file; the numbering sorts one row a community.
    """
    strong = relations.where(F.col("kind").isin(*STRONG)).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    parts = graph.components(strong)
    own = files.select("rel_path").distinct().join(parts, F.col("rel_path") == F.col("node"), "left").select("rel_path", F.coalesce("component", "rel_path").alias("first"))
    sizes = own.groupBy("first").agg(F.count("*").alias("size"))
    numbered = sizes.withColumn("community", F.row_number().over(Window.orderBy(F.desc("size"), "first")).cast("long"))
    return own.join(numbered, "first").select("rel_path", "community", "size")


def degrees(relations: DataFrame) -> DataFrame:
    """(src, dst): who relates to whom, either way, each once."""
    pair = relations.select("src", "dst").where("src <> dst")
    return pair.unionByName(pair.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def top_files(member: DataFrame, relations: DataFrame, k: int = 5) -> DataFrame:
    """(community, rel_path, degree, rank): by the number of different neighbours inside the community, then by name."""
    other = member.select(F.col("rel_path").alias("dst"), F.col("community").alias("theirs"))
    both = degrees(relations).join(member.select(F.col("rel_path").alias("src"), "community"), "src").join(other, "dst").where("community = theirs")
    degree = both.groupBy("src").agg(F.count("*").alias("degree")).withColumnRenamed("src", "rel_path")
    every = member.select("rel_path", "community").join(degree, "rel_path", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))
    return top(every, ["community"], [F.desc("degree"), "rel_path"], k)


def top_symbols(member: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """(community, name, source, score, rank): symbols (no modules or imports) by the number of edges that touch them."""
    symbols = nodes.where("type = 'symbol' and symbol_kind not in ('module', 'import')").select("id", F.coalesce("qualified_name", "name").alias("name"), "source")
    touched = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id"))).groupBy("id").agg(F.count("*").alias("score"))
    found = symbols.join(touched, "id").join(member.select(F.col("rel_path").alias("source"), "community"), "source")
    return top(found, ["community"], [F.desc("score"), "name", "source"], k).select("community", "name", "source", "score", "rank")


def top_topics(member: DataFrame, nodes: DataFrame, edges: DataFrame, most: dict[str, int] | None = None) -> DataFrame:
    """(community, type, id, name, file_count, score, rank): concepts, decisions and notes by 100 x files here + edges."""
    most = most or {"concept": 5, "decision": 5, "query_note": 3}
    attached = entity.attachments(nodes, edges).join(member.select(F.col("rel_path").alias("file"), "community"), "file").groupBy("node", "community").agg(F.count("*").alias("file_count"))
    touched = edges.select(F.col("source").alias("node")).unionByName(edges.select(F.col("target").alias("node"))).groupBy("node").agg(F.count("*").alias("n_edges"))
    named = nodes.select(F.col("id").alias("node"), "type", "name")
    found = attached.join(touched, "node").join(named, "node").withColumn("score", 100 * F.col("file_count") + F.col("n_edges"))
    ranked = top(found, ["community", "type"], [F.desc("score"), "name", "node"], max(most.values()))
    bound = F.create_map(*[x for k, v in most.items() for x in (F.lit(k), F.lit(v))])
    return ranked.where(F.col("rank") <= bound[F.col("type")]).select("community", "type", F.col("node").alias("id"), "name", "file_count", "score", "rank")


def god_nodes(relations: DataFrame, k: int = 8) -> DataFrame:
    """(rel_path, degree): the files with most neighbours."""
    return degrees(relations).groupBy(F.col("src").alias("rel_path")).agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "rel_path").limit(k)


def bridges(member: DataFrame, relations: DataFrame, k: int = 20) -> DataFrame:
    """(src, dst, kind, reason, src_community, dst_community): relations between communities, the strongest kinds first."""
    own = member.select(F.col("rel_path").alias("src"), F.col("community").alias("src_community"))
    other = member.select(F.col("rel_path").alias("dst"), F.col("community").alias("dst_community"))
    across = relations.select("src", "dst", "kind", "reason").distinct().join(own, "src").join(other, "dst").where("src_community <> dst_community")
    order = (entity._priority(F.col("kind")), "src_community", "dst_community", "src", "dst", "reason")
    return across.orderBy(*order).limit(k)


def semantic_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: how many concepts, decisions, notes, semantic and rationale edges there are."""
    n = nodes.agg(*[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in ("concept", "decision", "query_note")])
    e = edges.agg(*[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in ("semantically_related", "rationale_for")])
    return n.crossJoin(F.broadcast(e))  # one row each


def summaries(member: DataFrame, files_top: DataFrame, symbols_top: DataFrame, topics_top: DataFrame) -> DataFrame:
    """(community, label, size, kbs, top_files, top_symbols, top_concepts, top_decisions, top_notes, suggested): one row a community.

    The label is the first concept, else the first symbol, else the first file's name, else the number.
    """
    listed = lambda df, name, what: df.groupBy("community").agg(F.array_sort(F.collect_list(F.struct("rank", F.col(what).alias("x")))).alias(name)).withColumn(name, F.transform(name, lambda s: s["x"]))  # noqa: E731  at most k of each
    base = member.groupBy("community", "size").agg(F.array_sort(F.collect_set(T.kb_of(F.col("rel_path")))).alias("kbs"))
    out = base.join(listed(files_top, "top_files", "rel_path"), "community", "left").join(listed(symbols_top, "top_symbols", "name"), "community", "left")
    for kind, name in (("concept", "top_concepts"), ("decision", "top_decisions"), ("query_note", "top_notes")):
        out = out.join(listed(topics_top.where(F.col("type") == kind), name, "name"), "community", "left")
    none = F.array().cast("array<string>")
    for name in ("top_files", "top_symbols", "top_concepts", "top_decisions", "top_notes"):
        out = out.withColumn(name, F.coalesce(name, none))
    first = lambda name: F.get(name, F.lit(0))
    label = F.coalesce(first("top_concepts"), first("top_symbols"), T.basename(first("top_files")), F.concat(F.lit("community "), "community"))
    asks = F.concat(
        F.transform("top_notes", lambda x: x), F.transform("top_concepts", lambda x: F.concat(F.lit("What is "), x, F.lit("?"))), F.transform("top_decisions", lambda x: F.concat(F.lit("Why "), x, F.lit("?"))),
        F.transform("top_symbols", lambda x: F.concat(F.lit("Where is `"), x, F.lit("` used?"))), F.transform("top_files", lambda x: F.concat(F.lit("What does "), T.basename(x), F.lit(" cover?"))),
    )
    return out.withColumn("label", label).withColumn("suggested", F.slice(asks, 1, 3))


def report(summary: DataFrame, gods: DataFrame, across: DataFrame, counts: DataFrame, k: int = 50) -> str:
    """A Markdown report of the k largest communities, the hubs and the bridges. Only these bounded rows reach the driver."""
    c = counts.first()
    out = ["# Graph report", "", f"Concepts: {c['n_concept']}; decisions: {c['n_decision']}; notes: {c['n_query_note']}", "", "## Communities"]
    for r in summary.orderBy("community").limit(k).collect():
        out += ["", f"### {r['community']:03d} {r['label']}", f"- files: {r['size']} ({', '.join(x for x in r['kbs'] if x) or 'no knowledge base'})"]
        out += [f"- {name.replace('_', ' ')}: {', '.join(r[name])}" for name in ("top_files", "top_symbols", "top_concepts", "top_decisions", "suggested") if r[name]]
    out += ["", "## Hubs", *[f"- {r['rel_path']} ({r['degree']})" for r in gods.collect()], "", "## Bridges"]
    out += [f"- {r['src']} -> {r['dst']} ({r['kind']})" for r in across.collect()]
    return "\n".join(out) + "\n"
