"""The entity graph of a corpus: files, sections, symbols, concepts, decisions and saved notes, with typed edges between them.

Nodes and edges are two wide tables, built by projections and equi-joins: no node's neighbours are ever gathered.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..conf import ATTACHED, CONF, EXPANSION_PRIORITY, INFERRED, OTHER_PRIORITY, EngineConf
from ..functions import text as T
from . import graph

NODE = "id string, type string, name string, source string, kb string, chunk_index long, line_start long, line_end long, qualified_name string, symbol_kind string, signature string, aliases array<string>, summary string, note_path string, created_at string, tags array<string>, confidence string"
EDGE = "source string, target string, type string, confidence string, evidence_source string, line_start long, line_end long, reason string"


def _shaped(df: DataFrame, schema: str) -> DataFrame:
    """The columns of ``schema`` in its order; those that ``df`` lacks are null."""
    fields = [f.split(" ", 1) for f in schema.split(", ")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])


def file_id(source: Column) -> Column:
    return F.concat(F.lit("file:"), source)


def section_id(source: Column, chunk_index: Column) -> Column:
    return F.concat_ws(":", F.lit("section"), source, chunk_index)


def symbol_id() -> Column:
    return F.concat_ws(":", F.lit("symbol"), "source", "kind", F.coalesce("qualified_name", "name"), "line_start")


def semantic_id(kind: Column, name: Column) -> Column:
    """type:slug:first twelve digits of the SHA-1 of the lower-cased name, so that C, C# and C++ stay apart."""
    low = F.lower(F.trim(name))
    slug = F.regexp_replace(F.regexp_replace(low, r"(?U)[^\w]+", "-"), "^-+|-+$", "")
    return F.concat_ws(":", kind, F.when(slug == "", F.lit("item")).otherwise(slug), F.substring(F.sha1(low.cast("binary")), 1, 12))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Edges without blank ends and loops, each once; the kinds that are guesses are marked INFERRED."""
    kept = edges.where("source <> '' and target <> '' and source <> target")
    marked = kept.withColumn("confidence", F.when(F.col("type").isin(*INFERRED), "INFERRED").otherwise("EXTRACTED"))
    return _shaped(marked, EDGE).dropDuplicates()


def distinct_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each id: the one of least place in the order of its other columns."""
    order = Window.partitionBy("id").orderBy("type", "source", "line_start", "name")
    return nodes.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def structural_nodes(files: DataFrame, chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Nodes of files (rel_path), sections (chunks: source, chunk_index, label, line_start, line_end) and symbols."""
    file = files.select(file_id(F.col("rel_path")).alias("id"), F.lit("file").alias("type"), T.basename(F.col("rel_path")).alias("name"), F.col("rel_path").alias("source"), T.kb_of(F.col("rel_path")).alias("kb"))
    label = F.coalesce(F.nullif("label", F.lit("")), F.concat(F.lit("chunk "), F.col("chunk_index") + 1))
    section = chunks.select(section_id(F.col("source"), F.col("chunk_index")).alias("id"), F.lit("section").alias("type"), label.alias("name"), "source", T.kb_of(F.col("source")).alias("kb"), "chunk_index", "line_start", "line_end")
    symbol = symbols.select(symbol_id().alias("id"), F.lit("symbol").alias("type"), "name", "source", T.kb_of(F.col("source")).alias("kb"), "line_start", "line_end", F.coalesce("qualified_name", "name").alias("qualified_name"), F.col("kind").alias("symbol_kind"), "signature")
    every = [_shaped(df.withColumn("confidence", F.lit("EXTRACTED")), NODE) for df in (file, section, symbol)]
    return distinct_nodes(every[0].unionByName(every[1]).unionByName(every[2]))


def contained(nodes: DataFrame) -> DataFrame:
    """file contains section, file defines symbol, section contains symbol (one that starts in it and is no module)."""
    own = nodes.where("type in ('section', 'symbol')")
    first = own.select(
        file_id(F.col("source")).alias("source"), F.col("id").alias("target"), F.when(F.col("type") == "section", "contains").otherwise("defines").alias("type"),
        F.col("source").alias("evidence_source"), "line_start", "line_end", F.coalesce("qualified_name", "name").alias("reason"),
    )
    sections = nodes.where("type = 'section'").select("source", F.col("id").alias("section"), F.col("line_start").alias("first"), F.col("line_end").alias("last"), "name")
    symbols = nodes.where("type = 'symbol' and symbol_kind <> 'module'").select("source", F.col("id").alias("symbol"), F.col("line_start").alias("line"))
    inside = graph.range_contains(sections, symbols).select(
        F.col("section").alias("source"), F.col("symbol").alias("target"), F.lit("contains").alias("type"), F.col("source").alias("evidence_source"), F.col("first").alias("line_start"), F.col("last").alias("line_end"), F.col("name").alias("reason")
    )
    return first.unionByName(inside)


def section_paths(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Edges from sections to the files that their texts link to or mention."""
    asked = graph.references(chunks, ["source", "chunk_index", "line_start", "line_end"])
    found = graph.resolve(asked, files).where("target is not null")
    return found.select(section_id(F.col("source"), F.col("chunk_index")).alias("source"), file_id(F.col("target")).alias("target"), F.col("kind").alias("type"), F.col("source").alias("evidence_source"), "line_start", "line_end", F.col("reference").alias("reason"))


def symbol_references(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges from sections to the symbols that their code spans and calls name: unique in the file, else in its kb, else at all.

    Modules count only where nothing else has the name.
    """
    spans = F.concat(F.regexp_extract_all("text", F.lit(T.CODE_SPAN), F.lit(1)), F.regexp_extract_all("text", F.lit(T.CALL), F.lit(1)))
    said = chunks.select("source", "chunk_index", "line_start", "line_end", F.posexplode(spans).alias("at", "token"))
    said = said.groupBy("source", "chunk_index", "line_start", "line_end", F.lower("token").alias("name")).agg(F.min_by("token", "at").alias("token"))
    asked = said.select("source", T.kb_of(F.col("source")).alias("kb"), "name").distinct()
    own = nodes.where("type = 'symbol'").select(F.col("id").alias("target"), F.col("source").alias("t_source"), F.col("kb").alias("t_kb"), (F.col("symbol_kind") == "module").alias("module"), F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("qualified_name")))).alias("name"))
    found = None
    for modules in (False, True):  # first what is no module, then, in scopes without any, modules
        tier = graph.tiered(asked, own.where(F.col("module") == modules).drop("module")).withColumnRenamed("target", f"t{int(modules)}")
        found = tier if found is None else found.join(tier, ["source", "kb", "name"])
    target = found.select("source", "name", F.coalesce("t0", "t1").alias("target")).where("target is not null")
    return said.join(target, ["source", "name"]).select(section_id(F.col("source"), F.col("chunk_index")).alias("source"), "target", F.lit("references").alias("type"), F.col("source").alias("evidence_source"), "line_start", "line_end", F.col("token").alias("reason"))


def module_names(files: DataFrame) -> DataFrame:
    """(name, rel_path): what a Python file may be imported as: its dotted path, its stem, and for __init__.py its package."""
    py = files.where("rel_path like '%.py'").select("rel_path", F.lower(F.regexp_replace("rel_path", r"\.py$", "")).alias("path"))
    dotted = F.replace("path", F.lit("/"), F.lit("."))
    package = F.when(F.col("path").endswith("/__init__"), F.regexp_replace(dotted, r"\.__init__$", ""))
    return py.select("rel_path", F.explode(F.array_distinct(F.array_compact(F.array(dotted, T.basename(F.col("path")), package)))).alias("name")).where("name <> ''")


def import_edges(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Edges from import symbols to files: the longest dotted prefix that is one file of the kb, or one file at all.

    Each name of a kb is resolved once, however many files import it.
    """
    imports = nodes.where("type = 'symbol' and symbol_kind = 'import'").select("id", "source", "kb", "line_start", "line_end", "qualified_name")
    asked = imports.select("kb", "qualified_name").distinct()
    parts = F.split(F.lower(F.trim("qualified_name")), r"\.")
    prefixes = asked.withColumn("parts", parts).withColumn("n", F.explode(F.sequence(F.lit(1), F.size("parts")))).withColumn("name", F.array_join(F.slice("parts", F.lit(1), F.col("n")), ".")).where("name <> ''")
    known = module_names(files).select("name", F.col("rel_path").alias("target"), T.kb_of(F.col("rel_path")).alias("t_kb"))
    in_kb = known.groupBy("name", F.col("t_kb").alias("kb")).agg(F.count("*").alias("n_kb"), F.min("target").alias("near")).where("n_kb = 1")
    at_all = known.groupBy("name").agg(F.count("*").alias("n_all"), F.min("target").alias("far")).where("n_all = 1")
    met = prefixes.join(in_kb, ["name", "kb"], "left").join(at_all, "name", "left").withColumn("to", F.coalesce("near", "far")).where("to is not null")
    best = met.groupBy("kb", "qualified_name").agg(F.max_by("to", "n").alias("to")).withColumnsRenamed({"kb": "asked_kb", "qualified_name": "asked_name"})
    found = imports.join(best, F.col("kb").eqNullSafe(F.col("asked_kb")) & (F.col("qualified_name") == F.col("asked_name")))
    return found.select(F.col("id").alias("source"), file_id(F.col("to")).alias("target"), F.lit("imports").alias("type"), F.col("source").alias("evidence_source"), "line_start", "line_end", F.col("qualified_name").alias("reason"))


def document_edges(doc_edges: DataFrame) -> DataFrame:
    """The document graph (src, dst, kind, reason) as edges from file to file."""
    return doc_edges.select(file_id(F.col("src")).alias("source"), file_id(F.col("dst")).alias("target"), F.col("kind").alias("type"), F.col("src").alias("evidence_source"), F.lit(None).cast("long").alias("line_start"), F.lit(None).cast("long").alias("line_end"), "reason")


# ---- semantic extraction

PAYLOAD = "struct<concepts:array<struct<name:string,summary:string,aliases:array<string>>>,decisions:array<struct<name:string,summary:string,aliases:array<string>,rationale:array<string>>>>"
CACHE = "id string, status string, fingerprint string, payload string, total_tokens long"


def fingerprint(model: str, base_url: str, prompt_version: str) -> Column:
    """SHA-256 of what an extraction depends on: place, model, prompt and text."""
    return F.sha2(F.concat_ws("\x1f", "source", "chunk_index", F.lit(model), F.lit(base_url), F.lit(prompt_version), "text").cast("binary"), 256)


def extract_sections(chunks: DataFrame, extract: Callable[[str], dict], cache: DataFrame | None = None, model: str = "", base_url: str = "", prompt_version: str = "1", conf: EngineConf = CONF) -> DataFrame:
    """(id, status, fingerprint, payload, total_tokens) of every chunk: from the cache where its fingerprint is there, else from ``extract``.

    ``extract`` takes the text (cut at ``semantic_chars``) and returns {"concepts": .., "decisions": .., "usage": ..}. A failure
    gives a row of status error and no payload; only rows of status ok are taken from the cache.
    """
    asked = chunks.select(section_id(F.col("source"), F.col("chunk_index")).alias("id"), fingerprint(model, base_url, prompt_version).alias("fingerprint"), F.substring("text", 1, conf.semantic_chars).alias("text"))
    known = _shaped(cache.where("status = 'ok'"), CACHE) if cache is not None else asked.sparkSession.createDataFrame([], CACHE)
    hits = known.join(asked.select("id", "fingerprint"), ["id", "fingerprint"], "left_semi").dropDuplicates(["id"])
    missing = asked.join(hits.select("id"), "id", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, mark, text in zip(batch["id"], batch["fingerprint"], batch["text"]):
                try:
                    found = extract(text)
                    usage = found.get("usage") or {}
                    rows.append((key, "ok", mark, json.dumps({k: found.get(k) or [] for k in ("concepts", "decisions")}, ensure_ascii=False), int(usage.get("total_tokens") or 0)))
                except Exception as error:  # whatever a model's client raises: the row says so
                    rows.append((key, "error", mark, json.dumps({"error": str(error)[:200]}), 0))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CACHE.split(", ")])

    return _shaped(hits, CACHE).unionByName(missing.mapInPandas(run, CACHE))


def extraction_stats(extracted: DataFrame) -> DataFrame:
    """(status, n, total_tokens) of extracted sections."""
    return extracted.groupBy("status").agg(F.count("*").alias("n"), F.sum("total_tokens").alias("total_tokens"))


def _items(extracted: DataFrame, nodes: DataFrame) -> DataFrame:
    """(type, node, name, summary, aliases, rationale, section, source, line_start, line_end): each concept and decision of each known section."""
    parsed = extracted.where("status = 'ok'").select(F.col("id").alias("section"), F.from_json("payload", PAYLOAD).alias("p"))
    shape = lambda kind, why: lambda x: F.struct(F.lit(kind).alias("type"), F.trim(x["name"]).alias("name"), x["summary"].alias("summary"), x["aliases"].alias("aliases"), why(x).alias("rationale"))
    empty = F.array().cast("array<string>")
    every = F.concat(F.transform(F.coalesce("p.concepts", F.array().cast("array<struct<name:string,summary:string,aliases:array<string>>>")), shape("concept", lambda x: empty)), F.transform(F.coalesce("p.decisions", F.array().cast("array<struct<name:string,summary:string,aliases:array<string>,rationale:array<string>>>")), shape("decision", lambda x: F.coalesce(x["rationale"], empty))))
    own = nodes.where("type = 'section'").select(F.col("id").alias("section"), "source", "line_start", "line_end")
    return parsed.select("section", F.explode(every).alias("x")).select("section", "x.*").where("name <> ''").join(own, "section").withColumn("node", semantic_id(F.col("type"), F.col("name")))


def semantic_nodes(items: DataFrame) -> DataFrame:
    """One node for each id: aliases united (case ignored, the least spelling stays), the first summary that is not empty."""
    names = items.select("node", "type", "name", "summary", "section", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias")).where("trim(alias) <> ''")
    alias = names.groupBy("node", F.lower(F.trim("alias")).alias("low")).agg(F.min(F.trim("alias")).alias("alias")).groupBy("node").agg(F.array_sort(F.collect_list("alias")).alias("aliases"))  # the names of one concept
    head = items.groupBy("node", "type").agg(F.min_by("name", "section").alias("name"), F.min_by("summary", F.when(F.trim(F.coalesce("summary", F.lit(""))) != "", F.col("section"))).alias("summary"))
    return _shaped(head.join(alias, "node").withColumnRenamed("node", "id").withColumn("confidence", F.lit("EXTRACTED")), NODE)


def semantic_edges(items: DataFrame) -> DataFrame:
    """section to node, file to node and back (semantically_related), and from a concept to each decision that names it as a reason."""
    place = [F.col("source").alias("evidence_source"), "line_start", "line_end"]
    link = lambda a, b: items.select(a.alias("source"), b.alias("target"), F.lit("semantically_related").alias("type"), *place, F.col("name").alias("reason"))
    file, node = file_id(F.col("source")), F.col("node")
    related = link(F.col("section"), node).unionByName(link(file, node)).unionByName(link(node, file))
    alias = items.where("type = 'concept'").select("node", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("a")).select(F.col("node").alias("concept"), F.lower(F.trim("a")).alias("why")).distinct()
    reasons = items.where("type = 'decision'").select("node", "source", "line_start", "line_end", F.explode("rationale").alias("said")).withColumn("why", F.lower(F.trim("said"))).where("why <> ''")
    rationale = reasons.join(alias, "why").select(F.col("concept").alias("source"), F.col("node").alias("target"), F.lit("rationale_for").alias("type"), *place, F.col("said").alias("reason"))
    return related.unionByName(rationale)


def build(files: DataFrame, chunks: DataFrame, symbols: DataFrame, doc_edges: DataFrame, extracted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a corpus. Empty inputs give the nodes of what there is."""
    nodes = structural_nodes(files, chunks, symbols)
    edges = contained(nodes).unionByName(section_paths(chunks, files)).unionByName(symbol_references(chunks, nodes)).unionByName(import_edges(nodes, files)).unionByName(document_edges(doc_edges))
    if extracted is not None:
        items = graph.cut(_items(extracted, nodes))
        edges = edges.unionByName(semantic_edges(items))
        nodes = nodes.unionByName(semantic_nodes(items))
    return nodes, distinct_edges(edges)


def file_only(files: DataFrame, doc_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph of files and document edges alone, where nothing else is known."""
    none = files.sparkSession.createDataFrame([], "source string, chunk_index long, label string, line_start long, line_end long, kind string, name string, qualified_name string, signature string")
    return structural_nodes(files, none, none), distinct_edges(document_edges(doc_edges))


# ---- files of nodes that belong to none, saved notes

def attachments(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ATTACHED) -> DataFrame:
    """(node, file): for each node of ``kinds``, the files of what it has an edge with, either way."""
    held = nodes.where(F.col("type").isin(*kinds)).select(F.col("id").alias("node"))
    placed = nodes.where("type in ('file', 'section', 'symbol') and source <> ''").select(F.col("id").alias("other"), F.col("source").alias("file"))
    out = edges.select(F.col("source").alias("node"), F.col("target").alias("other")).unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("other")))
    return out.join(held, "node", "left_semi").join(placed, "other").select("node", "file").distinct()


def merge_notes(nodes: DataFrame, edges: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with the saved notes (id, question, summary, note_path, created_at, tags, sources) in place of those it had.

    A note is linked both ways with each known file among its sources, and with the concepts and decisions of that file.
    """
    old = nodes.where("type = 'query_note'").select(F.col("id").alias("gone"))
    kept = nodes.where("type <> 'query_note'")
    rest = edges.join(old, F.col("source") == F.col("gone"), "left_anti").join(old, F.col("target") == F.col("gone"), "left_anti")
    good = notes.where("id <> '' and question <> '' and note_path <> ''").dropDuplicates(["id"])
    new = good.select("id", F.lit("query_note").alias("type"), F.col("question").alias("name"), "summary", "note_path", "created_at", "tags", F.lit("EXTRACTED").alias("confidence"))
    files = kept.where("type = 'file'").select(F.col("id").alias("file_node"), F.col("source").alias("file"))
    cites = good.select("id", "question", "note_path", F.explode("sources").alias("file")).distinct().join(files, "file")
    pair = lambda df, a, b, evidence: df.select(F.col(a).alias("source"), F.col(b).alias("target"), F.lit("semantically_related").alias("type"), F.col(evidence).alias("evidence_source"), F.lit(None).cast("long").alias("line_start"), F.lit(None).cast("long").alias("line_end"), F.col("question").alias("reason"))
    topics = cites.join(attachments(kept, rest, ("concept", "decision")), "file")
    added = pair(cites, "file_node", "id", "note_path").unionByName(pair(cites, "id", "file_node", "note_path")).unionByName(pair(topics, "id", "node", "file")).unionByName(pair(topics, "node", "id", "file"))
    return kept.unionByName(_shaped(new, NODE)), distinct_edges(rest.drop("confidence").unionByName(added))


# ---- neighbours and projections

def _priority(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[x for k, v in EXPANSION_PRIORITY.items() for x in (F.lit(k), F.lit(v))])[kind], F.lit(OTHER_PRIORITY))


def file_neighbors(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(src, dst, kind, reason, bridges, rank): the files that each file reaches through the graph, the best path to each.

    A path goes from the file to another one straight, through a section (and a symbol of it), through a symbol, or through any
    chain of concepts, decisions and notes. The kind is that of its last edge; lower priorities are better, then the own kb,
    then the name. From a note, topics are followed only by edges that the first file itself attests. ``sources`` (rel_path): only from those.
    """
    end = nodes.select(F.col("id").alias("target"), F.col("type").alias("to_type"), F.col("source").alias("to_source"), F.col("name").alias("to_name"))
    step = graph.cut(edges.select(F.col("source").alias("at"), "target", F.col("type").alias("kind"), "reason", "evidence_source").join(end, "target"))
    begins = nodes.where("type = 'file'").select(F.col("id").alias("at"), F.col("source").alias("anchor"))
    if sources is not None:
        begins = begins.join(sources.select(F.col("rel_path").alias("anchor")).distinct(), "anchor", "left_semi")
    bridge = F.struct(F.col("target").alias("id"), F.col("to_type").alias("type"), F.col("to_name").alias("name"), F.col("kind").alias("relation"))
    first = begins.join(step, "at").select("anchor", F.col("target").alias("node"), "to_type", "to_source", "kind", "reason", bridge.alias("by"))
    ends = [first.where("to_type = 'file'").select("anchor", "to_source", "kind", "reason", F.array().cast("array<struct<id:string,type:string,name:string,relation:string>>").alias("bridges"))]
    second = first.where("to_type in ('section', 'symbol')").select("anchor", F.col("node").alias("at"), F.col("to_type").alias("via"), F.array("by").alias("bridges")).join(step, "at")
    ends.append(second.where("to_type = 'file'").select("anchor", "to_source", "kind", "reason", "bridges"))
    ends.append(second.where("to_type = 'symbol' and via = 'section'").select("anchor", "to_source", "kind", "reason", F.array_append("bridges", bridge).alias("bridges")))
    # topics: each (file, topic) is entered once, by the shortest chain
    reached = graph.cut(first.where(F.col("to_type").isin(*ATTACHED)).groupBy("anchor", "node", "to_type").agg(F.min(F.array("by")).alias("bridges")))
    fresh = reached
    while not fresh.isEmpty():
        out = fresh.select("anchor", F.col("node").alias("at"), F.col("to_type").alias("via"), "bridges").join(step, "at")
        topic = F.col("to_type").isin(*ATTACHED)
        out = out.where(~((F.col("via") == "query_note") & topic & (F.coalesce("evidence_source", F.lit("")) != "") & (F.col("evidence_source") != F.col("anchor"))))
        ends.append(out.where("to_type = 'file'").select("anchor", "to_source", "kind", "reason", "bridges"))
        ends.append(out.where("to_type in ('section', 'symbol')").select("anchor", "to_source", "kind", "reason", F.array_append("bridges", bridge).alias("bridges")))
        further = out.where(topic).groupBy("anchor", F.col("target").alias("node"), "to_type").agg(F.min(F.array_append("bridges", bridge)).alias("bridges"))
        fresh = graph.cut(further.join(reached.select("anchor", "node"), ["anchor", "node"], "left_anti"))
        reached = graph.cut(reached.unionByName(fresh))
    every = ends[0]
    for more in ends[1:]:
        every = every.unionByName(more)
    every = every.where("to_source <> '' and to_source <> anchor").withColumn("priority", _priority(F.col("kind")))
    best = every.groupBy(F.col("anchor").alias("src"), F.col("to_source").alias("dst")).agg(F.min(F.struct("priority", "kind", "reason", "bridges")).alias("e"))
    other_kb = (T.kb_of(F.col("src")) != T.kb_of(F.col("dst"))).cast("int")
    rank = F.row_number().over(Window.partitionBy("src").orderBy("e.priority", other_kb, "dst"))
    return best.withColumn("rank", rank).select("src", "dst", "e.kind", "e.priority", "e.reason", "e.bridges", "rank")


def project_files(doc_edges: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, kind, reason, origin, bridges): every edge of both graphs as edges between the files of its ends.

    A topic stands for all files that it is attached to; a note for the attested one, if it is among them.
    """
    file = doc_edges.select("src", "dst", "kind", "reason", F.lit("document_graph").alias("origin"), F.array().cast("array<struct<id:string,relation:string>>").alias("bridges"))
    held = attachments(nodes, edges).select("node", "file").unionByName(nodes.where("type in ('file', 'section', 'symbol') and source <> ''").select(F.col("id").alias("node"), F.col("source").alias("file")))
    kind = nodes.select(F.col("id").alias("node"), F.col("type").alias("node_type"))
    held = graph.cut(held.join(kind, "node"))
    side = lambda name: held.select(F.col("node").alias(name), F.col("file").alias(f"{name}_file"), F.col("node_type").alias(f"{name}_type"))
    e = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), F.col("type").alias("kind"), "reason", "evidence_source")
    attested = held.where("node_type = 'query_note'").select("node", "file", F.lit(True).alias("has"))
    e = e.join(attested.select(F.col("node").alias("a"), F.col("file").alias("evidence_source"), F.col("has").alias("has_a")), ["a", "evidence_source"], "left").join(attested.select(F.col("node").alias("b"), F.col("file").alias("evidence_source"), F.col("has").alias("has_b")), ["b", "evidence_source"], "left")
    met = e.join(side("a"), "a").where("has_a is null or a_file = evidence_source").join(side("b"), "b").where("has_b is null or b_file = evidence_source")
    via = F.array_compact(F.array(*[F.when(F.col(f"{x}_type") != "file", F.struct(F.col(x).alias("id"), F.col("kind").alias("relation"))) for x in ("a", "b")]))
    lifted = met.select(F.col("a_file").alias("src"), F.col("b_file").alias("dst"), "kind", "reason", F.lit("entity_graph").alias("origin"), via.alias("bridges"))
    return file.unionByName(lifted).where("src <> dst").distinct()
