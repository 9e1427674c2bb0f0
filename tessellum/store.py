"""A stored corpus: tables of one build in a folder of their own, a pointer to the current build, and when to build again.

A build writes every table as Parquet under ``<root>/v-<id>/`` and then replaces the small file ``<root>/CURRENT`` by an atomic
rename, so readers see the old build or the new one, never a part. All files go through Hadoop's file system: any store
Spark knows will do.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wiki
from .conf import CONF, EngineConf
from .functions import text as T
from .operators import chunk, community, entity, graph, lexical, planning, search
from .operators.search import Bundle

SCHEMAS = {
    "files": "rel_path string, kb string, suffix string, text string, length long, modified timestamp",
    "chunks": "source string, kb string, chunk_index long, line_start long, line_end long, label string, kind string, strategy string, total long, text string",
    "symbols": "source string, kind string, name string, qualified_name string, line_start long, line_end long, signature string",
    "postings": "term string, source string, chunk_index long, tf long, length long",
    "terms": "term string, df long",
    "corpus": "doc_count long, avg_length double",
    "vectors": "source string, chunk_index long, embedding array<float>",
    "doc_edges": "src string, dst string, kind string, priority int, reason string, rank int",
    "nodes": entity.NODE,
    "edges": entity.EDGE,
    "neighbors": "src string, dst string, kind string, priority int, reason string, bridges array<struct<id:string,type:string,name:string,relation:string>>, rank int",
    "items": "item_id long, kind string, text string, source string, kb string, symbol string, path_glob string, tokens array<string>, priority int",
    "pages": wiki.PAGE,
    "manifest": "name string, kb string, suffix string, size_kb double, modified timestamp, strategy string, chunks long, original_chunks long, truncated boolean",
    "communities": "community long, label string, size long, kbs array<string>, top_files array<string>, top_symbols array<string>, top_concepts array<string>, top_decisions array<string>, top_notes array<string>, suggested array<string>",
    "members": "rel_path string, community long, size long",
}
REQUIRED = ("files", "chunks", "symbols", "postings", "terms", "corpus", "vectors")


# ---- small files

def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, or None if there is none."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside its place and renames it there, so readers never see half of it."""
    p, fs = _path(spark, path)
    q, _ = _path(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(q, True)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    jvm, context = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext
    over = context._gateway.new_array(jvm.Options.Rename, 1)
    over[0] = jvm.Options.Rename.OVERWRITE
    jvm.FileContext.getFileContext(fs.getUri(), context._jsc.hadoopConfiguration()).rename(fs.makeQualified(q), fs.makeQualified(p), over)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


@contextmanager
def locked(spark: SparkSession, root: str, timeout: float = 5.0, poll: float = 0.05, stale: float = 3600.0) -> Iterator[None]:
    """Holds ``<root>/LOCK``, a file that only one writer can create; one older than ``stale`` seconds is taken over."""
    p, fs = _path(spark, f"{root}/LOCK")
    fs.mkdirs(p.getParent())
    began = time.monotonic()
    while not fs.createNewFile(p):
        if fs.exists(p) and time.time() - fs.getFileStatus(p).getModificationTime() / 1000 > stale:
            fs.delete(p, False)
        elif time.monotonic() - began > timeout:
            raise TimeoutError(f"{root}/LOCK is held by another writer")
        else:
            time.sleep(poll)
    try:
        yield
    finally:
        fs.delete(p, False)


# ---- builds

def postings(chunks: DataFrame) -> DataFrame:
    """(term, source, chunk_index, tf, length) of every chunk that has a term; length: all of its terms. Nothing is shuffled."""
    return lexical.postings(chunks)


def manifest(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row a file: its size, time, strategy, chunks kept and made."""
    counts = chunks.groupBy("source").agg(F.count("*").alias("chunks"), F.max("total").alias("original_chunks"), F.max("strategy").alias("strategy"))
    joined = files.join(counts, F.col("rel_path") == F.col("source"), "left").fillna({"chunks": 0, "original_chunks": 0})
    return joined.select(F.col("rel_path").alias("name"), "kb", "suffix", F.round(F.col("length") / 1024, 3).alias("size_kb"), "modified", "strategy", "chunks", "original_chunks", (F.col("chunks") < F.col("original_chunks")).alias("truncated"))


def source_snapshot(files: DataFrame) -> tuple[int, str]:
    """(number of files, digest): a digest of all paths, sizes and times that does not depend on their order.

    Two independent 64-bit sums over the files, so nothing is sorted or gathered.
    """
    row = F.concat_ws("\0", "rel_path", "length", F.col("modified").cast("string"))
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(k), row).cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)")).cast("string").alias(f"s{k}") for k in (1, 2)]
    got = files.agg(F.count("*").alias("n"), *sums).first()
    return got["n"], hashlib.sha256(f"{got['n']}\0{got['s1']}\0{got['s2']}".encode()).hexdigest()


def compare_snapshots(stored: DataFrame, now: DataFrame) -> DataFrame:
    """(rel_path, change): new, gone or changed files (rel_path, length, modified); unchanged ones are left out."""
    a = stored.select("rel_path", F.struct("length", "modified").alias("was"))
    b = now.select("rel_path", F.struct("length", "modified").alias("is"))
    change = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "gone").when(F.col("was") != F.col("is"), "changed")
    return a.join(b, "rel_path", "full").select("rel_path", change.alias("change")).where("change is not null")


def build(
    spark: SparkSession, files: DataFrame, root: str, config: dict[str, str] | None = None, embed: Callable = search.hash_embedding, extract: Callable | None = None, cache: DataFrame | None = None,
    max_chunks: int = 0, skip: tuple[str, ...] = (), conf: EngineConf = CONF,
) -> str:
    """Indexes ``files`` (rel_path, kb, suffix, text[, length, modified]) under ``root`` and returns the folder of the build.

    ``extract`` reads concepts and decisions from sections (``cache``: what an earlier build extracted). ``skip`` may name
    graph, semantic or wiki. Notes saved under ``root`` are merged into the graph.
    """
    place = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"

    def put(name: str, df: DataFrame, sort: str | None = None) -> DataFrame:
        shaped = entity._shaped(df, SCHEMAS[name])
        (shaped.repartitionByRange(sort).sortWithinPartitions(sort) if sort else shaped).write.parquet(f"{place}/{name}")
        return spark.read.schema(SCHEMAS[name]).parquet(f"{place}/{name}")

    with locked(spark, root):
        more = {"length": F.octet_length("text").cast("long"), "modified": F.lit(None).cast("timestamp")}
        if "modificationTime" in files.columns:
            files = files.withColumnRenamed("modificationTime", "modified")
        for name, column in more.items():
            files = files if name in files.columns else files.withColumn(name, column)
        files = put("files", files)
        chunks = put("chunks", chunk.indexed_chunks(files, conf, max_chunks))
        symbols = put("symbols", chunk.symbols(files))
        words = put("postings", postings(chunks), sort="term")
        put("terms", words.groupBy("term").agg(F.count("*").alias("df")), sort="term")
        lengths = words.groupBy("source", "chunk_index").agg(F.max("length").alias("length"))
        put("corpus", lengths.agg(F.count("*").alias("doc_count"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("avg_length")))
        put("vectors", search.embedded(chunks.where("trim(text) <> ''").select("source", "chunk_index", "text"), embed))
        put("manifest", manifest(files, chunks))
        doc_edges = put("doc_edges", graph.document_graph(files, symbols, conf) if "graph" not in skip else spark.createDataFrame([], SCHEMAS["doc_edges"]))
        extracted = None
        if extract is not None and "semantic" not in skip:
            extracted = entity.extract_sections(chunks, extract, cache, conf=conf)
            extracted.write.parquet(f"{place}/semantic")
            extracted = spark.read.schema(entity.CACHE).parquet(f"{place}/semantic")
        nodes, edges = entity.build(files, chunks, symbols, doc_edges, extracted) if "graph" not in skip else entity.file_only(files, doc_edges)
        notes = wiki.notes(spark, root)
        if notes is not None:
            nodes, edges = entity.merge_notes(nodes, edges, notes)
        nodes, edges = put("nodes", nodes), put("edges", edges)
        put("neighbors", entity.file_neighbors(nodes, edges))
        put("items", planning.expansion_items(files, symbols, nodes))
        relations = graph.cut(entity.project_files(doc_edges, nodes, edges))
        member = put("members", community.members(files, relations))
        summary = put("communities", community.summaries(member, community.top_files(member, relations), community.top_symbols(member, nodes, edges), community.top_topics(member, nodes, edges)))
        pages = wiki.pages(files, nodes, edges, member, summary, notes) if "wiki" not in skip else spark.createDataFrame([], wiki.PAGE)
        put("pages", pages)
        n, digest = source_snapshot(files)
        about = {"version": 1, "built": datetime.now(timezone.utc).isoformat(timespec="seconds"), "config": config or {}, "file_count": n, "source_digest": digest, "skip": list(skip), "max_chunks": max_chunks}
        write_text(spark, f"{place}/MANIFEST", json.dumps(about, ensure_ascii=False, indent=1))
        write_text(spark, f"{root.rstrip('/')}/CURRENT", place.rsplit("/", 1)[1])
    return place


def current(spark: SparkSession, root: str) -> str | None:
    """The folder of the current build, if there is one."""
    name = read_text(spark, f"{root.rstrip('/')}/CURRENT")
    return f"{root.rstrip('/')}/{name.strip()}" if name else None


def about(spark: SparkSession, place: str) -> dict | None:
    """The manifest of a build; None if it is missing or is no manifest."""
    text = read_text(spark, f"{place}/MANIFEST")
    try:
        found = json.loads(text) if text else None
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def checked(spark: SparkSession, place: str, name: str) -> DataFrame:
    """A table of a build with the columns it must have; ValueError if it is missing or has others."""
    if not exists(spark, f"{place}/{name}"):
        raise ValueError(f"{name}: there is no such table in {place}")
    df = spark.read.parquet(f"{place}/{name}")
    want = [tuple(f.split(" ", 1)) for f in SCHEMAS[name].split(", ")]
    lacks = [c for c, t in want if dict(df.dtypes).get(c) != t.replace("long", "bigint")]
    if lacks:
        raise ValueError(f"{name}: columns {', '.join(lacks)} are missing or of another type in {place}")
    return df.select(*[c for c, _ in want])


def load(spark: SparkSession, root: str) -> Bundle:
    """The current build: ids and edges once each, postings without a chunk or a count left out."""
    place = current(spark, root)
    if place is None:
        raise ValueError(f"nothing has been built in {root}")
    t = {name: checked(spark, place, name) for name in SCHEMAS if name not in ("manifest", "communities", "members")}
    t["nodes"], t["edges"] = entity.distinct_nodes(t["nodes"]), entity.distinct_edges(t["edges"])
    t["postings"] = t["postings"].where("tf > 0").join(t["chunks"].select("source", "chunk_index"), ["source", "chunk_index"], "left_semi").select("term", "source", "chunk_index", "tf", "length")
    return Bundle(**t, manifest=about(spark, place) or {})


def signature(spark: SparkSession, root: str) -> tuple:
    """What changes whenever a reader must load anew: the current build and the state of the saved notes."""
    return current(spark, root), read_text(spark, f"{root.rstrip('/')}/NOTES")


def rebuild_state(spark: SparkSession, root: str, files: DataFrame, config: dict[str, str] | None = None) -> tuple[bool, str]:
    """(whether to build again, why): missing_index, invalid_manifest, invalid_fulltext_index, missing_source_snapshot, build_config_changed, source_changed or up_to_date."""
    place = current(spark, root)
    if place is None or not all(exists(spark, f"{place}/{name}") for name in REQUIRED):
        return True, "missing_index"
    known = about(spark, place)
    if known is None:
        return True, "invalid_manifest"
    try:
        for name in ("postings", "terms", "corpus"):
            checked(spark, place, name)
    except ValueError:
        return True, "invalid_fulltext_index"
    if (config or {}) != known.get("config", {}):
        return True, "build_config_changed"
    if not {"file_count", "source_digest"} <= known.keys():
        return True, "missing_source_snapshot"
    if "modificationTime" in files.columns:
        files = files.withColumnRenamed("modificationTime", "modified")
    for name, column in {"length": F.octet_length("text").cast("long"), "modified": F.lit(None).cast("timestamp")}.items():
        files = files if name in files.columns else files.withColumn(name, column)
    if source_snapshot(files) != (known["file_count"], known["source_digest"]):
        return True, "source_changed"
    return False, "up_to_date"


def refresh_notes(spark: SparkSession, root: str) -> None:
    """Merges the saved notes into the graph of the current build anew: its nodes, edges and neighbours, and the pages of notes."""
    place = current(spark, root)
    saved = wiki.notes(spark, root)
    if place is None or saved is None:
        return
    with locked(spark, root):
        nodes, edges = entity.merge_notes(checked(spark, place, "nodes"), checked(spark, place, "edges"), saved)
        nodes, edges = graph.cut(entity._shaped(nodes, SCHEMAS["nodes"])), graph.cut(entity._shaped(edges, SCHEMAS["edges"]))
        own = checked(spark, place, "pages").where("kind <> 'query'")
        pages = graph.cut(own.unionByName(wiki.note_pages(saved)))
        near = graph.cut(entity._shaped(entity.file_neighbors(nodes, edges), SCHEMAS["neighbors"]))
        fresh = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
        for name in SCHEMAS:  # a build of its own: readers of the old one are not disturbed
            own = {"nodes": nodes, "edges": edges, "pages": pages, "neighbors": near}.get(name)
            if own is None and exists(spark, f"{place}/{name}"):
                own = spark.read.schema(SCHEMAS[name]).parquet(f"{place}/{name}")
            if own is not None:
                own.write.parquet(f"{fresh}/{name}")
        write_text(spark, f"{fresh}/MANIFEST", read_text(spark, f"{place}/MANIFEST") or "{}")
        write_text(spark, f"{root.rstrip('/')}/CURRENT", fresh.rsplit("/", 1)[1])


def clear_pages(spark: SparkSession, root: str) -> None:
    """Deletes the generated pages of the current build; saved notes stay."""
    place = current(spark, root)
    if place:
        spark.createDataFrame([], wiki.PAGE).write.mode("overwrite").parquet(f"{place}/pages")


def drop_old(spark: SparkSession, root: str) -> list[str]:
    """Deletes every build but the current one; returns their names."""
    keep = (current(spark, root) or "").rsplit("/", 1)[-1]
    p, fs = _path(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    gone = [n for n in names if n.startswith("v-") and n != keep]
    for n in gone:
        delete(spark, f"{root.rstrip('/')}/{n}")
    return gone
