"""Wiki pages as a table, saved notes, links between pages and what is wrong with them."""

from __future__ import annotations

import json
import re
from datetime import date, datetime, timezone
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import graph

PAGE = "relpath string, kind string, title string, text string, source_refs array<string>"
NOTE = "id string, question string, answer string, summary string, note_path string, created_at string, tags array<string>, sources array<string>"
PREVIEW_LINES, PREVIEW_CHARS = 12, 1200


# ---- Markdown, on the driver and as columns

def link_text(text: str) -> str:
    return re.sub(r"([\\\[\]])", r"\\\1", text)


def link(label: str, target: str) -> str:
    return f"[{link_text(label)}]({''.join({' ': '%20', '(': '%28', ')': '%29'}.get(c, c) for c in target)})"


def fence(text: str, mark: str = "`", least: int = 3) -> str:
    """A run of ``mark`` longer than any in the text."""
    return mark * max(least, max(map(len, re.findall(f"{re.escape(mark)}+", text)), default=0) + 1)


def inline_code(text: str) -> str:
    around = fence(text, least=1)
    pad = " " if text[:1] in ("`", " ") or text[-1:] in ("`", " ") else ""
    return f"{around}{pad}{text}{pad}{around}"


def code_block(text: str) -> str:
    around = min(fence(text, "`"), fence(text, "~"), key=len)
    return f"{around}text\n{text}\n{around}"


def slug(text: str, most: int = 64) -> str:
    """Words of any script joined by hyphens, cut at ``most``; ``query-note`` if nothing is left."""
    joined = re.sub(r"-{2,}", "-", re.sub(r"[^\w-]+", "-", text.strip().lower())).strip("-_")
    return joined[:most].rstrip("-_") or "query-note"


def md_link(label: Column, target: Column) -> Column:
    clean = F.regexp_replace(label, r"([\\\[\]])", r"\\$1")
    to = F.replace(F.replace(F.replace(target, F.lit(" "), F.lit("%20")), F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29"))
    return F.concat(F.lit("["), clean, F.lit("]("), to, F.lit(")"))


def preview(text: Column, lines: int = PREVIEW_LINES, chars: int = PREVIEW_CHARS) -> Column:
    """The first lines that are not blank, up to so many characters."""
    kept = F.slice(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != ""), 1, lines)
    return F.substring(F.array_join(kept, "\n"), 1, chars)


def fenced(text: Column) -> Column:
    """A text as a fenced block, with a fence longer than any run of tildes in it: links inside are no links."""
    run = F.array_max(F.transform(F.regexp_extract_all(text, F.lit("~+"), F.lit(0)), lambda x: F.length(x)))
    around = F.repeat(F.lit("~"), F.greatest(F.lit(3), F.coalesce(run, F.lit(0)) + 1))
    return F.concat(around, F.lit("text\n"), text, F.lit("\n"), around)


def links(text: str) -> list[str]:
    """Targets of Markdown links in order, those in fenced blocks left out."""
    out: list[str] = []
    inside = ""
    for line in (text or "").split("\n"):
        run = re.match(r"(`{3,}|~{3,})", line.lstrip())
        if run and (not inside or (run[1][0] == inside[0] and len(run[1]) >= len(inside))):
            inside = "" if inside else run[1]
        elif not inside:
            out += [x.strip() for x in re.findall(T.MD_LINK, line) if x.strip()]
    return out


def page_kind(relpath: str) -> str:
    """index, log, file, query, community, entity, or "" for what is no page."""
    if relpath in ("index.md", "log.md"):
        return relpath[:-3]
    return {"files": "file", "queries": "query", "communities": "community", "entities": "entity"}.get(relpath.split("/", 1)[0] if "/" in relpath else "", "")


def page_source(target: str) -> str:
    """The file that a link to ``files/<source>.md`` speaks of, from a page of the wiki's first or second level; else ""."""
    path = re.split("[#?]", unquote(target.strip()))[0].removeprefix("../")
    return path[len("files/") : -len(".md")] if path.startswith("files/") and path.endswith(".md") else ""


def heading_title(text: str, otherwise: str) -> str:
    """The text of the first heading that has any."""
    found = (x.strip().lstrip("#").strip() for x in (text or "").split("\n") if x.strip().startswith("#"))
    return next((x for x in found if x), otherwise)


def section(text: str, heading: str) -> str:
    """What stands under ``## heading`` up to the next heading of that rank."""
    parts = re.split(r"(?m)^## ", text)
    return next((p.partition("\n")[2].strip() for p in parts[1:] if p.partition("\n")[0].strip() == heading), "")


# ---- pages

def pages(files: DataFrame, nodes: DataFrame, edges: DataFrame, members: DataFrame, communities: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """PAGE rows: a page for each file, concept, decision, community and note, and the index.

    The index lists counts and the largest communities only, so no page grows with the corpus.
    """
    up = lambda source: F.concat(F.lit("../files/"), source, F.lit(".md"))
    head = lambda title, *more: F.concat_ws("\n", F.concat(F.lit("# "), title), F.lit(""), *more)
    name = F.array_join(F.transform("defines", lambda x: F.concat(F.lit("- `"), x, F.lit("`"))), "\n")
    defines = edges.where("type = 'defines'").select(F.col("evidence_source").alias("rel_path"), "reason").groupBy("rel_path").agg(F.array_sort(F.collect_set("reason")).alias("defines"))  # symbols of one file
    own = files.select("rel_path", "kb", "text").join(defines, "rel_path", "left").join(members.select("rel_path", "community"), "rel_path", "left")
    text = head(F.col("rel_path"), F.concat(F.lit("- kb: "), "kb"), F.concat(F.lit("- community: "), F.lpad(F.col("community").cast("string"), 3, "0")), F.coalesce(name, F.lit("")), F.lit(""), fenced(preview(F.col("text"))))
    file = own.select(F.concat(F.lit("files/"), "rel_path", F.lit(".md")).alias("relpath"), F.lit("file").alias("kind"), F.col("rel_path").alias("title"), text.alias("text"), F.array("rel_path").alias("source_refs"))

    topic = nodes.where("type in ('concept', 'decision')").select("id", "type", "name", "summary", "aliases")
    attached = edges.where("type = 'semantically_related'").join(topic.select(F.col("id").alias("target")), "target", "left_semi").groupBy(F.col("target").alias("id")).agg(F.array_sort(F.collect_set("evidence_source")).alias("sources"))
    related = related_topics(nodes, edges).groupBy("id").agg(F.array_sort(F.collect_set(F.concat_ws(": ", "relation", "other_name"))).alias("related"))
    full = topic.join(attached, "id", "left").join(related, "id", "left")
    listed = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit(""))
    seen = F.coalesce(F.array_join(F.transform("sources", lambda x: F.concat(F.lit("- "), md_link(x, up(x)))), "\n"), F.lit(""))
    path = F.concat(F.lit("entities/"), "type", F.lit("-"), F.substring(F.sha1(F.col("id").cast("binary")), 1, 16), F.lit(".md"))
    entity = full.select(path.alias("relpath"), F.lit("entity").alias("kind"), F.col("name").alias("title"), head(F.col("name"), F.coalesce("summary", F.lit("")), listed("aliases"), F.lit("\n## Sources"), seen, F.lit("\n## Related"), listed("related")).alias("text"), F.coalesce("sources", F.array().cast("array<string>")).alias("source_refs"))

    tops = F.array_join(F.transform("top_files", lambda x: F.concat(F.lit("- "), md_link(x, up(x)))), "\n")
    place = F.concat(F.lit("communities/community-"), F.lpad(F.col("community").cast("string"), 3, "0"), F.lit(".md"))
    group = communities.select(place.alias("relpath"), F.lit("community").alias("kind"), F.col("label").alias("title"), head(F.col("label"), F.concat(F.lit("- files: "), F.col("size").cast("string")), tops, listed("top_symbols"), listed("top_concepts"), F.lit("\n## Questions"), listed("suggested")).alias("text"), F.col("top_files").alias("source_refs"))

    largest = communities.orderBy("community").limit(50).agg(F.array_sort(F.collect_list(F.struct("community", "label", place.alias("to")))).alias("c"))
    counted = files.agg(F.count("*").alias("n_files")).crossJoin(F.broadcast(largest))  # one row each
    shown = F.array_join(F.transform("c", lambda x: F.concat(F.lit("- "), md_link(x["label"], x["to"]))), "\n")
    index = counted.select(F.lit("index.md").alias("relpath"), F.lit("index").alias("kind"), F.lit("知识导航").alias("title"), head(F.lit("Index"), F.concat(F.lit("- files: "), F.col("n_files").cast("string")), F.lit("\n## Communities"), shown).alias("text"), F.array().cast("array<string>").alias("source_refs"))
    out = file.unionByName(entity).unionByName(group).unionByName(index)
    return out if notes is None else out.unionByName(note_pages(notes))


def note_pages(notes: DataFrame) -> DataFrame:
    """PAGE rows of saved notes."""
    cited = F.array_join(F.transform("sources", lambda x: F.concat(F.lit("- 来源文件："), md_link(x, F.concat(F.lit("../files/"), x, F.lit(".md"))))), "\n")
    body = F.concat_ws("\n", F.concat(F.lit("# "), "question"), F.lit(""), F.concat(F.lit("- 生成时间："), "created_at"), F.lit("\n## 结论"), F.col("answer"), F.lit("\n## 来源"), cited)
    return notes.select(F.col("note_path").alias("relpath"), F.lit("query").alias("kind"), F.col("question").alias("title"), body.alias("text"), F.col("sources").alias("source_refs"))


def load_pages(spark: SparkSession, root: str) -> DataFrame:
    """PAGE rows of a folder of Markdown files; the log and what is no page are left out."""
    raw = spark.read.option("wholetext", True).text(root, recursiveFileLookup=True, pathGlobFilter="*.md").select("value", F.col("_metadata.file_path").alias("path"))
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for text, path in zip(batch["value"], batch["path"]):
                rel = unquote(path.split(base, 1)[-1].lstrip("/"))
                kind = page_kind(rel)
                if kind in ("", "log"):
                    continue
                own = page_source(rel)
                refs = [own] if kind == "file" else list(dict.fromkeys(filter(None, map(page_source, links(text)))))
                title = own if kind == "file" else "知识导航" if kind == "index" else heading_title(text, rel.rsplit("/", 1)[-1][:-3])
                rows.append((rel, kind, title, text, refs))
            yield pd.DataFrame(rows, columns=["relpath", "kind", "title", "text", "source_refs"])

    return raw.mapInPandas(run, PAGE)


def page_links(pages: DataFrame) -> DataFrame:
    """(relpath, target, raw): links of each page, resolved beside it; those outside the wiki and to other schemes are left out."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = [(rel, raw) for rel, text in zip(batch["relpath"], batch["text"]) for raw in dict.fromkeys(links(text)) if not re.match(r"#|[A-Za-z][A-Za-z0-9+.-]*:", raw)]
            yield pd.DataFrame([(r, x, re.split("[#?]", unquote(x))[0]) for r, x in rows], columns=["relpath", "raw", "clean"])

    found = pages.select("relpath", "text").mapInPandas(run, "relpath string, raw string, clean string").where("clean <> ''")
    parent = graph.parent(F.col("relpath"))
    target = graph.folded(F.when(parent == "", F.col("clean")).otherwise(F.concat_ws("/", parent, F.col("clean"))))
    return found.select("relpath", target.alias("target"), "raw").where("target not like '../%'")


def lint(pages: DataFrame, files: DataFrame, page_times: DataFrame | None = None) -> DataFrame:
    """(problem, page, detail): missing_link (a link to no page), orphan (no other page links to it), stale (a file without a page, or changed since).

    files: rel_path[, modified]; page_times: relpath, modified.
    """
    seen = page_links(pages)
    known = pages.select(F.col("relpath").alias("target"))
    missing = seen.join(known, "target", "left_anti").select(F.lit("missing_link").alias("problem"), F.col("relpath").alias("page"), F.col("raw").alias("detail"))
    linked = seen.select(F.col("target").alias("relpath")).distinct()
    orphan = pages.where("kind not in ('index', 'log')").select("relpath").join(linked, "relpath", "left_anti").select(F.lit("orphan").alias("problem"), F.col("relpath").alias("page"), F.lit("").alias("detail"))
    wanted = files.select("*", F.concat(F.lit("files/"), "rel_path", F.lit(".md")).alias("target"))
    absent = wanted.join(known, "target", "left_anti").select(F.lit("stale").alias("problem"), F.col("target").alias("page"), F.lit("missing_page").alias("detail"))
    out = missing.unionByName(orphan).unionByName(absent)
    if page_times is not None:
        times = page_times.select(F.col("relpath").alias("target"), F.col("modified").alias("page_modified"))
        old = wanted.join(times, "target").where("page_modified < modified").select(F.lit("stale").alias("problem"), F.col("target").alias("page"), F.lit("normalized_text_newer").alias("detail"))
        out = out.unionByName(old)
    return out


def lint_summary(report: DataFrame) -> DataFrame:
    """One row: stale_pages, orphan_pages, missing_links."""
    return report.agg(F.count_if(F.col("problem") == "stale").alias("stale_pages"), F.count_if(F.col("problem") == "orphan").alias("orphan_pages"), F.count_if(F.col("problem") == "missing_link").alias("missing_links"))


def kind_counts(pages: DataFrame) -> DataFrame:
    """(kind, n) of the pages."""
    return pages.groupBy("kind").agg(F.count("*").alias("n"))


def related_topics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, relation, other, other_name): concepts and decisions that an edge joins, seen from either end, each once."""
    topic = nodes.where("type in ('concept', 'decision')").select("id", "name")
    pair = edges.select(F.col("source").alias("id"), F.col("target").alias("other"), F.col("type").alias("relation"))
    both = pair.unionByName(pair.select(F.col("other").alias("id"), F.col("id").alias("other"), "relation")).distinct()
    return both.join(topic.select("id"), "id", "left_semi").join(topic.select(F.col("id").alias("other"), F.col("name").alias("other_name")), "other").select("id", "relation", "other", "other_name")


# ---- saved notes

def notes(spark: SparkSession, root: str) -> DataFrame | None:
    """The saved notes under ``root``, if there are any: of each note the last saved form."""
    from . import store

    if not store.exists(spark, f"{root.rstrip('/')}/notes"):
        return None
    own = spark.read.schema(NOTE + ", saved timestamp").parquet(f"{root.rstrip('/')}/notes")
    last = Window.partitionBy("id").orderBy(F.desc("saved"), "question")
    return own.withColumn("nth", F.row_number().over(last)).where("nth = 1").drop("nth", "saved")


def save_note(spark: SparkSession, root: str, question: str, answer: str, sources: list[str], tags: list[str] = (), on: date | None = None) -> str:
    """Saves an answered question and returns its path: queries/<date>-<slug>.md, with -2, -3, .. where that is taken.

    Questions and answers must not be blank. The note is one row, so a reader sees all of it or nothing; the log of notes
    (NOTES) holds each path once.
    """
    from . import store

    if not question.strip() or not answer.strip():
        raise ValueError("a note needs a question and an answer")
    with store.locked(spark, root):
        base = f"queries/{(on or date.today()).isoformat()}-{slug(question)}"
        had = notes(spark, root)
        taken = {r["note_path"] for r in had.where(F.col("note_path").startswith(base)).select("note_path").collect()} if had is not None else set()  # notes of one day and slug
        n = next(n for n in range(1, len(taken) + 2) if (f"{base}.md" if n == 1 else f"{base}-{n}.md") not in taken)
        path = f"{base}.md" if n == 1 else f"{base}-{n}.md"
        row = (f"query_note:{path}", question.strip(), answer, answer.strip()[:240].strip(), path, datetime.now(timezone.utc).isoformat(timespec="seconds"), list(tags), list(dict.fromkeys(s.strip() for s in sources if s.strip())))
        spark.createDataFrame([row], NOTE).withColumn("saved", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/notes")
        log = json.loads(store.read_text(spark, f"{root.rstrip('/')}/NOTES") or "[]")
        store.write_text(spark, f"{root.rstrip('/')}/NOTES", json.dumps(list(dict.fromkeys([*log, path])), ensure_ascii=False))
    return path


def parse_note(text: str, path: str) -> tuple | None:
    """NOTE values of a note in Markdown (title, 生成时间, 标签, 结论, 来源); None without a title."""
    title = next((x[2:].strip() for x in text.split("\n") if x.startswith("# ") and x[2:].strip()), "")
    if not title:
        return None
    field = lambda name: next((x.split("：", 1)[1].strip() for x in text.split("\n") if x.startswith(f"- {name}：")), "")
    sources = re.findall(r"(?m)^\s*- 来源文件：\[(.*)\]\([^)]+\)\s*$", section(text, "来源"))
    answer = section(text, "结论")
    return (f"query_note:{path}", title, answer, answer[:240].strip(), path, field("生成时间").strip("`"), re.findall("`([^`]+)`", field("标签")), list(dict.fromkeys(re.sub(r"\\(.)", r"\1", s) for s in sources)))
