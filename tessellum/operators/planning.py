"""Query plans of many questions at once, and what the corpus adds to them.

A plan is a row: query_id, question, kb (null: all), symbols, keywords, path_globs (arrays without repeats but for case),
semantic_query, reason, wants_symbol, wants_file. Plans are read by rule from the question; the corpus's own names
(expansion items) and the first vector hits may add to them; a follow-up plan may be merged in.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..conf import ITEM_PRIORITY
from ..functions import text as T
from ..sources.corpus import BINARY, SUFFIXES
from . import graph, lexical
from .cuts import cut
from .retrieve import top

# What a question may call a kind of file, and how it asks for a symbol or a file.
KINDS_OF_FILE = {
    "python": "*.py", "py": "*.py", "yaml": "*.yaml", "yml": "*.yml", "json": "*.json", "toml": "*.toml", "ini": "*.ini", "md": "*.md", "markdown": "*.md", "tsx": "*.tsx", "ts": "*.ts", "jsx": "*.jsx",
    "js": "*.js", "java": "*.java", "go": "*.go", "rs": "*.rs", "shell": "*.sh", "sh": "*.sh", "docx": "*.docx", "xlsx": "*.xlsx", "xls": "*.xls", "pdf": "*.pdf",
}
ASKS_SYMBOL = (
    "哪个函数", "哪一个函数", "函数定义", "函数实现", "哪个方法", "哪一个方法", "方法定义", "方法实现", "哪个类", "哪一个类", "类定义", "类实现", "哪个接口", "接口定义", "入口函数", "入口方法", "入口类",
    "symbol", "which function", "what function", "function definition", "function implementation", "which method", "what method", "method definition", "method implementation",
    "which class", "what class", "class definition", "class implementation", "entrypoint",
)
ASKS_FILE = (
    "哪个文件", "哪一个文件", "在哪个文件", "文件名", "哪个文档", "哪一个文档", "哪份文档", "哪篇文档", "文档名", "which file", "what file", "file name", "which document", "what document", "document name",
    ".py", ".md", ".yaml", ".yml", ".json", ".toml",
)

PLAN = "query_id long, question string, kb string, symbols array<string>, keywords array<string>, path_globs array<string>, semantic_query string, reason string, wants_symbol boolean, wants_file boolean"

# What counts as a token, a file name beyond ASCII and a name.
_QUOTED = re.compile(r"`([^`]+)`|\"([^\"]+)\"|“([^”]+)”|'([^']+)'")
_TOKEN = re.compile(r"[A-Za-z0-9_./*:-]{2,}")
_NAMED_FILE = re.compile(r"[^\s`\"'“”]+[^\x00-\x7F][^\s`\"'“”]*\.[A-Za-z][A-Za-z0-9]{0,7}")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_EDGES = ".,:;!?()[]{}"


def distinct(items) -> list[str]:
    """Trimmed, non-empty items; of those equal but for case the first stays."""
    out: dict[str, str] = {}
    for x in items:
        x = str(x).strip()
        if x:
            out.setdefault(x.lower(), x)
    return list(out.values())


def has_suffix(token: str) -> bool:
    """Whether a token ends as a file of a known kind does, with something before."""
    head, dot, tail = token.strip().lower().rpartition(".")
    return bool(dot and head and tail in SUFFIXES + BINARY)


def is_extension(token: str) -> bool:
    return token.startswith(".") and token.count(".") == 1 and len(token) <= 8 and "/" not in token


def names_source(token: str) -> bool:
    """Whether a token is a path, a pattern, an extension or a file name."""
    token = token.strip()
    return bool(token) and (any(c in token for c in "*/\\") or is_extension(token) or has_suffix(token))


def only_extension(pattern: str) -> bool:
    return is_extension(pattern.strip().strip("*")) and "\\" not in pattern


def rule_plan(question: str) -> dict[str, list[str]]:
    """symbols, keywords and path_globs that a question names.

    Quoted spans, ASCII tokens and file names beyond ASCII are keywords, but for bare names of file kinds. What looks like
    a source becomes a pattern; what is quoted, holds an underscore or a capital, or is called, a symbol; dotted names
    that are no files give their last part.
    """
    spans = [(m.lastindex, m[m.lastindex]) for m in _QUOTED.finditer(question)]
    spans = [x for _, x in sorted(spans, key=lambda s: s[0])]
    quoted = {x.strip().strip(_EDGES).lower() for x in spans}
    symbols, keywords, globs = [], [], []
    for raw in [*spans, *_TOKEN.findall(question), *_NAMED_FILE.findall(question)]:
        token = raw.strip().strip(_EDGES)
        if not token:
            continue
        if token.lower() not in KINDS_OF_FILE:
            keywords.append(token)
        if names_source(token):
            globs.append(token if "*" in token else f"*{token}" if is_extension(token) else f"*{token}*")
        said = token.lower() in quoted
        if _NAME.fullmatch(token) and (said or "_" in token or token.lower() != token):
            symbols.append(token)
        parts = token.split(".")
        if len(parts) > 1 and all(parts):
            if said and all(map(_NAME.fullmatch, parts)):
                symbols.append(token)
            if not has_suffix(token) and _NAME.fullmatch(parts[-1]):
                symbols.append(parts[-1])
    for called in re.findall(T.CALL, question):
        symbols.append(called)
        keywords.append(f"{called}(")
    words = set(re.findall(r"[a-z0-9_]+", question.lower()))
    globs += [pattern for kind, pattern in KINDS_OF_FILE.items() if kind in words]
    return {"symbols": distinct(symbols), "keywords": distinct(keywords), "path_globs": distinct(globs)}


def plans(questions: DataFrame) -> DataFrame:
    """PLAN rows of questions (query_id, text[, kb]). Null questions are empty."""
    kb = F.col("kb") if "kb" in questions.columns else F.lit(None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for query_id, question, own_kb in zip(batch["query_id"], batch["question"], batch["kb"]):
                plan, low = rule_plan(question), question.lower()
                rows.append((query_id, question, own_kb, plan["symbols"], plan["keywords"], plan["path_globs"], question.strip(), "rule planner", bool(plan["symbols"]) or any(p in low for p in ASKS_SYMBOL), bool(plan["path_globs"]) or any(p in low for p in ASKS_FILE)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PLAN.split(", ")])

    return questions.select(F.col("query_id").cast("long").alias("query_id"), F.coalesce(F.col("text"), F.lit("")).alias("question"), kb.cast("string").alias("kb")).mapInPandas(run, PLAN)


def query_terms(plan: DataFrame) -> DataFrame:
    """(query_id, term): the search terms of question, keywords and symbols, each once."""
    every = F.array_join(F.concat(F.array("semantic_query"), "keywords", "symbols"), "\n")
    return plan.select("query_id", F.explode(F.array_distinct(T.terms(every))).alias("term"))


def merged(plan: DataFrame, added: DataFrame) -> DataFrame:
    """Plans with the symbols, keywords and path_globs that ``added`` (query_id, kind in those three, value, ord) gives them, after their own."""
    own = plan
    for kind in ("symbols", "keywords", "path_globs"):
        more = added.where(F.col("kind") == kind).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("x")).select("query_id", F.transform("x", lambda s: s["value"]).alias("more"))  # a few of each query
        own = own.join(more, "query_id", "left").withColumn(kind, T.ordered_distinct(F.concat(kind, F.coalesce("more", F.array().cast("array<string>"))))).drop("more")
    return own


def followed(plan: DataFrame, planner: Callable[[str], dict | None]) -> DataFrame:
    """Plans merged with what ``planner`` returns for a question ({symbols, keywords, path_globs, semantic_query, reason}, or None).

    A planner that fails or gives no mapping changes nothing; a follow-up's semantic query and reason win over the first ones.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                try:
                    more = planner(row["question"])
                except Exception:  # whatever a model's client raises: the rule plan stays
                    more = None
                if isinstance(more, dict):
                    for kind in ("symbols", "keywords", "path_globs"):
                        row[kind] = distinct([*row[kind], *(more.get(kind) or [])])
                    row["semantic_query"] = str(more.get("semantic_query") or "").strip() or row["question"]
                    row["reason"] = more.get("reason") or row["reason"]
                rows.append(row)
            yield pd.DataFrame(rows, columns=batch.columns)

    return plan.mapInPandas(run, PLAN)


# ---- expansion by the corpus's own names

def variants(text: Column) -> Column:
    """A name, its basename, its stem, and the stem with its separators as blanks, each once."""
    name = T.basename(text)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return T.ordered_distinct(F.array(text, name, stem, F.regexp_replace(stem, r"[_./:-]+", " ")))


def expansion_items(files: DataFrame, symbols: DataFrame, nodes: DataFrame) -> DataFrame:
    """(item_id, kind, text, source, kb, symbol, path_glob, tokens, priority): names of files, symbols and graph nodes.

    Items alike but for case are one; those without a search term are none.
    """
    none = F.lit("")
    base = T.basename(F.col("rel_path"))
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    file = files.select(F.lit("file").alias("kind"), F.explode(F.array_distinct(F.array(base, stem))).alias("text"), F.col("rel_path").alias("source"), T.kb_of(F.col("rel_path")).alias("kb"), none.alias("symbol"), F.concat(F.lit("*"), base, F.lit("*")).alias("path_glob"))
    symbol = symbols.select(F.lit("symbol").alias("kind"), F.explode(F.array_distinct(F.array("name", F.coalesce("qualified_name", "name")))).alias("text"), "source", T.kb_of(F.col("source")).alias("kb")).withColumn("symbol", F.col("text")).withColumn("path_glob", none)
    source = F.coalesce("source", none)
    surfaces = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    node = nodes.where("type not in ('file', 'query_note')").select(F.col("type").alias("kind"), F.explode(surfaces).alias("text"), source.alias("source"), F.coalesce("kb", none).alias("kb"), none.alias("symbol"), F.when(source != "", F.concat(F.lit("*"), T.basename(source), F.lit("*"))).otherwise("").alias("path_glob"))
    every = file.unionByName(symbol).unionByName(node).withColumn("text", F.trim("text")).where("text <> ''")
    one = every.groupBy("kind", "source", F.lower("text").alias("low"), F.lower("symbol").alias("s"), F.lower("path_glob").alias("g")).agg(F.min(F.struct("text", "kb", "symbol", "path_glob")).alias("x"))
    tokens = F.array_distinct(T.terms(F.array_join(variants(F.col("x.text")), "\n")))
    priority = F.coalesce(F.create_map(*[y for k, v in ITEM_PRIORITY.items() for y in (F.lit(k), F.lit(v))])[F.col("kind")], F.lit(1))
    return one.select(F.xxhash64("kind", "source", "low", "s", "g").alias("item_id"), "kind", "x.text", "source", "x.kb", "x.symbol", "x.path_glob", tokens.alias("tokens"), priority.alias("priority")).where("size(tokens) > 0")


def candidates(plan: DataFrame, items: DataFrame, allowed: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(query_id, item.., overlap, score, place): items by shared terms, each a point, 2 if the question holds the name, 0.75 if all
    of the item's terms are shared, 0.1 for each step of priority.

    A single shared term of an item of more than three, whose name the question does not hold, is no candidate. Items of another
    kb, or of sources that ``allowed`` (query_id, source) lacks, are none either. With ``most``, those are enough of each kind of a
    question: each task then holds its items against all questions and hands on that many.
    """
    asked = query_terms(plan)
    if most is not None and allowed is None:
        asked = cut(asked)
        held = lexical.held(asked)
        if held is not None:
            plans = {r["query_id"]: (r["low"], r["kb"]) for r in plan.select("query_id", F.lower("question").alias("low"), "kb").limit(lexical.HELD_PAIRS).collect()}  # no more than questions that are held
            return _placed(lexical.items_best(items, held, plans, most))
    posting = items.select("item_id", F.explode("tokens").alias("term"))
    shared = asked.join(posting, "term").groupBy("query_id", "item_id").agg(F.count("*").alias("overlap"))
    met = shared.join(plan.select("query_id", F.lower("question").alias("low"), F.col("kb").alias("asked_kb")), "query_id").join(items, "item_id")
    met = met.where("asked_kb is null or source = '' or kb = '' or kb = asked_kb")
    if allowed is not None:
        scoped = allowed.select("query_id").distinct().withColumn("scoped", F.lit(True))
        met = met.join(scoped, "query_id", "left").join(allowed.withColumn("inside", F.lit(True)), ["query_id", "source"], "left").where("scoped is null or source = '' or inside").drop("scoped", "inside")
    surface = F.contains("low", F.lower("text"))
    score = F.col("overlap") + F.when(surface, 2.0).otherwise(0.0) + F.when(F.col("overlap") == F.size("tokens"), 0.75).otherwise(0.0) + 0.1 * F.col("priority")
    kept = met.where((F.col("overlap") > 1) | surface | (F.size("tokens") <= 3)).withColumn("score", F.round(score, 6))
    return _placed(kept.drop("low", "asked_kb"))


def _placed(kept: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("priority"), F.length("text"), "source", "item_id")
    return kept.withColumn("place", F.row_number().over(order))


def expanded(plan: DataFrame, items: DataFrame, allowed: DataFrame | None = None, per_kind: int = 2, most: int = 6) -> DataFrame:
    """Plans with what the best candidates add: at most ``per_kind`` items of a kind, ``most`` in all.

    Plans that name a symbol or a source already stay as they are. Symbols are added if the question asks for one, patterns if
    it asks for a file, names of all other items as keywords.
    """
    source_like = F.exists("keywords", lambda k: k.rlike(r"[*/\\]|^\.[^./]{1,7}$") | F.lower(k).rlike(r".\.(" + "|".join(SUFFIXES + BINARY) + ")$"))
    bare = plan.where((F.size("symbols") == 0) & ~source_like)
    found = candidates(bare, items, allowed, most)
    chosen = top(top(found, ["query_id", "kind"], ["place"], per_kind, "nth"), ["query_id"], ["place"], most, "ord").join(plan.select("query_id", "wants_symbol", "wants_file"), "query_id")
    symbols = chosen.where("kind = 'symbol' and symbol <> '' and wants_symbol").select("query_id", F.lit("symbols").alias("kind"), F.col("symbol").alias("value"), "ord")
    keywords = chosen.where("kind <> 'symbol'").select("query_id", F.lit("keywords").alias("kind"), F.col("text").alias("value"), "ord")
    globs = chosen.where("kind in ('file', 'section', 'concept', 'decision') and path_glob <> '' and wants_file").select("query_id", F.lit("path_globs").alias("kind"), F.col("path_glob").alias("value"), "ord")
    return merged(plan, symbols.unionByName(keywords).unionByName(globs))


def fed_back(plan: DataFrame, hits: DataFrame, neighbors: DataFrame, symbols: DataFrame, seeds: int = 3, hints: int = 4, extra: int = 6) -> DataFrame:
    """Plans with names of the first vector hits (query_id, source, rank) and of the files next to them (neighbors: src, dst, rank, bridges).

    The first ``hints`` files give their basename (if the question asks for a file) and the symbol that is called as the file is
    (if it asks for a symbol); symbols on the way to neighbours are added as well then.
    """
    first = top(hits.groupBy("query_id", "source").agg(F.min("rank").alias("r")), ["query_id"], ["r"], seeds, "ord").select("query_id", F.col("source").alias("node"), "ord")
    reach = graph.expand(neighbors, first, 1, extra=extra)
    hinted = reach.where(F.col("place") <= hints).select("query_id", F.col("node").alias("source"), "place").join(plan.select("query_id", "wants_symbol", "wants_file"), "query_id")
    base = T.basename(F.col("source"))
    files = hinted.where("wants_file").select("query_id", F.explode(F.array(F.struct(F.lit("path_globs").alias("kind"), F.concat(F.lit("*"), base, F.lit("*")).alias("value")), F.struct(F.lit("keywords").alias("kind"), base.alias("value")))).alias("a"), F.col("place").alias("ord")).select("query_id", "a.*", "ord")
    stem, low = graph.stem(F.col("source")), F.lower("name")
    alike = F.when((low == stem) | (F.lower("qualified_name") == stem), 0).when(F.endswith(stem, low) | F.endswith(low, stem), 1)
    named = hinted.where("wants_symbol").join(symbols.where("name <> ''").select("source", "name", "qualified_name", "line_start"), "source").withColumn("alike", alike).where("alike is not null")
    named = named.groupBy("query_id", "source", "place").agg(F.min(F.struct("alike", "line_start", "name")).alias("s")).select("query_id", F.lit("symbols").alias("kind"), F.col("s.name").alias("value"), F.col("place").alias("ord"))
    way = reach.where("hop = 1").join(neighbors.select("src", F.col("dst").alias("node"), "bridges"), ["src", "node"]).join(plan.where("wants_symbol").select("query_id"), "query_id")
    way = way.select("query_id", F.explode("bridges").alias("b"), "place").where("b.type = 'symbol' and b.name <> ''").select("query_id", F.lit("symbols").alias("kind"), F.col("b.name").alias("value"), (F.col("place") + 1000).alias("ord"))
    return merged(plan, files.unionByName(named).unionByName(way))
