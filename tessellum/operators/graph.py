"""Graphs of files: references, resolution, shared tokens, neighbour caps, traversal, components, hubs and bridges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..conf import CONF, EDGE_PRIORITY, EngineConf
from ..functions import text as T
from .cuts import cut
from .retrieve import top


def folded(path: Column) -> Column:
    """A path with one kind of slash, without empty and ``.`` parts, ``..`` taken back where there is something before it."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", "."))
    step = lambda a, p: F.when((p == "..") & (F.size(a) > 0) & F.coalesce(F.try_element_at(a, F.lit(-1)) != "..", F.lit(False)), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, p))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def references(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, reference): targets of Markdown and HTML links (links_to) and what looks like a path (mentions_path), each once."""
    found = lambda pattern, group, kind: F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(group)), lambda r: F.struct(F.lit(kind).alias("kind"), F.trim(r).alias("reference")))
    every = F.concat(found(T.MD_LINK, 1, "links_to"), found(T.HREF, 1, "links_to"), found(T.PATH_REF, 0, "mentions_path"))
    return texts.select(*keys, F.explode(F.array_distinct(every)).alias("r")).select(*keys, "r.*").where("reference <> ''")


def hrefs(pages: DataFrame) -> DataFrame:
    """(page_id, url, href) of every link, repeats left out."""
    return pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(T.HREF), F.lit(1))).alias("href")).distinct()


def path_references(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(T.PATH_REF), F.lit(0))).alias("reference")).distinct()


def resolve(references: DataFrame, files: DataFrame) -> DataFrame:
    """(references.*, target): by exact path, beside the source (``.`` and ``..`` folded), or by a basename that only one file has; else null."""
    known = files.select(F.col("rel_path").alias("target")).distinct()
    unique = known.groupBy(T.basename(F.col("target")).alias("base")).agg(F.count("*").alias("n"), F.min("target").alias("by_base")).where("n = 1").drop("n")
    bare = F.regexp_replace(F.replace("reference", F.lit("\\"), F.lit("/")), r"[#?].*$", "")
    ask = references.withColumn("bare", F.when(~F.col("reference").rlike(r"^(#|[A-Za-z][A-Za-z0-9+.-]*:)"), bare)).where("bare is not null and bare <> '' and bare <> '/'")
    parent = F.regexp_extract("source", r"^(.*)/[^/]*$", 1)
    ask = ask.withColumn("clean", folded(F.col("bare"))).withColumn("beside", folded(F.when(F.col("bare").startswith("/") | (parent == ""), F.col("bare")).otherwise(F.concat_ws("/", parent, F.col("bare")))))
    found = ask.join(known.withColumnRenamed("target", "exact"), F.col("clean") == F.col("exact"), "left").join(known.withColumnRenamed("target", "near"), F.col("beside") == F.col("near"), "left").join(unique, T.basename(F.col("clean")) == F.col("base"), "left")
    return found.select(*references.columns, F.coalesce("exact", "near", "by_base").alias("target"))


def stem(path: Column) -> Column:
    """The basename without its last suffix, lower-cased."""
    return F.lower(F.regexp_replace(T.basename(path), r"(?<=.)\.[^.]*$", ""))


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def same_series(files: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(src, dst, reason): files of one folder whose stems contain each other or share two tokens; from ``seeds`` (src) only, if given.

    Stems meet by a shared token, or by the stem that starts at any place of the other one: no pair of strangers is looked at.
    The reason is the shared tokens, or the other stem.
    """
    own = files.select("rel_path").distinct().select("rel_path", parent(F.col("rel_path")).alias("dir"), stem(F.col("rel_path")).alias("stem"))
    left = own if seeds is None else own.join(seeds.select(F.col("src").alias("rel_path")).distinct(), "rel_path", "left_semi")
    inside = F.flatten(F.transform(F.sequence(F.lit(1), F.length("stem")), lambda i: F.transform(F.sequence(i, F.length("stem")), lambda j: F.substring("stem", i, j - i + 1))))
    parts = lambda df: df.where("stem <> ''").select("rel_path", "dir", "stem", F.explode(F.array_distinct(inside)).alias("part"))
    whole = lambda df: df.where("stem <> ''").select(F.col("rel_path").alias("other"), F.col("dir").alias("dir2"), F.col("stem").alias("stem2"))
    meets = (F.col("dir") == F.col("dir2")) & (F.col("part") == F.col("stem2")) & (F.col("rel_path") != F.col("other"))
    holds = parts(left).join(whole(own), meets).select(F.col("rel_path").alias("src"), F.col("other").alias("dst"), "stem", "stem2")
    held = parts(own).join(whole(left), meets).select(F.col("other").alias("src"), F.col("rel_path").alias("dst"), F.col("stem2").alias("stem"), F.col("stem").alias("stem2"))
    tokens = lambda df, name: df.select("rel_path", "dir", "stem", F.explode(T.stem_tokens(F.col("stem"))).alias("token")).withColumnsRenamed({"rel_path": name, "stem": f"stem_{name}", "dir": f"dir_{name}"})
    met = tokens(left, "a").join(tokens(own, "b"), "token").where("dir_a = dir_b and a <> b").groupBy("a", "b", "stem_a", "stem_b").agg(F.count("*").alias("n")).where("n >= 2")
    every = holds.unionByName(held).unionByName(met.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("stem_a").alias("stem"), F.col("stem_b").alias("stem2"))).distinct()
    shared = F.array_join(F.array_sort(F.array_intersect(T.stem_tokens(F.col("stem")), T.stem_tokens(F.col("stem2")))), ",")
    return every.select("src", "dst", F.when(shared != "", shared).otherwise(F.col("stem2")).alias("reason"))


def shared_tokens(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(source, token) that may link files: names of symbols, keys of structured files, code spans and calls in texts."""
    text = F.coalesce("text", F.lit(""))
    keys = F.when(F.col("suffix").isin("json", "yaml", "yml", "toml", "ini"), F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^([^=\n]+?) = "), F.lit(1)), lambda k: F.split(F.regexp_replace(k, r"\[\d+\]", ""), r"\.")))).otherwise(F.array().cast("array<string>"))
    spans = F.concat(keys, F.regexp_extract_all(text, F.lit(T.CODE_SPAN), F.lit(1)), F.regexp_extract_all(text, F.lit(T.CALL), F.lit(1)))
    named = symbols.where("kind <> 'import'").select(F.col("source"), F.col("name").alias("raw"))
    every = files.select(F.col("rel_path").alias("source"), F.explode(F.array_distinct(spans)).alias("raw")).unionByName(named)
    return every.select("source", T.graph_token(F.col("raw")).alias("token")).where("token is not null").distinct()


def document_graph(files: DataFrame, symbols: DataFrame, conf: EngineConf = CONF) -> DataFrame:
    """(src, dst, kind, priority, reason, rank): the best edge of each pair of files, the first ``neighbors`` of each file.

    Links and path mentions, then shared tokens, then series; of equal priority the least reason stays.
    """
    asked = references(files.withColumnRenamed("rel_path", "source"), ["source"])
    linked = resolve(asked, files).where("target is not null").select(F.col("source").alias("src"), F.col("target").alias("dst"), "kind", F.col("reference").alias("reason"))
    tokens = shared_token_edges(shared_tokens(files, symbols), conf).select("src", "dst", F.lit("shared_symbol").alias("kind"), F.col("token").alias("reason"))
    series = same_series(files).select("src", "dst", F.lit("same_series").alias("kind"), "reason")
    priority = F.create_map(*[x for k, v in EDGE_PRIORITY.items() for x in (F.lit(k), F.lit(v))])
    every = linked.unionByName(tokens).unionByName(series).where("src <> dst").withColumn("priority", priority[F.col("kind")])
    best = every.groupBy("src", "dst").agg(F.min(F.struct("priority", "reason", "kind")).alias("e")).select("src", "dst", "e.*")
    same = (T.kb_of(F.col("src")) == T.kb_of(F.col("dst"))).cast("int")
    return top(best.withColumn("same_kb", same), ["src"], ["priority", F.desc("same_kb"), "dst"], conf.neighbors).select("src", "dst", "kind", "priority", "reason", "rank")


def shared_token_edges(tokens: DataFrame, conf: EngineConf = CONF) -> DataFrame:
    """(src, dst, token) for tokens (source, token) that 2 to 5 sources share: at most 20 pairs a token, so no group is large."""
    low, high = conf.shared_df
    rare = tokens.distinct().groupBy("token").agg(F.count("*").alias("df")).where(F.col("df").between(low, high)).select("token")
    own = tokens.distinct().join(rare, "token")
    other = own.select(F.col("token").alias("token2"), F.col("source").alias("dst"))
    return own.join(other, (F.col("token") == F.col("token2")) & (F.col("source") != F.col("dst"))).select(F.col("source").alias("src"), "dst", "token")


def pairs_of(tokens: DataFrame) -> DataFrame:
    """(src, dst, token): both ways each pair of a token's sources (token, sources), a few each."""
    one = tokens.select("token", "sources", F.explode("sources").alias("src"))
    return one.select("src", F.explode(F.filter("sources", lambda x: x != F.col("src"))).alias("dst"), "token")


def capped_neighbors(edges: DataFrame, conf: EngineConf = CONF) -> DataFrame:
    """edges (src, dst, priority, same_kb): one edge a pair, of the lowest priority; the first ``neighbors`` of each source stay."""
    best = edges.groupBy("src", "dst").agg(F.min("priority").alias("priority"), F.max("same_kb").alias("same_kb"))
    return top(best, ["src"], ["priority", F.desc("same_kb"), "dst"], conf.neighbors)


def expand(edges: DataFrame, seeds: DataFrame, hops: int, budget: int | None = None, extra: int | None = None) -> DataFrame:
    """(query_id, node, hop, src, place): breadth-first from ordered seeds (query_id, node, ord) along ranked edges (src, dst, rank).

    Nodes are taken in the order of their first parent and its ranks, first come, first kept, up to ``budget`` nodes of a
    query, or to ``extra`` nodes beside its seeds.
    """
    ordered = Window.partitionBy("query_id").orderBy("ord", "node")
    first = seeds.groupBy("query_id", "node").agg(F.min("ord").alias("ord"))
    seen = cut(first.select("query_id", "node", F.lit(0).cast("long").alias("hop"), F.lit(None).cast(dict(edges.dtypes)["src"]).alias("src"), F.row_number().over(ordered).cast("long").alias("place")))
    limit = seen.groupBy("query_id").agg(F.count("*").alias("seeds")).withColumn("most", F.lit(budget) if budget is not None else F.col("seeds") + F.lit(extra))
    for hop in range(1, hops + 1):
        edge = seen.where(F.col("hop") == hop - 1).select("query_id", F.col("node").alias("src"), "place").join(edges.select("src", "dst", "rank"), "src")
        fresh = edge.groupBy("query_id", F.col("dst").alias("node")).agg(F.min(F.struct("place", "rank", "src")).alias("by")).join(seen.select("query_id", "node"), ["query_id", "node"], "left_anti")
        before = seen.groupBy("query_id").agg(F.max("place").alias("before")).join(limit, "query_id")
        found = fresh.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("by", "node"))).join(before, "query_id").withColumn("place", F.col("before") + F.col("nth")).where("place <= most")
        seen = cut(seen.unionByName(found.select("query_id", "node", F.lit(hop).cast("long").alias("hop"), F.col("by.src").alias("src"), F.col("place").cast("long").alias("place"))))
    return seen.join(limit, "query_id").where("place <= most").select("query_id", "node", "hop", "src", "place")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) by minimum labels along edges (a, b) with jumps to the label's label; the least node names it.

    Labels are cut each round and edges are those between different labels, so a giant component's inner edges leave early.
    """
    pairs = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    label = cut(pairs.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("l")).withColumnRenamed("a", "node"))
    while True:
        near = pairs.join(label.select(F.col("node").alias("b2"), F.col("l").alias("lb")), F.col("b") == F.col("b2")).groupBy("a").agg(F.min("lb").alias("m")).withColumnRenamed("a", "n2")
        met = label.join(near, F.col("node") == F.col("n2"), "left").select("node", F.col("l").alias("was"), F.least("l", "m").alias("l"))
        # a label's own label: one row a label, so nothing is hot but the label side, which adaptive execution splits
        jump = met.select(F.col("node").alias("n3"), F.col("l").alias("l3"))
        after = cut(met.join(jump, F.col("l") == F.col("n3"), "left").select("node", "was", F.least("l", "l3").alias("l")))
        if after.where("l <> was").isEmpty():
            return after.select("node", F.col("l").alias("component"))
        label = after.select("node", "l")


def range_contains(sections: DataFrame, symbols: DataFrame, width: int = 64) -> DataFrame:
    """(source, section, first, last, symbol, line): symbols (source, symbol, line) that start inside a section (source, section, first, last).

    Lines are cut into buckets of ``width``, so a symbol meets the sections of its bucket only, not all of its file.
    """
    spread = sections.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.greatest("first", "last") / width))))
    own = symbols.withColumnRenamed("source", "s2").withColumn("bucket2", F.floor(F.col("line") / width))
    met = spread.join(own, (F.col("source") == F.col("s2")) & (F.col("bucket") == F.col("bucket2")) & F.col("line").between(F.col("first"), F.col("last")))
    return met.drop("s2", "bucket", "bucket2")


def tiered(asked: DataFrame, known: DataFrame) -> DataFrame:
    """References (source, kb, name) to known (target, t_source, t_kb, name): unique in the file, else in the kb, else at all.

    Targets are counted by each of the three keys first, so a reference meets one row a tier however many share its name.
    """
    def tier(keys: dict[str, str], name: str) -> DataFrame:
        one = known.select("target", "name", *keys).distinct().groupBy("name", *keys).agg(F.count("*").alias("n"), F.min("target").alias(name)).where("n = 1").drop("n")
        return one.withColumnsRenamed(keys | {"name": f"{name}_name"})

    t = asked.select("source", "kb", "name").distinct()
    for keys, name in (({"t_source": "file_at"}, "in_file"), ({"t_kb": "kb_at"}, "in_kb"), ({}, "at_all")):
        at = F.col("name") == F.col(f"{name}_name")
        for own, renamed in zip(("source",) if "t_source" in keys else ("kb",) if keys else (), keys.values()):
            at = at & (F.col(own) == F.col(renamed))
        t = t.join(tier(keys, name), at, "left")
    return t.select("source", "kb", "name", F.coalesce("in_file", "in_kb", "at_all").alias("target"))
