"""The stored corpus, its graphs and the retrieval entry on a small folder."""

import json

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import corpus_fixture
from tessellum import diagnose, engine, service, store, wiki
from tessellum.operators import community, entity, graph, planning, search
from tessellum.sources import corpus

cloudpickle.register_pickle_by_value(corpus_fixture)


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    src = corpus_fixture.write(tmp_path_factory.mktemp("corpus"))
    out = str(tmp_path_factory.mktemp("index"))
    files = corpus.from_directory(spark, src)
    store.build(spark, files, out, {"model": "a"}, extract=corpus_fixture.extract)
    return src, out


@pytest.fixture(scope="module")
def bundle(spark, root):
    return store.load(spark, root[1])


def test_tables(spark, root, bundle):
    paths = {r["rel_path"] for r in bundle.files.collect()}
    assert paths == set(corpus_fixture.FILES) - {"node_modules/ignored.py"}
    text = {r["rel_path"]: r["text"] for r in bundle.files.collect()}
    assert "service.api_key = cortex-secret" in text["产品/settings.yaml"] and "service.hosts[1] = b.example" in text["产品/settings.yaml"]
    ids = {r["id"] for r in bundle.nodes.collect()}
    assert "symbol:工程/bootstrap_session.py:function:bootstrap_session:4" in ids and "section:工程/session_playbook.md:0" in ids
    assert not bundle.symbols.where("source like '%invalid%'").count()
    chat = bundle.chunks.where("source like '%group.md'").orderBy("chunk_index").collect()
    assert [c["strategy"] for c in chat] == ["chat", "chat"] and chat[0]["text"] == "[10:00] Ann: hello there everyone\n[10:05] Bob: fine thanks"
    assert store.about(spark, store.current(spark, root[1]))["file_count"] == len(paths)


def test_entity_edges(bundle):
    e = {(r["source"], r["target"], r["type"]) for r in bundle.edges.collect()}
    symbol = "symbol:工程/bootstrap_session.py:function:bootstrap_session:4"
    assert ("section:工程/session_playbook.md:0", symbol, "references") in e
    assert ("section:工程/session_playbook.md:0", "file:工程/startup.md", "links_to") in e
    assert ("file:工程/bootstrap_session.py", symbol, "defines") in e
    assert any(s.startswith("symbol:工程/bootstrap_session.py:import") and t == "file:工程/helpers.py" and k == "imports" for s, t, k in e)
    assert ("file:产品/session_bridge.md", "file:工程/session_playbook.md", "mentions_path") in e
    boot, call = entity_id(bundle, "concept"), entity_id(bundle, "decision")
    assert (boot, call, "rationale_for") in e and ("file:工程/startup.md", boot, "semantically_related") in e
    node = bundle.nodes.where(F.col("id") == boot).first()
    assert [a.lower() for a in node["aliases"]] == ["boot", "boot sequence", "startup"] and node["summary"] == "how it starts"


def entity_id(bundle, kind):
    return bundle.nodes.where(F.col("type") == kind).first()["id"]


def test_neighbors(bundle):
    n = {(r["src"], r["dst"]): r for r in bundle.neighbors.collect()}
    assert n["工程/session_playbook.md", "工程/bootstrap_session.py"]["kind"] == "references"
    assert n["工程/bootstrap_session.py", "工程/helpers.py"]["kind"] == "imports"
    assert ("工程/startup.md", "工程/session_playbook.md") in n  # through the concept that both hold
    assert n["工程/session_playbook.md", "工程/bootstrap_session.py"]["bridges"][-1]["name"] == "bootstrap_session"


@pytest.fixture(scope="module")
def answers(spark, bundle):
    rows = [(0, "api_key 配置项在哪里定义", "产品"), (1, "`bootstrap_session()` 函数定义在哪", "工程"), (2, "看一下 settings.yaml 这个文件", None), (3, "boot sequence startup orchestration", None), (4, "", None)]
    asked = spark.createDataFrame(rows, "query_id long, text string, kb string")
    return engine.retrieve(bundle, asked)


def test_hybrid(answers):
    hits = {}
    for r in answers.hits.orderBy("query_id", "rank").collect():
        hits.setdefault(r["query_id"], []).append(r)
    assert (hits[0][0]["source"], hits[0][0]["match_kind"]) == ("产品/settings.yaml", "grep")
    assert (hits[1][0]["match_kind"], hits[1][0]["line_start"]) == ("ast", 4)
    assert hits[2][0]["source"] == "产品/settings.yaml" and any(h["match_kind"] in ("glob", "grep") for h in hits[2])
    assert "工程/startup.md" in {h["source"] for h in hits[3]}
    assert all(h["source"].startswith("产品/") for h in hits[0]) and max(len(h) for h in hits.values()) <= 6
    contexts = {r["query_id"]: r["context"] for r in answers.contexts.collect()}
    assert set(contexts) == set(range(5)) and contexts[0].startswith("[证据1] 产品/settings.yaml")
    assert answers.trace.where("step = 'step1' and stopped").count() == 5


def test_vector_and_agentic(spark, bundle):
    asked = spark.createDataFrame([(7, "boot sequence startup orchestration")], "query_id long, text string")
    found = engine.retrieve(bundle, asked, "vector")
    assert "工程/startup.md" in {r["source"] for r in found.hits.collect()} and found.trace.first()["reason"] == "vector_mode"
    model = lambda prompt: json.dumps({"rankings": [{"index": 1, "score": 0.9}, {"index": 0, "score": 0.1, "relevant": "false"}, {"index": 99}]})
    plan = lambda question: {"keywords": ["SessionStore"]}
    again = engine.retrieve(bundle, spark.createDataFrame([(1, "SessionStore"), (2, "zzz nothing zzz")], "query_id long, text string"), "agentic", planner=plan, model=model)
    trace = {(r["query_id"], r["step"]): r for r in again.trace.collect()}
    assert trace[1, "step1"]["rerank"] in ("ok", "fallback") and again.hits.where("query_id = 1").count() > 0
    with pytest.raises(ValueError):
        engine.retrieve(bundle, asked, "other")


def test_rerank_payload():
    text = '```json\n{"rankings": [{"index": 0, "score": "x"}, {"index": 5}, {"index": 1, "relevant": "no"}, {"score": 1}, {"index": "2", "score": 2, "relevant": false}]}\n```'
    assert search.rankings(text, 3) == [(0, 0.0, True), (1, 0.0, False), (2, 2.0, False)]
    for bad in ("no json", '{"x": 1}', "[1]"):
        with pytest.raises(ValueError):
            search.rankings(bad, 3)


def test_rerank_order(spark):
    hits = spark.createDataFrame([(0, "bm25", f"s{i}", 1, 1, f"text {i}", 1.0, False, False, i + 1) for i in range(5)], search.HIT)
    asked = spark.createDataFrame([(0, "q")], "query_id long, text string")
    answer = '{"rankings": [{"index": 3, "score": 0.9}, {"index": 0, "score": 0.5, "relevant": false}, {"index": 2, "score": 0.7}]}'
    out, status = search.reranked(hits, asked, 5, lambda prompt: answer)
    assert [r["source"] for r in out.orderBy("rank").collect()] == ["s3", "s2", "s1", "s4", "s0"] and status.first()["status"] == "ok"
    for model, expected in ((None, "disabled"), (lambda prompt: 1 / 0, "fallback")):
        out, status = search.reranked(hits, asked, 2, model)
        assert [r["source"] for r in out.orderBy("rank").collect()] == ["s0", "s1"] and status.first()["status"] == expected


def test_communities(bundle, spark):
    relations = graph.cut(entity.project_files(bundle.doc_edges, bundle.nodes, bundle.edges))
    member = graph.cut(community.members(bundle.files, relations))
    rows = {r["rel_path"]: r["community"] for r in member.collect()}
    assert len({rows[p] for p in ("工程/startup.md", "工程/session_playbook.md", "工程/bootstrap_session.py", "产品/session_bridge.md", "工程/helpers.py")}) == 1
    assert rows["工程/startup.md"] == 1 and rows["聊天/group.md"] != 1
    first = community.top_files(member, relations).where("community = 1 and rank = 1").first()
    assert first["degree"] >= 3
    topics = community.top_topics(member, bundle.nodes, bundle.edges)
    assert {r["type"] for r in topics.where("community = 1").collect()} == {"concept", "decision"}
    summary = community.summaries(member, community.top_files(member, relations), community.top_symbols(member, bundle.nodes, bundle.edges), topics)
    one = summary.where("community = 1").first()
    assert one["label"].lower() == "boot" and len(one["suggested"]) == 3 and set(one["kbs"]) == {"产品", "工程"}
    text = community.report(summary, community.god_nodes(relations), community.bridges(member, relations), community.semantic_counts(bundle.nodes, bundle.edges))
    assert text.startswith("# Graph report\n\nConcepts: 1; decisions: 1; notes: 0")


def test_series(spark):
    files = spark.createDataFrame([("工程/bootstrap_session.py",), ("工程/bootstrap_session_helper.py",), ("工程/session_helper.py",), ("x/bootstrap_session.py",)], "rel_path string")
    found = {(r["src"], r["dst"]) for r in graph.same_series(files).collect()}
    a, b, c = (f"工程/{x}.py" for x in ("bootstrap_session", "bootstrap_session_helper", "session_helper"))
    assert found == {(a, b), (b, a), (b, c), (c, b)}


def test_resolve(spark):
    files = spark.createDataFrame([("a/b/x.md",), ("a/y.md",), ("z.md",)], "rel_path string")
    refs = spark.createDataFrame([("a/b/x.md", "../y.md"), ("a/b/x.md", "./x.md#top"), ("a/b/x.md", "../../z.md?q"), ("a/y.md", "/z.md"), ("a/y.md", "q/x.md"), ("a/y.md", "http://x.md"), ("a/y.md", "no.md")], "source string, reference string")
    got = {r["reference"]: r["target"] for r in graph.resolve(refs, files).collect()}
    assert got == {"../y.md": "a/y.md", "./x.md#top": "a/b/x.md", "../../z.md?q": "z.md", "/z.md": "z.md", "q/x.md": "a/b/x.md", "no.md": None}


def test_tiers_against_rows(spark):
    known = [("t1", "f", "k", "n"), ("t2", "g", "k", "n"), ("t3", "g", "k", "m"), ("t4", "h", "l", "m"), ("t5", "h", "l", "o"), ("t6", "h", "l", "p"), ("t7", "h", "l", "p")]
    asked = [("f", "k", "n"), ("x", "k", "n"), ("x", "k", "m"), ("x", "z", "o"), ("h", "l", "p"), ("x", "z", "none")]
    got = {(r["source"], r["kb"], r["name"]): r["target"] for r in graph.tiered(spark.createDataFrame(asked, "source string, kb string, name string"), spark.createDataFrame(known, "target string, t_source string, t_kb string, name string")).collect()}
    assert got == {("f", "k", "n"): "t1", ("x", "k", "n"): None, ("x", "k", "m"): "t3", ("x", "z", "o"): "t5", ("h", "l", "p"): None, ("x", "z", "none"): None}


def test_plans():
    assert planning.rule_plan("看一下 settings.yaml 这个文件")["path_globs"] == ["*settings.yaml*", "*.yaml"]
    assert planning.rule_plan("where is `pkg.mod.run` and run_it()?")["symbols"] == ["pkg.mod.run", "run", "run_it"]
    assert planning.rule_plan("python code")["path_globs"] == ["*.py"] and planning.rule_plan("python code")["keywords"] == ["code"]
    assert planning.rule_plan("") == {"symbols": [], "keywords": [], "path_globs": []}


def test_expansion(spark, bundle):
    plan = planning.plans(spark.createDataFrame([(0, "session playbook 在哪个文件"), (1, "`tool`")], "query_id long, text string"))
    out = {r["query_id"]: r for r in planning.expanded(plan, bundle.items).collect()}
    assert "*session_playbook.md*" in out[0]["path_globs"] and out[0]["symbols"] == []
    assert out[1]["symbols"] == ["tool"] and out[1]["keywords"] == ["tool"]


def test_rebuild(spark, root):
    src, out = root
    files = corpus.from_directory(spark, src)
    assert store.rebuild_state(spark, out, files, {"model": "a"}) == (False, "up_to_date")
    assert store.rebuild_state(spark, out, files, {"model": "b"}) == (True, "build_config_changed")
    assert store.rebuild_state(spark, out, files.limit(3), {"model": "a"}) == (True, "source_changed")
    assert store.rebuild_state(spark, out + "/none", files) == (True, "missing_index")
    change = store.compare_snapshots(files.select("rel_path", "length", F.col("modificationTime").alias("modified")), files.where("rel_path not like '%helpers%'").select("rel_path", "length", F.col("modificationTime").alias("modified")))
    assert [tuple(r) for r in change.collect()] == [("工程/helpers.py", "gone")]


def test_notes_and_pages(spark, root, bundle):
    _, out = root
    before = store.signature(spark, out)
    first = wiki.save_note(spark, out, "How to start?", "Call it.", ["工程/startup.md", "none.md"])
    second = wiki.save_note(spark, out, "How to start?", "Call it again.", ["工程/startup.md"])
    assert first.endswith("-how-to-start.md") and second.endswith("-how-to-start-2.md") and store.signature(spark, out) != before
    with pytest.raises(ValueError):
        wiki.save_note(spark, out, " ", "x", [])
    nodes, edges = entity.merge_notes(bundle.nodes, bundle.edges, wiki.notes(spark, out))
    nodes, edges = graph.cut(nodes), graph.cut(edges)
    assert nodes.where("type = 'query_note'").count() == 2
    pairs = {(r["source"], r["target"]) for r in edges.collect()}
    assert (f"query_note:{first}", "file:工程/startup.md") in pairs and (entity_id(bundle, "concept"), f"query_note:{first}") in pairs
    again = entity.merge_notes(nodes, edges, wiki.notes(spark, out).limit(0))
    assert again[0].where("type = 'query_note'").count() == 0 and again[1].count() == bundle.edges.count()
    report = wiki.lint(bundle.pages, bundle.files)
    summary = wiki.lint_summary(report).first()
    assert summary["missing_links"] == 0 and summary["stale_pages"] == 0
    broken = bundle.pages.where("relpath <> 'files/工程/startup.md.md'")
    assert {r["problem"] for r in wiki.lint(broken, bundle.files).where("page like '%startup%' or detail like '%startup%'").collect()} == {"missing_link", "stale"}


def test_markdown():
    assert wiki.links("[a](x.md)\n```\n[b](y.md)\n```\n[c](z.md)") == ["x.md", "z.md"]
    assert wiki.slug("  How to START?? 你好 ") == "how-to-start-你好" and wiki.slug("??") == "query-note"
    assert wiki.inline_code("a`b") == "``a`b``" and wiki.code_block("x\n```") == "~~~text\nx\n```\n~~~"
    assert wiki.page_source("../files/a%20b.md.md#x") == "a b.md" and wiki.page_kind("entities/x.md") == "entity" and wiki.page_kind("x.md") == ""
    note = "# Q\n- 生成时间：`2024`\n- 标签：`a` `b`\n\n## 结论\nyes\n\n## 来源\n- 来源文件：[a\\[1\\].md](../files/a.md)\n"
    assert wiki.parse_note(note, "queries/q.md") == ("query_note:queries/q.md", "Q", "yes", "yes", "queries/q.md", "2024", ["a", "b"], ["a[1].md"])


def test_diagnose(spark, root, bundle):
    text = diagnose.diagnose(spark, root[1], 5)
    assert "recall:" in text and "missing tables" not in text
    flags = diagnose.red_flags(spark.createDataFrame([("a", 60, 100.0), ("b", 1, 60.0)], "name string, chunks long, size_kb double"), spark.createDataFrame([("c", ""), ("c", "chunk"), ("d", "code")], "source string, kind string"))
    assert {(r["flag"], r["name"]) for r in flags.collect()} == {("many_tiny_chunks", "a"), ("one_large_chunk", "b"), ("all_generic", "c")}


def test_service(spark, root):
    one = service.Service(spark, root[1])
    assert one.health()["ready"] and one.kbs() == ["产品", "工程", "聊天"]
    found = one.ask("where is `bootstrap_session` defined", kb="工程", top_k=3)
    assert found["hits"][0]["match_kind"] == "ast" and "[证据1]" in found["context"]
    for bad in ({"question": " "}, {"question": "x", "mode": "no"}, {"question": "x", "top_k": 0}, {"question": "x", "kb": "none"}):
        with pytest.raises(ValueError):
            one.ask(**bad)
    index = one.wiki_index()
    assert index["counts"]["file"] == 8 and "- files: 8" in index["text"]
    path = one.save_query("Which order?", "Startup first.", ["工程/startup.md"])
    assert one.wiki_page(path)["title"] == "Which order?" and one.bundle().nodes.where("type = 'query_note'").count() >= 1
    with pytest.raises(KeyError):
        one.wiki_page("none.md")
    with pytest.raises(ValueError):
        one.wiki_page("../x")
    assert one.graph_report().startswith("# Graph report") and list(one.ask_stream("startup", lambda prompt: iter(["a", "b"]))) == ["a", "b"]


def test_chat_windows():
    from datetime import datetime, timedelta

    from tessellum.operators import chat

    at = lambda minutes, chars: {"ts": datetime(2024, 1, 1) + timedelta(minutes=minutes), "content": "x" * chars}
    sizes = lambda *m: [len(w) for w in chat.windows_of([at(*x) for x in m])]
    assert sizes((0, 100), (2, 100), (4, 100)) == [3] and sizes((0, 200), (240, 200)) == [1, 1]
    assert sizes((0, 2000), (35, 1500)) == [1, 1] and sizes((0, 1500), (35, 100)) == [2] and len(sizes(*[(35 * k, 60) for k in range(6)])) < 6
    assert chat.parse("no header\n") == [] and chat.parse("")  == []


def test_graph_reaches_targets(spark):
    """Twenty notes that only cite a symbol reach the file that defines it, in one hop and twelve more files."""
    rows = []
    for k in range(20):
        rows += [(f"notes/q{k:02d}.md", "notes", "md", f"# Question {k}\n\nHow does `target_fn_{k}()` behave here? See `target_fn_{k}`."), (f"src/impl_{k:02d}.py", "src", "py", f"def target_fn_{k}(x):\n    return x + {k}\n")]
    files = spark.createDataFrame(rows, "rel_path string, kb string, suffix string, text string")
    from tessellum.operators import chunk

    chunks, symbols = graph.cut(chunk.indexed_chunks(files)), graph.cut(chunk.symbols(files))
    documents = graph.cut(graph.document_graph(files, symbols))
    nodes, edges = entity.build(files, chunks, symbols, documents.where("kind in ('links_to', 'mentions_path')"))
    near = graph.cut(entity.file_neighbors(graph.cut(nodes), graph.cut(edges)))
    seeds = spark.createDataFrame([(k, f"notes/q{k:02d}.md", 1) for k in range(20)], "query_id long, node string, ord int")
    got = {(r["query_id"], r["node"]) for r in graph.expand(near, seeds, 1, extra=12).collect()}
    assert sum((k, f"src/impl_{k:02d}.py") in got for k in range(20)) == 20
