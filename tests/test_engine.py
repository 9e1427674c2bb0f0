"""Sources, chunkers, streams and text functions on inline inputs."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessellum.functions import text as T
from tessellum.operators import chunk, graph, retrieve
from tessellum.sources import corpus


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_terms(spark):
    found = lambda t: sorted(value(spark, T.terms(F.lit(t))))
    assert found("Read the API_key: v1.2 in ./settings.yaml") == sorted(["read", "the", "api", "key", "v1", "in", "yaml"])
    assert found("a-b this this-that x") == ["a-b", "this-that"]
    assert found("配置项") == sorted(["配置", "置项", "配置项"])
    assert found("") == [] and value(spark, T.terms(F.lit(None).cast("string"))) == []


def test_small_functions(spark):
    assert value(spark, T.ordered_distinct(F.array(*[F.lit(x) for x in (" b", "a", "B", "", "A ")]))) == ["b", "a"]
    assert [value(spark, T.line_score(F.lit(x), "api_key")) for x in ("api_key", "an api_key here", "my_api_keys", "none")] == [1.2, 1.0, 0.75, 0.0]
    assert value(spark, T.line_label(F.lit(3), F.lit(5))) == "L3-L5" and value(spark, T.line_label(F.lit(3), F.lit(3))) == "L3"
    assert value(spark, T.normalized(F.lit(" a \r\nb\t\r\n"))) == "a\nb"


def test_directory(spark, tmp_path):
    for path, body in {"eng/a.md": "# A\ntext", "eng/node_modules/x.py": "x = 1", "prod/s.json": '{"service": {"api_key": "k", "list": [1, {}]}}', "prod/skip.txt": "no", "prod/b.bin": "\x00"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(body)
    found = {r["rel_path"]: r for r in corpus.from_directory(spark, str(tmp_path), exclude=("skip*",)).collect()}
    assert set(found) == {"eng/a.md", "prod/s.json"}
    assert found["prod/s.json"]["text"] == 'service.api_key = k\nservice.list[0] = 1' and found["prod/s.json"]["kb"] == "prod"


def test_chunkers():
    text = "intro\n# One\n" + "line of text\n" * 20 + "## Two\nend"
    pieces = list(chunk.split(text, "heading", 120, 0))
    assert [p.label for p in pieces][0] == "preface" and {p.label for p in pieces} == {"preface", "One", "Two"}
    assert [p.first for p in pieces] == sorted(p.first for p in pieces)
    assert chunk.is_meeting("10:00 Ann: hi\n10:01 Bob: yes") and not chunk.is_meeting("title: x\nauthor: y\ndate: z")
    kinds = [p.kind for p in chunk.blocks("a\n\n```\ncode\n\nmore\n```\n| x | y |\n|---|---|\n- item\n  rest\n> q".split("\n"), True, False)]
    assert kinds == ["paragraph", "code", "table", "list", "quote"]


def test_python_symbols():
    found = chunk.python_symbols("import os\nclass A:\n    def f(self):\n        pass\nasync def g():\n    pass\n", "m")
    assert [(k, q, a) for k, _, q, a, *_ in found] == [("module", "m", 1), ("import", "os", 1), ("class", "A", 2), ("function", "A.f", 3), ("function", "g", 5)]
    assert chunk.python_symbols("def (", "m") == []
    assert [p.label for p in chunk.python_chunks("x = 1\ndef f():\n    pass", 100, 0)] == ["module prelude", "f"]


def test_neighbor_cap(spark):
    edges = spark.createDataFrame([(0, k, 1, 0) for k in range(1, 11)] + [(0, 99, 1, 1)], "src long, dst long, priority long, same_kb long")
    kept = {r["dst"] for r in graph.capped_neighbors(edges).collect()}
    assert len(kept) == 8 and 99 in kept


def test_fusion_order(spark):
    hits = spark.createDataFrame([(0, "bm25", 1, "s", 1, False, False), (0, "grep", 2, "s", 1, True, False), (0, "ast", 3, "s", 1, False, False), (0, "glob", 1, "s", 2, False, True)], "query_id long, match_kind string, key long, source string, rank int, exact_symbol boolean, exact_path boolean")
    assert [r["key"] for r in retrieve.fuse(hits, 6).orderBy("rank").collect()] == [2, 1]


@pytest.mark.parametrize("gap, windows", [(2, 1), (240, 3)])
def test_stream(spark, tmp_path, gap, windows):
    from tessellum.streaming import chat

    start = datetime(2024, 1, 1)
    rows = [(1, start + timedelta(minutes=gap * k), 100) for k in range(3)] + [(2, start + timedelta(days=3), 1)]
    for n, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, "key long, ts timestamp, chars long").coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    stream = spark.readStream.schema("key long, ts timestamp, chars long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    name = f"windows_{gap}"
    query = chat.anchored_windows(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert spark.table(name).where("key = 1").count() == windows


def test_stream_of_chunks(spark, tmp_path):
    from tessellum.streaming import chat

    start = datetime(2024, 1, 1, 10)
    rows = [(1, start + timedelta(minutes=2 * k), "Ann", f"text {k}") for k in range(3)] + [(1, start + timedelta(hours=9), "Bob", "late"), (2, start + timedelta(days=3), "Cy", "other")]
    schema = "key long, ts timestamp, sender string, content string"
    for n, part in enumerate((rows[:2], rows[2:4], rows[4:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = chat.chat_chunks(stream).writeStream.format("memory").queryName("chat_chunks").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = {r["text"]: r["label"] for r in spark.table("chat_chunks").where("key = 1").collect()}
    assert got["[10:00] Ann: text 0\n[10:02] Ann: text 1\n[10:04] Ann: text 2"] == "2024-01-01 10:00 ~ 2024-01-01 10:04"
