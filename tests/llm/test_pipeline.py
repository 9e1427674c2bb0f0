"""The pipeline: each stage on what the one before kept, its decisions taking effect."""

import corpus_pipeline
from tessellum.llm import queries

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "mixing sources", "BPE"]
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, DATA)
        assert after.columns == docs.columns
        rows = after.collect()
        kept.append(rows)
        docs = spark.createDataFrame(rows, docs.schema)
    toxic, lines, near, mixed = kept
    assert 0.8 * len(before) <= len(toxic) <= len(before)
    assert len(lines) == len(toxic) and sum(r["n_chars"] for r in lines) < sum(r["n_chars"] for r in toxic)
    assert len({r["doc_id"] for r in near}) == len(near) <= len(lines)
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in near} and max(sum(r["doc_id"] == i for r in mixed) for i in {r["doc_id"] for r in mixed}) <= 3
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_registered():
    assert {f"op{n}_" for n in range(1, 11)} == {"_".join(k.split("_")[:1]) + "_" for k in queries.queries() if k.startswith("op")}


def test_run_with_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows and clashing names through all stages, against what the stages must leave."""
    base = [(i, f"line {i} of a plain text with words w{i} v{i * 7} u{i * 13}\nshared closing line of many words here", "en", f"s{i % 3}", 0, "x") for i in range(40)]
    odd = [(100, None, "en", "s0", None, "x"), (101, "", "en", None, 0, "x"), (None, "a row without any id at all", "en", "s1", 0, "x"), (102, " \n ", None, "s2", 0, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, gone string"
    docs = spark.createDataFrame(base + odd + base[:2], schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, i % 2) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    first = corpus_pipeline.STAGES[1][1](spark, docs, str(tmp_path))
    assert first.columns == docs.columns and first.count() == 46
    texts = [r["text"] for r in first.collect()]
    assert sum("shared closing line" in (t or "") for t in texts) <= 2  # of one document, which stands there twice
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    rows = out.collect()
    assert {r["doc_id"] for r in rows} <= {r[0] for r in base + odd}


def test_lines_of_repeated_ids(frame):
    from tessellum.llm import line_dedup

    rows = [(1, "a line that stands in two places of this table"), (2, "A line that stands in two places of  this table\na wholly unique and different sentence"), (2, "another wholly unique sentence in a row of its own"), (None, "a line that stands in two places of this table\nthe last words of the row without an id")]
    got = sorted(r["text"] for r in line_dedup.dedup_lines(frame(rows)).collect())
    assert got == ["a line that stands in two places of this table", "a wholly unique and different sentence", "another wholly unique sentence in a row of its own", "the last words of the row without an id"]
