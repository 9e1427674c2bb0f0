"""Queries beside their SQL on small tables that hold what larger ones do: white space, repeats, ties, many rows of one key."""

from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessellum.functions import text as T
from tessellum.operators import cuts, lexical
from tessellum.plans import catalog
from test_catalog import ordered, shown


@pytest.fixture
def same(spark, tmp_path):
    """A function that writes tables ({name: rows as dicts}) and holds queries beside their SQL on them; gives the rows."""

    def run(tables, *names):
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        for name, rows in tables.items():
            columns = rows if isinstance(rows, pa.Table) else pa.Table.from_pylist(rows)
            pq.write_table(columns, tmp_path / f"{name}.parquet")
            con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
        for name in names:
            df = catalog.queries()[name](spark, str(tmp_path))
            own = sorted(df.columns)
            got = ordered(tuple(shown(r[c]) for c in own) for r in df.collect())
            found = con.execute(catalog.oracle_sql()[name])
            columns = [d[0] for d in found.description]
            assert sorted(columns) == own
            assert got == ordered(tuple(shown(x[columns.index(c)]) for c in own) for x in found.fetchall()), name
        return got

    return run


def documents(texts, **more):
    return [{"doc_id": i, "text": t, "lang": "en", "source": f"src{i % 3}", "n_chars": len(t or "")} | more for i, t in enumerate(texts)]


def test_chunks_of_white_space(same):
    long = "x" * 1300
    texts = [f"{long}\n\n{long}", f"\n{long}", f"{long}\n", f"{long}\n \t\n{long}\nend", "", " ", "a\nb", None]
    same({"documents": documents(texts)}, "line_chunks_fixed", "chunk_cap_head", "chunk_cap_tail", "chunk_percentiles")


def test_nearest_vectors_with_copies_and_nulls(spark, same):
    rows = [{"vec_id": i, "embedding": [float((i * j) % 7) / 7 for j in range(8)], "label": i % 3} for i in range(61)]
    rows += [{"vec_id": 100 + i, "embedding": [0.5] * 8, "label": 1} for i in range(40)] + [{"vec_id": 200, "embedding": [0.5] * 8, "label": None}]
    few = rows[:5] + [{"vec_id": 5, "embedding": None, "label": 0}]
    for table in (rows, few):
        kind = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())])
        same_rows = {"embeddings": pa.Table.from_pylist(table, kind)}
        same(same_rows, "vector_topk", "vector_topk_prefilter", *(["vector_postfilter_backfill"] if table is rows else []))


def test_nearest_vectors_broadcast_nothing(spark):
    plan = catalog.queries()["vector_topk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


ODD = ["", "a.b this", "this.that file_a b-c --- ... ._. x.y.z", "中文字符 中文 一二三四五六七 a中b", "İstanbul Kelvin", "The THE the. THIS.file.docs :config: a..b __init__ ../x/y.py", "é.a.this.é ÑANDÚ ñandú", "a.b" * 3000, "x" * 70000, "(word) `word` \"w0rd'", None]


def plan_of(spark, name, folder="/root/testdata/sf0.001"):
    return catalog.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()


def test_terms_of_workers_are_those_of_columns(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    for text, terms in df.select("text", T.terms(F.col("text"))).collect():
        assert Counter(terms) == Counter({t.decode(): n for t, n in lexical.counted((text or "").encode()).items()})


def test_words_and_terms_leave_their_row_only_to_be_summed(spark):
    for name in ("term_frequency", "ordered_distinct_ci"):
        assert "Exchange" not in plan_of(spark, name), name
    for name in ("shared_token_edges", "graph_tokens"):
        plan = plan_of(spark, name)
        assert "Join" not in plan and "hashpartitioning(doc_id" not in plan, name


def test_no_text_is_shuffled_for_the_kb_of_a_question(spark):
    assert "SortMergeJoin" not in plan_of(spark, "grep_hits_batch")


def test_texts_of_odd_words_and_shared_ids(same):
    docs = documents(ODD[1:3] + ODD[5:6] + ["the thing is the thing", "thing eaux", "ung and ung", "the thing is the thing"])
    bench = [{"item_id": i, "text": t} for i, t in enumerate(["the thing is", "is the thing", "eaux", "ung"])]
    tables = {"documents": docs, "benchmark": bench}
    same(tables, "term_frequency", "idf_table", "graph_tokens", "ordered_distinct_ci", "bm25_batch_probes", "bm25_stored", "probe_recall", "mode_jaccard", "shared_token_edges", "neighbor_top8", "query_expansion_rank")
    same({"documents": docs + docs[:2], "benchmark": bench}, "term_frequency", "graph_tokens")


def test_line_items_are_dealt_to_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(cuts, "SHARE", 100)
    for name in ("two_hop_neighbors", "import_resolution"):
        assert ", REPARTITION_BY_NUM" in plan_of(spark, name), name
