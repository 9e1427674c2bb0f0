"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

Toxic documents go, near-equal lines go, one document of each near-duplicate group stays, sources are mixed to their
target weights, and what is left is encoded. All but the last stage return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessellum.llm import bpe, line_dedup, mixing, simhash, toxicity
from tessellum.llm.common import Cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts toxic go; null and empty texts are scored by its bias alone, rows that repeat an id each for themselves."""
    return toxicity.drop_toxic(spark, docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that others stand for go, no document does; null texts and ids, repeated rows and extra columns as ``line_dedup.dedup_lines`` says."""
    return line_dedup.dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays; texts without words are near copies of each other; rows with a null id stay."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; texts without words and rows of no source quota are never taken; a null source is a source."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of ids and of what they decode to; null and empty texts have no ids."""
    return bpe.digests(bpe.encode(spark, docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("BPE", encode),
]

#: Trained models, fuzzy components and random draws have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one. Each stage's table is deleted once the next one is written.

    An empty table goes through all stages and gives no rows.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        now = Cut(stage(spark, docs, sf_dir), f"pipeline-{k}")
        if last is not None:
            last.drop()
        docs, last = now.df, now
    return docs
