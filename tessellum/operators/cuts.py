"""Lineage cuts, and rows dealt to tasks of bounded size."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that the cluster names; a local one only on a local master where none is set."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        place = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not place and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(place or tempfile.mkdtemp(prefix="tessellum-"))
    conf, name = df.sparkSession.conf, "spark.sql.constraintPropagation.enabled"
    before = conf.get(name)
    conf.set(name, "false")  # Spark 4.1 fails to carry the constraints of some unions into a checkpoint
    try:
        return df.checkpoint()
    finally:
        conf.set(name, before)


#: Rows that a task is dealt.
SHARE = 200_000


def dealt(df: DataFrame, n: int, *keys: str | Column) -> DataFrame:
    """``df``, of about ``n`` rows, in partitions of about SHARE rows by keys, so that what a task holds does not grow with the input."""
    return df.repartition(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-n // SHARE)), *keys)
