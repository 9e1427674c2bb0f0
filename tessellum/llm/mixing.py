"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Targets: sources in code point order (null last) weigh 1, 2, 3, 1, 2, 3, ... and share all words by weight; a target
stops at three times its source's words, and what it leaves is shared by the others until none is above.

Blocks: a hash of the id deals each source's documents to ``BLOCKS`` blocks, whose order is thereby a random one. A source
is taken whole as often as its target holds it; the rest of the target is filled by the blocks, in that order, that still
fit (one that does not is passed over), then by single documents of the blocks left over, the largest that fits first, until
none fits, and is closed by the one further document, if any, whose size comes nearer to what is still missing.

Tree: the exact numbers of blocks drawn from every source are split between the two halves of the output shards by a
multivariate hypergeometric draw, each half again, down to single shards, so every shard gets an exact quota of every
source. A shard's quota is a run of the source's draws, so draws are disjoint; inside a shard rows follow a hash.

Only block sums (at most BLOCKS rows a source), counts by size and source sums meet; no source's documents are ever gathered.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Cut

BLOCK_BITS, SHARDS, SEED, MOST = 12, 64, 20, 3
BLOCKS = 1 << BLOCK_BITS
#: A block plan of at most so many rows (a few tens of bytes each) is sent to every executor; a larger one is shuffled.
BROADCAST_ROWS = 200_000


def _key(doc_id: Column) -> Column:
    return F.xxhash64(F.lit(SEED), doc_id)


def _block(doc_id: Column) -> Column:
    return F.shiftrightunsigned(_key(doc_id), 64 - BLOCK_BITS).cast("int")


def _size(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, n_blocks) -> also weight and target (double). One row a source: the only single-task sort."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
    filled = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    cap = MOST * F.col("source_size").cast("double")
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing))
    stepped = ranked.withColumn("level", level).withColumn("capped", F.col("level") * F.col("weight") >= cap)
    final = F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("weight"), F.col("level").alias("level")))).over(every)["level"]
    return stepped.withColumn("target", F.when(F.col("capped"), cap).otherwise(final * F.col("weight"))).drop("level", "capped")


def _tree(quotas: pd.DataFrame) -> pd.DataFrame:
    """(place, quota) of all sources -> (place, shard, start, n): the run of draws that each shard gets of each source."""
    quotas = quotas.sort_values("place")
    random = np.random.default_rng(SEED)
    out, done = [], np.zeros(len(quotas), np.int64)

    def hypergeometric(have: np.ndarray, draws: int) -> np.ndarray:
        got, rest = np.zeros_like(have), int(have.sum())
        for i, n in enumerate(have):
            rest -= int(n)
            got[i] = random.hypergeometric(int(n), rest, draws) if n and rest and draws else min(int(n), draws)
            draws -= int(got[i])
        return got

    def split(have: np.ndarray, first: int, past: int) -> None:
        nonlocal done
        if past - first == 1:
            out.append(pd.DataFrame({"place": quotas["place"].to_numpy(), "shard": first, "start": done, "n": have}))
            done = done + have
            return
        middle = (first + past) // 2
        left = hypergeometric(have, int(have.sum()) * (middle - first) // (past - first))
        split(left, first, middle)
        split(have - left, middle, past)

    split(quotas["quota"].to_numpy(np.int64), 0, SHARDS)
    return pd.concat(out)


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one source, (rank, words, n, missing) in order of rank: adds taken, how many of the n still fit, and left, the final gap."""
    rows = rows.sort_values("rank", ignore_index=True)
    left, taken = float(rows["missing"].iloc[0]), []
    for words, n in zip(rows["words"].tolist(), rows["n"].tolist()):
        fits = 0 if left <= 0 else n if not words else min(n, int(left // words))
        left -= fits * words
        taken.append(fits)
    return rows.assign(taken=taken, left=left)


def _filled(rows: DataFrame) -> DataFrame:
    """(place, rank, words, n, missing) with taken and left; a row for each block or each size of a source."""
    kinds = "place int, rank long, words long, n long, missing double"
    rows = rows.select("place", F.col("rank").cast("long").alias("rank"), "words", F.col("n").cast("long").alias("n"), "missing")
    return rows.groupBy("place").applyInPandas(_fill, f"{kinds}, taken long, left double").drop("words", "n", "missing")


class Plan:
    """What the mix takes: ``docs`` (doc_id, source, size, block), ``blocks`` (what happens to each block), ``closing`` (single documents)."""

    def __init__(self, docs: DataFrame):
        self.docs = Cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _size(F.col("text")).alias("size")).withColumn("block", _block(F.col("doc_id"))), "mix-docs").df
        blocks = Cut(self.docs.groupBy("source", "block").agg(F.sum("size").alias("words")), "mix-blocks").df
        sources = blocks.groupBy("source").agg(F.sum("words").alias("source_size"), F.count("*").alias("n_blocks"))
        planned = targets(sources).withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        planned = planned.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
        planned = planned.withColumn("missing", F.col("target") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "source2")
        run = Cut(blocks.join(planned, F.col("source").eqNullSafe(F.col("source2"))).drop("source2"), "mix-run").df
        fill = _filled(run.select("place", F.col("block").alias("rank"), "words", F.lit(1).alias("n"), "missing")).withColumnsRenamed({"place": "place2", "rank": "block2"})
        run = run.join(fill, (F.col("place") == F.col("place2")) & (F.col("block") == F.col("block2"))).withColumn("part", F.col("taken") > 0).withColumn("missing", F.col("left"))
        # the blocks of the last turn come first, so that its draws are a run as well
        run = run.withColumn("at", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("part"), "block")) - 1).drop("place2", "block2", "taken", "left")
        run = Cut(run, "mix-run").df
        quotas = run.groupBy("place").agg(F.sum(F.col("epochs") + F.col("part").cast("int")).cast("long").alias("quota"))
        # one row a source goes into this one group, and SHARDS rows a source come out
        drawn = quotas.groupBy().applyInPandas(_tree, "place int, shard int, start long, n long").where("n > 0")
        drawn = drawn.select("place", "shard", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("draw"))
        wanted = run.where(F.col("epochs") + F.col("part").cast("int") > 0).select("place", "source", "block", F.explode(F.sequence(F.lit(0), F.col("epochs") + F.col("part").cast("int") - 1)).alias("turn"), "at", "n_blocks")
        wanted = wanted.withColumn("draw", F.col("turn") * F.col("n_blocks") + F.col("at"))
        shards = wanted.join(drawn, ["place", "draw"]).groupBy("source", "block").agg(F.sort_array(F.collect_list("shard")).alias("shards"))  # at most four a block
        shards = shards.withColumnsRenamed({"source": "source3", "block": "block3"})
        plan = run.join(shards, F.col("source").eqNullSafe(F.col("source3")) & (F.col("block") == F.col("block3")), "left")
        plan = plan.select(F.col("source").alias("source2"), F.col("block").alias("block2"), "source_size", "target", "epochs", "part", "missing", "place", F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))
        self.blocks = Cut(plan, "mix-plan").df
        self.small = self.blocks.count() <= BROADCAST_ROWS
        left_out = self.with_plan(self.docs).where((~F.col("part")) & (F.col("epochs") < MOST) & (F.col("missing") > 0) & F.col("doc_id").isNotNull())
        # rows of one id are one; whoever is larger than twice the gap can neither fill nor close it
        left_out = left_out.groupBy("place", "block", "doc_id", "missing").agg(F.sum("size").alias("size")).where((F.col("size") > 0) & (F.col("size") < 2 * F.col("missing")))
        left_out = Cut(left_out, "mix-left").df
        counts = left_out.groupBy("place", "size", "missing").agg(F.count("*").alias("n"))
        fill = Cut(_filled(counts.select("place", (-F.col("size")).alias("rank"), F.col("size").alias("words"), "n", "missing")).select("place", (-F.col("rank")).alias("size"), "taken", "left"), "mix-fill").df
        # of each size so many: whole blocks in order, and of the one that holds too many the first by hash
        per_block = left_out.join(fill.where("taken > 0").select("place", "size", "taken"), ["place", "size"]).groupBy("place", "size", "block", "taken").agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy("place", "size").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
        per_block = per_block.withColumn("quota", F.col("taken") - before).where("quota > 0").select("place", "size", "block", "quota")
        by_hash = Window.partitionBy("place", "size", "block").orderBy(_key(F.col("doc_id")), "doc_id")
        filling = left_out.join(per_block, ["place", "size", "block"]).withColumn("nth", F.row_number().over(by_hash)).where("nth <= quota").select("place", "doc_id")
        filling = Cut(filling, "mix-filling").df
        gap = fill.select("place", "left").distinct()
        rest = left_out.join(filling, ["place", "doc_id"], "left_anti").join(gap, "place").withColumn("off", F.abs(F.col("size") - F.col("left"))).where("off < left")
        nearest = rest.groupBy("place").agg(F.min(F.struct("off", _key(F.col("doc_id")).alias("key"), "doc_id")).alias("best")).select("place", F.col("best.doc_id").alias("doc_id"))
        closing = filling.unionByName(nearest).select(F.col("place").alias("closing_place"), F.col("doc_id").alias("closing_id"), F.lit(True).alias("closes"))
        self.closing = Cut(closing, "mix-closing").df

    def with_plan(self, docs: DataFrame) -> DataFrame:
        plan = F.broadcast(self.blocks) if self.small else self.blocks  # checked: BROADCAST_ROWS
        return docs.join(plan, docs["source"].eqNullSafe(F.col("source2")) & (docs["block"] == F.col("block2")))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards (where each taking goes, comma-joined), one row for each input row.

    A null text has size 0 and is never counted; a null source is a source of its own, the last. Rows that repeat an id
    move together. With no words at all, all targets are 0 and nothing is taken; an empty table gives no rows.
    Reruns agree: every draw follows from ids and a fixed seed.
    """
    plan = Plan(docs)
    placed = plan.with_plan(plan.docs).join(plan.closing, (F.col("doc_id") == F.col("closing_id")) & (F.col("place") == F.col("closing_place")), "left")
    closes = F.coalesce("closes", F.lit(False))
    times = F.col("epochs") + F.col("part").cast("int") + closes.cast("int")
    last = F.when(closes, F.array(F.pmod(_key(F.col("doc_id")), F.lit(SHARDS)).cast("int"))).otherwise(F.array().cast("array<int>"))
    return placed.select("doc_id", "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"), F.array_join(F.concat("shards", last), ",").alias("shards"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of ``docs``, all columns, as often as they are taken, dealt to shards and shuffled inside them."""
    plan = Plan(docs)
    row = docs.select(F.struct("*").alias("__row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source")).withColumn("block", _block(F.col("doc_id")))
    row = plan.with_plan(row)
    taken = row.select("__row", "doc_id", F.explode("shards").alias("shard"))
    closing = row.join(plan.closing, (F.col("doc_id") == F.col("closing_id")) & (F.col("place") == F.col("closing_place")), "left_semi").select("__row", "doc_id", F.pmod(_key(F.col("doc_id")), F.lit(SHARDS)).cast("int").alias("shard"))
    both = taken.unionByName(closing).withColumn("order", F.xxhash64(F.lit(SEED), "shard", "doc_id"))
    return both.repartition("shard").sortWithinPartitions("shard", "order").select("__row.*")
