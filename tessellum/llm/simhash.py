"""SimHash near-duplicates with an index in Gray order.

Fingerprints are 64 majority bits over the XXH64 (seed 42) of 3-word shingles. To link every two that differ in at
most two bits, the index has these levels:

* top: a mask of about 21 of the 64 bits and the pattern under it. Two fingerprints that differ in two bits agree under
  at least one of three disjoint masks, so each fingerprint is routed to three top nodes and no link is lost;
* below: the fingerprints of a top node sorted by Gray rank, every run of ``FAN`` under a node that holds the bits they
  all share (mask and pattern). Two nodes whose shared bits already differ in three places are dropped with all that is
  below them, so differences accumulate from the top down;
* a top node of more than ``NODE`` fingerprints is split in the same way: two of its fingerprints that differ in two bits agree
  under at least one of three disjoint masks of the bits left, so each is routed on to three nodes below, up to ``DEPTH`` times;
* what agrees in some fifty bits and is still too many for a node (dense families of near copies) is joined in an exact linear
  way: two fingerprints differ in at most two bits if and only if their balls of radius one meet, and no point lies in more
  than 65 balls, so 65 rows for each fingerprint find all links whatever the size of the family.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cut, cut
from .components import connected_components

SEED, WIDTH, NEAR = 42, 3, 2
NODE, FAN, PAIRS = 1024, 8, 2_000_000
DEPTH = 3


def _split(bits: tuple[int, ...]) -> list[int]:
    """Three disjoint masks that make up the given bits."""
    third = -(-len(bits) // 3)
    return [sum(1 << b for b in bits[k * third : (k + 1) * third]) for k in range(3)]


def _masks(above: int = 0) -> list[int]:
    """The masks of the nodes below one whose fingerprints agree under the mask ``above``."""
    return [above | m for m in _split(tuple(b for b in range(64) if not above >> b & 1))]


def fingerprint(text: str | None) -> int:
    """64 bits, each the majority over all shingles, repeats included. No words: zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    if len(words) <= WIDTH:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b"%b %b %b" % w, SEED) for w in zip(words, words[1:], words[2:])), np.uint64, len(words) - 2)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp bigint): whole texts; a null text counts as empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _linked_pairs(group: np.ndarray, fp: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs within a group that differ in at most ``near`` bits. Rows are sorted by group, then Gray rank."""
    n = len(fp)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    place = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
    depth, top = 0, int(place.max(initial=0))
    while FAN**depth <= top:
        depth += 1
    levels = [(np.arange(n), np.full(n, ~np.uint64(0)), fp)]
    node_of = np.arange(n)
    for level in range(1, depth + 1):
        run = place // FAN**level
        starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (run[1:] != run[:-1])])
        spread = np.bitwise_or.reduceat(fp ^ np.repeat(fp[starts], np.diff(np.r_[starts, n])), starts)
        levels.append((starts, ~spread, fp[starts]))
    a = b = np.flatnonzero(np.diff(np.r_[levels[depth][0], n]) > 1) if depth else np.arange(0)
    for level in range(depth, 0, -1):
        below, mask, pattern = levels[level - 1]
        kids = np.searchsorted(below, np.r_[levels[level][0], n])
        na, nb = kids[a + 1] - kids[a], kids[b + 1] - kids[b]
        of = np.repeat(np.arange(len(a)), na * nb)
        k = np.arange(len(of)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
        x, y = kids[a][of] + k // nb[of], kids[b][of] + k % nb[of]
        keep = (x <= y) if level > 1 else (x < y)
        x, y = x[keep], y[keep]
        close = _popcount((pattern[x] ^ pattern[y]) & mask[x] & mask[y]) <= near
        a, b = x[close], y[close]
    return node_of[a], node_of[b]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each one's component, so that n rows carry what many pairs say."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def _edges(near: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        for batch in batches:
            if batch.empty:
                continue
            # the last group may go on in the next batch
            last = (batch["part"] == batch["part"].iloc[-1]) & (batch["pattern"] == batch["pattern"].iloc[-1])
            if last.all():
                kept.append(batch)
                continue
            yield from solve(pd.concat([*kept, batch[~last]]))
            kept = [batch[last]]
        if kept:
            yield from solve(pd.concat(kept))

    def solve(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        part, pattern, fp = (rows[c].to_numpy() for c in ("part", "pattern", "fp"))
        starts = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (pattern[1:] != pattern[:-1])])
        sizes = np.diff(np.r_[starts, len(fp)])
        group = np.repeat(np.arange(len(starts)), sizes)
        bulk = np.cumsum(sizes.astype(np.int64) ** 2) // PAIRS  # groups are taken together up to so many pairs
        for at in np.unique(bulk):
            mine = np.isin(group, np.flatnonzero((bulk == at) & (sizes > 1)))
            own = fp[mine].view(np.uint64)
            if not len(own):
                continue
            root = _forest(len(own), *_linked_pairs(group[mine], own, near))
            moved = np.flatnonzero(root != np.arange(len(own)))
            if len(moved):
                yield pd.DataFrame({"a": own[moved].view(np.int64), "b": own[root[moved]].view(np.int64)})

    return run


def gray_rank(fp):
    """The place of a 64-bit pattern in the reflected Gray sequence, as a column."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def near_edges(prints: DataFrame) -> DataFrame:
    """(a, b) over distinct fingerprints ``fp``: edges whose components are those of all pairs within two bits."""
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    masks, edges, dense = _masks(), None, prints
    for depth in range(DEPTH):
        parts = [F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("pattern")) for k, m in enumerate(masks)]
        if depth:  # only the nodes below a large one: three for each of those
            parts = [F.when(F.col("above") == k // 3, x) for k, x in enumerate(parts)]
        routed = Cut(dense.select("fp", F.explode(F.array_compact(F.array(*parts))).alias("r")).select("fp", "r.*"), "routed").df
        large = routed.groupBy("part", "pattern").count().where(F.col("count") > NODE).select(F.col("part").alias("part2"), F.col("pattern").alias("pattern2"))
        large = cut(large, "large")
        same = (F.col("part") == F.col("part2")) & (F.col("pattern") == F.col("pattern2"))
        found = routed.join(large, same, "left_anti").repartition("part", "pattern").sortWithinPartitions("part", "pattern", gray_rank(F.col("fp"))).mapInPandas(_edges(NEAR), "a long, b long")
        edges = found if edges is None else edges.unionByName(found)
        dense = routed.join(large, same, "left_semi").select("fp", F.col("part").alias("above"))
        if large.isEmpty():
            return edges
        masks = [m for above in masks for m in _masks(above)]
    dense = dense.select("fp").distinct()
    ball = dense.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(signed(1 << k))) for k in range(64)])).alias("point"))
    least = ball.groupBy("point").agg(F.min("fp").alias("b"), F.count("fp").alias("n")).where("n > 1").select(F.col("point").alias("point2"), "b")
    return edges.unionByName(ball.join(least, F.col("point") == F.col("point2")).where("fp <> b").select(F.col("fp").alias("a"), "b").distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id that links of two bits or fewer reach).

    One row for each input row: repeated rows stay repeated, equal ids are one document with several texts and join the
    components of all of them no further than each text does. Texts that are null or hold no words have fingerprint
    zero, linked like any other. A null doc_id never names a component unless nothing else is in it. An empty table
    gives no rows. Other columns of ``docs`` are not read.
    """
    found = Cut(fingerprints(docs), "prints").df
    prints = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(near_edges(prints.select("fp")), "a", "b")
    placed = prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    placed = Cut(placed, "placed").df
    named = placed.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "root2")
    by_print = placed.join(named, F.col("root") == F.col("root2")).select(F.col("fp").alias("fp2"), "component_id")
    return found.join(by_print, F.col("fp") == F.col("fp2")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents, all columns, that name their component: one of each group of near copies stays.

    Rows that repeat an id that stays are all kept; rows with a null id are kept, as nothing names them.
    """
    keep = near_duplicates(docs).where("doc_id = component_id").select(F.col("doc_id").alias("__keep_id")).distinct()
    return docs.join(keep, docs["doc_id"] == F.col("__keep_id"), "left_semi").unionByName(docs.where(docs["doc_id"].isNull()))
