"""The first k of many groups, kept while rows stream by, and exact nearest vectors by blocks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Vectors of a block (a product of two is 2048 x 2048 numbers), queries that a task holds, pairs worked out at once.
BLOCK, QUERIES, PAIRS = 2048, 1 << 15, 1 << 16


class Best:
    """The k least (key, id) of each of n groups; rows that come are held until there are as many as are kept."""

    def __init__(self, n: int, k: int, lazy: int = PAIRS):
        self.n, self.k, self.lazy = n, k, lazy
        self.bound = np.full(n, np.inf)
        self.rows: list[tuple] = []
        self.held = 0

    def add(self, group: np.ndarray, key: np.ndarray, ident: np.ndarray) -> None:
        if len(group):
            self.rows.append((group, key, ident))
            self.held += len(group)
            if self.held > 2 * self.n * self.k + self.lazy:
                self.settle()

    def offer(self, keys: np.ndarray, ident: np.ndarray) -> None:
        """Keys of every group (a row each; infinite: none) for ids in rising order: the first k of each group are added."""
        near = np.flatnonzero((keys <= self.bound[:, None]).any(1))
        own = keys[near]
        first = np.argsort(own, axis=1, kind="stable")[:, : self.k]
        value = np.take_along_axis(own, first, 1)
        row, column = np.nonzero((value <= self.bound[near][:, None]) & np.isfinite(value))
        self.add(near[row], value[row, column], ident[first[row, column]])

    def settle(self) -> tuple:
        """(group, key, id) of what is kept, in order."""
        if not self.rows:
            return np.empty(0, int), np.empty(0), np.empty(0, object)
        group, key, ident = (np.concatenate(x) for x in zip(*self.rows))
        order = np.lexsort((np.unique(ident, return_inverse=True)[1] if ident.dtype == object else ident, key, group))
        group, key, ident = group[order], key[order], ident[order]
        nth = np.arange(len(group)) - np.searchsorted(group, group)
        last = group[nth == self.k - 1]
        kth = key[nth == self.k - 1]
        self.bound[last] = np.where(np.isnan(kth), np.inf, kth)
        keep = nth < self.k
        self.rows = [(group[keep], key[keep], ident[keep])]
        self.held = int(keep.sum())
        return self.rows[0]


def rounded(x: np.ndarray) -> np.ndarray:
    """Millionths, halves away from zero, as SQL rounds to six places; NaN stays."""
    x = x * 1e6
    low = np.floor(x)
    return low + (x - low >= 0.5)


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of numbers as rows of doubles; a null, or a list with nulls or of another length than the longest, is a row of NaN."""
    lists = column.to_pylist() if column.null_count or column.flatten().null_count else None
    if lists is None:
        sizes = np.diff(column.offsets.to_numpy())
        if len(sizes) and (sizes == sizes[0]).all():
            return column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(sizes), -1)
        lists = column.to_pylist()
    width = max((len(x) for x in lists if x is not None), default=0)
    return np.array([[np.nan if y is None else y for y in x] if x is not None and len(x) == width else [np.nan] * width for x in lists], "f8").reshape(len(lists), width)


class Block:
    """Vectors, their norms and marks; ``left`` of one beside ``right`` of another gives squared distances, in single precision."""

    def __init__(self, rows: pa.Table, ident: str):
        x = matrix(rows["x"].combine_chunks())
        self.ids = rows[ident].combine_chunks().to_numpy(zero_copy_only=False)
        self.marks = rows["mark"].to_pylist()
        self.columns = np.ascontiguousarray(x.T)
        self.norms = (x * x).sum(1)
        one = np.ones((len(x), 1))
        self.left = np.hstack([-2 * x, one, self.norms[:, None]]).astype("f4")
        self.right = np.ascontiguousarray(np.hstack([x, self.norms[:, None], one]).astype("f4").T)


def one_thread() -> None:
    """Matrix products of this worker by one thread: tasks share the cores already."""
    for path in Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                return


def vectors_near(vectors: DataFrame, queries: DataFrame, k: int, same: str | None = None) -> DataFrame:
    """(query_id, vec_id, distance): of each task, the k of its vectors that are nearest to each query, by rounded distance and then id.

    Cells of a grid, a task each: a share of the vectors beside up to QUERIES queries, which are held; vectors stream by. A
    product of blocks gives all distances of a pair of blocks up to float error; those that may be among the k are worked
    out exactly, element by element in order. Nothing is broadcast.
    """
    across = 2 * vectors.sparkSession.sparkContext.defaultParallelism
    down = max(1, -(-queries.count() // QUERIES))
    types = dict(vectors.dtypes) | dict(queries.dtypes)
    label = lambda name: F.col(name) if same else F.lit(None).cast("int")
    shaped = lambda df, query, vec, x, mark, cell, held: df.select(cell.alias("cell"), F.lit(held).alias("held"), query.cast(types["query_id"]).alias("query_id"), vec.cast(types["vec_id"]).alias("vec_id"), F.col(x).alias("x"), mark.alias("mark"))
    own = F.pmod(F.xxhash64("query_id"), F.lit(down)).cast("int")
    asked = shaped(queries, F.col("query_id"), F.lit(None), "q", label(f"q_{same}"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(across - 1)), lambda i: i * down + own)), 0)
    share = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(across)).cast("int")
    known = shaped(vectors, F.lit(None), F.col("vec_id"), "embedding", label(same), F.explode(F.transform(F.sequence(F.lit(0), F.lit(down - 1)), lambda j: share * down + j)), 1)
    cells = asked.unionByName(known).repartitionById(across * down, F.col("cell")).sortWithinPartitions("cell", "held")
    schema = f"query_id {types['query_id']}, vec_id {types['vec_id']}, millionths double"
    wanted = [f.type for f in to_arrow_schema(T.StructType.fromDDL(schema))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        cell, parts, held = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            for block, best in held:
                group, key, ident = best.settle()
                for at in range(0, len(group), PAIRS):
                    to = at + PAIRS
                    yield pa.RecordBatch.from_arrays([pa.array(block.ids[group[at:to]].tolist(), wanted[0]), pa.array(ident[at:to].tolist(), wanted[1]), pa.array(key[at:to], pa.float64(), from_pandas=True)], names=["query_id", "vec_id", "millionths"])

        for batch in batches:
            table = pa.table(batch)
            for which, kind in sorted(set(zip(table["cell"].to_pylist(), table["held"].to_pylist()))):
                if which != cell:
                    yield from done()
                    cell, parts, held = which, [], []
                rows = table.filter(pc.and_(pc.equal(table["cell"], which), pc.equal(table["held"], kind))).combine_chunks()
                if kind == 0:
                    parts.append(rows)
                    continue
                if parts:
                    held = [(block, Best(len(block.ids), k)) for block in blocks(pa.concat_tables(parts), "query_id")]
                    parts = []
                for block in blocks(rows, "vec_id"):
                    for q, best in held:
                        if len(block.columns) == len(q.columns):
                            compare(block, q, best)
                        else:
                            group, of = (x.ravel() for x in np.indices((len(q.ids), len(block.ids))))
                            best.add(group, np.full(len(group), np.nan), block.ids[of])
        yield from done()

    def blocks(rows: pa.Table, ident: str) -> Iterator[Block]:
        return (Block(rows.slice(at, BLOCK), ident) for at in range(0, len(rows), BLOCK))

    def compare(v: Block, q: Block, best: Best) -> None:
        near = q.left @ v.right
        # what single precision may be off by, for 64 to 1000 numbers a vector
        slack = 1e-4 * (q.norms + v.norms.max(initial=0.0, where=~np.isnan(v.norms)))
        if same:
            codes = {x: i for i, x in enumerate(dict.fromkeys([*q.marks, *v.marks]))}
            near[np.array([codes[x] for x in q.marks])[:, None] != np.array([codes[x] for x in v.marks])[None, :]] = np.inf
        bound = best.bound
        if near.shape[1] > k and np.isinf(bound).any():
            here = np.partition(near, k - 1, axis=1)[:, k - 1].astype("f8")
            # the k-th of this block, as far as it may be off, in the next millionth
            known = np.isfinite(here)
            bound = np.fmin(bound, np.where(known, rounded(np.where(known, here, 0.0) + slack) + 1, np.inf))
        most = ((bound + 0.5) / 1e6 + slack).astype("f4") * np.float32(1.000001)
        met = ~(near > most[:, None])
        if same:
            met &= near != np.inf
        group, which = np.divmod(np.flatnonzero(met), near.shape[1])
        for at in range(0, len(group), PAIRS):
            g, w = group[at : at + PAIRS], which[at : at + PAIRS]
            total = np.zeros(len(g))
            for a, b in zip(v.columns, q.columns):
                d = a[w] - b[g]
                total += d * d
            key = rounded(total)
            fits = ~(key > bound[g])
            best.add(g[fits], key[fits], v.ids[w[fits]])
        if np.isinf(best.bound).any():
            best.settle()

    return cells.mapInArrow(run, schema).select("query_id", "vec_id", (F.col("millionths") / 1e6).alias("distance"))
