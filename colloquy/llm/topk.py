"""Exact top-k by inner product over an impact-ordered index.

Method: score-at-a-time evaluation. Within a block of vectors the values of
each dimension are quantised into levels; the vectors of one level form a
posting segment. A query visits the segments of all dimensions by descending
quantised impact and adds each segment's guaranteed contribution. It stops
on proof alone: a vector is out once its accumulator plus all it could still
gain is below the k-th best exact score seen, and every vector that is not
out is scored exactly.

Each block of vectors lives in one task, which builds its index once and then
lets all queries stream by; so vectors move once, and only the queries, far fewer, are
copied to every block. Each block gives k rows a query, and a ranking picks
the k best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import release, stage

#: Vectors in a block, and the least worth a block of its own while there are idle cores.
BLOCK, LEAST_BLOCK = 65_536, 8_192
LEVELS = 32
_SEEN = 1 << 48


class ImpactIndex:
    """Posting segments of one block of integer vectors (rows of ``x``)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, levels: int = LEVELS):
        self.ids, self.x = ids, x
        self.dims: list[list[tuple[np.ndarray, int, int]]] = []
        self.low, self.high = x.min(axis=0), x.max(axis=0)
        for d in range(x.shape[1]):
            column, low = x[:, d], self.low[d]
            level = ((column - low) * levels) // (self.high[d] - low + 1)
            order = np.argsort(level, kind="stable")
            at = np.flatnonzero(np.diff(level[order], prepend=-1))
            parts = [order[a:b] for a, b in zip(at, [*at[1:], len(order)], strict=True)]
            self.dims.append([(p, int(column[p].min()), int(column[p].max())) for p in parts])

    def search(self, q: np.ndarray, own: int | None, k: int) -> list[tuple[int, int]]:
        """The k best (score, id), ties to the smaller id; the row at place ``own`` takes no part."""
        n, dims = self.x.shape
        plan, base, slack = [], 0, 0
        for d in np.flatnonzero(q):
            w = int(q[d])
            least = w * int(self.low[d] if w > 0 else self.high[d])
            base += least
            widest = 0
            for ids, a, b in self.dims[d]:
                low, high = (w * a, w * b) if w > 0 else (w * b, w * a)
                plan.append((high - least, low - least, ids))
                widest = max(widest, high - low)
            slack += widest
        plan.sort(key=lambda s: -s[0])
        used = int(np.count_nonzero(q))
        allowed = np.ones(n, bool)
        if own is not None:
            allowed[own] = False
        acc = np.zeros(n, np.int64)
        step = max(1, len(plan) // 12)
        members, best = np.flatnonzero(allowed), None
        for i, (impact, gain, ids) in enumerate(plan):
            if i % step == 0 and i >= 3 * step:
                seen, low = acc >> 48, acc & (_SEEN - 1)
                if best is None or i % (3 * step) == 0:
                    some = np.argpartition(np.where(allowed, low, -1), max(0, n - 8 * k))[max(0, n - 8 * k) :]
                    some = some[allowed[some]]
                    exact = np.sort(self.x[some] @ q)
                    if len(exact) >= k:
                        best = int(exact[-k]) if best is None else max(best, int(exact[-k]))
                if best is not None:
                    members = np.flatnonzero(allowed & (low + (base + slack) + (used - seen) * impact >= best))
                    if len(members) * dims <= 4 * sum(len(s[2]) for s in plan[i:]):
                        break
            acc[ids] += gain + _SEEN
        else:
            if best is not None:
                members = np.flatnonzero(allowed & ((acc & (_SEEN - 1)) + (base + slack) >= best))
        scores = self.x[members] @ q
        order = np.lexsort((self.ids[members], -scores))
        return [(int(scores[o]), int(self.ids[members[o]])) for o in order[:k]]


def _quantise(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("vector"), strict=True):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
                if np.isfinite(x).all():
                    ids.append(i)
                    rows.append(np.floor(scale * x).astype(np.int64).tobytes())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(rows, pa.binary())], ["vec_id", "v"])

    return run


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of ``width`` integers; shorter ones end in zeros, and what is beyond ``width`` meets only zeros."""
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column):
        r = np.frombuffer(v.as_buffer(), np.int64)[:width]
        out[i, : len(r)] = r
    return out


def _block(k: int):
    """Rows of one block, its vectors before all queries: k rows a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        index, place, width = None, {}, 0
        for batch in batches:
            is_query = batch.column("is_query").to_numpy(zero_copy_only=False)
            if not is_query.all():
                held.append(batch.filter(pa.array(~is_query)))
            queries = batch.filter(pa.array(is_query))
            if not len(queries):
                continue
            if index is None and held:
                rows = pa.Table.from_batches(held).combine_chunks()
                held = []
                width = max(len(v.as_buffer()) // 8 for v in rows.column("v").chunk(0))
                index = ImpactIndex(rows.column("vec_id").to_numpy(), _matrix(rows.column("v").chunk(0), width))
                place = {r: i for i, r in enumerate(rows.column("row").to_pylist())}
            if index is None:
                continue  # a block without vectors
            found = [
                (row, i, other, score)
                for row, i, q in zip(queries.column("row").to_pylist(), queries.column("vec_id").to_pylist(), _matrix(queries.column("v"), width), strict=True)
                for score, other in index.search(q, place.get(row), k)
            ]
            if found:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["row", "query_id", "vec_id", "score"])
        release()

    return run


def exact_top_k(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest integer inner products of each query.

    Components become floor(scale * x). The rows for which ``queries`` (a
    condition on ``vec_id``) holds are searched against every row but
    themselves. Ties go to the smaller id. Rows that repeat an id are
    candidates, and queries, each for itself. Rows with a null id or vector,
    or a null or non-finite component, take no part; shorter vectors count as
    ending in zeros. Other columns are ignored; an empty table gives no rows.
    """
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    spark = vectors.sparkSession
    rows = stage(source.mapInArrow(_quantise(scale), "vec_id long, v binary").withColumn("row", F.monotonically_increasing_id()), "vectors")
    n = rows.count()
    blocks = max(1, math.ceil(n / BLOCK), min(spark.sparkContext.defaultParallelism, math.ceil(n / LEAST_BLOCK)))
    own = rows.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("is_query"), "row", "vec_id", "v")
    copied = rows.where(queries).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("is_query"), "row", "vec_id", "v")
    dealt = own.unionByName(copied).repartitionById(blocks, F.col("block")).sortWithinPartitions("is_query")
    found = dealt.mapInArrow(_block(k), "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
