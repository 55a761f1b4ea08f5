"""Nearest neighbours by a block matrix join.

Queries and candidates are cut into blocks by a hash of the id; each pair of
blocks is a tile. A tile multiplies int8 vectors; the rest of each vector that
the rounding lost bounds how far that product is from the true one. Pairs whose
upper bound reaches the k-th best lower bound so far are computed again in
double precision. Each task merges its tiles into one heap a query, and the
heaps of all tasks are merged by rank. The result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one block of queries and of candidates, about.
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 4096
#: A task hands on its heaps once it holds so many queries' heaps.
HELD_QUERIES = 64 * QUERY_BLOCK


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scale, norm of the int8 vector times scale, norm of what rounding lost."""
    x = x.astype(np.float64)
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1
    q = np.rint(x / scale[:, None])
    lost = x - q * scale[:, None]
    slack = 1 + 1e-9  # the norms are rounded too
    return q.astype(np.int8), scale, np.linalg.norm(q * scale[:, None], axis=1) * slack, np.linalg.norm(lost, axis=1) * slack + 1e-300


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, added from the first component to the last."""
    p = a.astype(np.float64) * b.astype(np.float64)
    return np.cumsum(p, axis=1)[:, -1]


class Heaps:
    """The k best (score, id) of each query; of equal scores the smaller id."""

    def __init__(self, k: int):
        self.k = k
        self.best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def floor(self, query: int) -> float:
        s = self.best.get(query)
        return -np.inf if s is None or len(s[0]) < self.k else s[0][-1]

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if query in self.best:
            scores, ids = np.concatenate([self.best[query][0], scores]), np.concatenate([self.best[query][1], ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.best[query] = scores[order], ids[order]


def tile(heaps: Heaps, q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray) -> None:
    """Merge one tile into the heaps. A query never meets its own id."""
    k = heaps.k
    qi, qs, qn, ql = quantise(q)
    ci, cs, cn, cl = quantise(c)
    # sums of int8 products of up to 1000 components are exact in float32, which has a fast product
    as_float = np.float32 if q.shape[1] <= 1000 else np.float64
    qi, ci = qi.astype(as_float), ci.astype(as_float)
    for at in range(0, len(q_ids), 256):
        rows = slice(at, at + 256)
        near = (qi[rows] @ ci.T).astype(np.float64)
        near *= qs[rows, None]
        near *= cs
        err = qn[rows, None] * cl + ql[rows, None] * (cn + cl)
        err += 1e-12 * (qn[rows, None] * cn)
        own = q_ids[rows, None] == c_ids
        low, high = near - err, near + err
        low[own] = high[own] = -np.inf
        kth = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] >= k else np.full(len(low), -np.inf)
        for j, query in enumerate(q_ids[rows]):
            keep = np.flatnonzero((high[j] >= max(kth[j], heaps.floor(query))) & ~own[j])
            if len(keep):
                heaps.add(int(query), exact_products(np.broadcast_to(q[at + j], (len(keep), q.shape[1])), c[keep]), c_ids[keep])


def clean(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """_id, _v (array of floats or doubles, as stored), _d of vectors that take part: not null, not zero, all components finite.

    Rows without an id take no part. Rows that repeat an id count once, with the smallest vector.
    """
    stored = vectors.schema[vec_col].dataType.simpleString()
    v = F.col(vec_col)
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & usable).select(F.col(id_col).cast("long").alias("_id"), (v if stored == "array<float>" else v.cast("array<double>")).alias("_v"))
    return rows.groupBy("_id").agg(F.min("_v").alias("_v")).withColumn("_d", F.size("_v"))


def _blocks(rows: DataFrame, size: int, other: int, mine: str, theirs: str) -> DataFrame:
    """One row for each tile a block takes part in: dimension, both block numbers, ids and vectors."""
    n = F.pmod(F.xxhash64("_id"), F.lit(size)).cast("int").alias(mine)
    blocks = rows.groupBy("_d", n).agg(F.collect_list(F.struct("_id", "_v")).alias(f"_{mine}_rows"))
    return blocks.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.lit(other - 1))))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` largest inner products of each query; fewer if there are fewer.

    Vectors meet only vectors of as many components. Ties go to the smaller id.
    Empty tables give no rows; other columns are ignored. The session's Arrow
    batches should be bounded by bytes (``common.tune``): a row holds two blocks.
    """
    cands, asks = clean(vectors, id_col, vec_col), clean(queries, id_col, vec_col)
    n_c = max(1, -(-cands.count() // CANDIDATE_BLOCK))
    n_q = max(1, -(-asks.count() // QUERY_BLOCK))
    tiles = _blocks(asks, n_q, n_c, "q", "c").join(_blocks(cands, n_c, n_q, "c", "q"), ["_d", "q", "c"])

    def unpack(cell) -> tuple[np.ndarray, np.ndarray]:
        ids = cell.values.field(0).to_numpy(zero_copy_only=False)
        v = cell.values.field(1)
        return ids, v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(k)

        def flush() -> pa.RecordBatch:
            q, s, v = [], [], []
            for query, (scores, ids) in heaps.best.items():
                q.append(np.full(len(ids), query))
                s.append(scores)
                v.append(ids)
            heaps.best = {}
            cat = lambda x, t: pa.array(np.concatenate(x) if x else np.empty(0), t)
            return pa.RecordBatch.from_arrays([cat(q, pa.int64()), cat(v, pa.int64()), cat(s, pa.float64())], names=["query_id", "vec_id", "score"])

        for b in batches:
            for i in range(b.num_rows):
                tile(heaps, *unpack(b.column(0)[i]), *unpack(b.column(1)[i]))
                if len(heaps.best) >= HELD_QUERIES:
                    yield flush()
        yield flush()

    best = tiles.select("_q_rows", "_c_rows").mapInArrow(run, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
