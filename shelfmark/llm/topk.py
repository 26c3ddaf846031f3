"""Exact top-k search by inner product with multi-resolution segment statistics.

With |a - b|^2 = |a|^2 + |b|^2 - 2ab, the k highest inner products are the k lowest of the distance less
the candidate's norm, and a lower bound of the distance is an upper bound of the product. Cut into
segments, a product is at most the sum over segments of n * mean * mean + spread * spread, where spread
is sqrt(n) times the deviation. That bound is a product of short vectors itself, so it is taken block by
block, from few segments to many; exact products are computed for the candidates that survive.

Queries go out in blocks bounded in vectors and in components, each block against all rows: a table of q queries of d
components takes q * d / HELD passes, or q / QUERY_BLOCK if those are more.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.llm.common import arrow_map, written

#: Queries that are held at once, rows of a block of candidates, components that either may have at most, segments coarse to fine.
QUERY_BLOCK, ROW_BLOCK, HELD, LEVELS = 16_384, 4_096, 1 << 21, (4, 16)
SCALE, K = 64, 20
#: Share of a block's pairs from which one product of blocks is cheaper than pair by pair; rows that give the first floors.
MANY, FIRST = 0.03, 256


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component x as double; null if the vector is null or has a null or non-finite component."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    good = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, F.transform(wide, lambda x: F.floor(x * F.lit(float(scale))).cast("long")))


def bounds_of(m: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose products bound the products of m's rows from above: sqrt(n) * mean and spread of each segment."""
    out = []
    for part in np.array_split(m, min(segments, max(1, m.shape[1])), axis=1):
        n = max(1, part.shape[1])
        mean = part.sum(axis=1) / n
        out += [np.sqrt(n) * mean, np.sqrt(np.maximum(0.0, np.einsum("ij,ij->i", part, part) - n * mean * mean))]
    return np.stack(out, axis=1)


class Searcher:
    """The queries of one block, and the best that one task has found for them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, levels: tuple = LEVELS):
        self.ids, self.exact, self.k = ids, vectors, k
        self.wide = vectors.astype(np.float64)
        self.levels = [(s, bounds_of(self.wide, s)) for s in levels if s < vectors.shape[1]]
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.wide, self.wide))
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]  # heaps of (score, -vec_id)
        self.floor = np.full(len(ids), -np.inf)

    def products(self, q: np.ndarray, c: np.ndarray, some: slice, vectors: np.ndarray, wide: np.ndarray) -> np.ndarray:
        """Exact products of paired rows: in doubles where they hold every sum, else in integers; as one product of blocks if many are left."""
        if float(np.abs(self.wide).max(initial=0)) * float(np.abs(wide).max(initial=0)) * max(1, wide.shape[1]) >= 2**53:
            return np.einsum("ij,ij->i", self.exact[q], vectors[c])
        block = self.wide[some]
        if len(q) > MANY * len(block) * len(wide):
            return (block @ wide.T)[q - some.start, c].astype(np.int64)
        return np.einsum("ij,ij->i", self.wide[q], wide[c]).astype(np.int64)

    def add(self, ids: np.ndarray, vectors: np.ndarray, chunk: int = 256) -> None:
        if np.isinf(self.floor).any() and len(ids) > FIRST:  # a few rows first give every query a floor
            self.add(ids[:FIRST], vectors[:FIRST])
            ids, vectors = ids[FIRST:], vectors[FIRST:]
        wide = vectors.astype(np.float64)
        stats = [bounds_of(wide, s) for s, _ in self.levels]
        norm = np.sqrt(np.einsum("ij,ij->i", wide, wide))
        for at in range(0, len(self.ids), chunk):
            some = slice(at, at + chunk)
            q, c = self.survivors(some, stats, norm)
            self.keep(q, ids[c], self.products(q, c, some, vectors, wide))

    def survivors(self, some: slice, stats: list[np.ndarray], norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row of the block) that no level's bound rules out, given the least score of each query's best so far."""
        floor = self.floor[some][:, None]
        slack = 1e-6 * (1 + self.norm[some][:, None] * norm[None, :].max(initial=0))
        if not self.levels:
            q, c = np.nonzero(np.ones((floor.shape[0], len(norm)), bool))
            return q + some.start, c
        (_, own), rows = self.levels[0], stats[0]
        q, c = np.nonzero(own[some] @ rows.T >= floor - slack)
        for (_, own), rows in zip(self.levels[1:], stats[1:], strict=True):
            if len(q) > MANY * floor.shape[0] * len(norm):  # many are left: the next bound as one product of blocks
                full = own[some] @ rows.T
                left = full[q, c] >= (floor - slack)[q, 0]
            else:
                left = np.einsum("ij,ij->i", own[some][q], rows[c]) >= (floor - slack)[q, 0]
            q, c = q[left], c[left]
        return q + some.start, c

    def keep(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        good = (scores >= self.floor[q]) & (ids != self.ids[q])
        q, ids, scores = q[good], ids[good], scores[good]
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        if not len(q):
            return
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        for a, b in zip(starts, [*starts[1:], len(q)], strict=True):
            heap = self.best[q[a]]
            for s, i in zip(scores[a : min(b, a + self.k)].tolist(), ids[a : min(b, a + self.k)].tolist(), strict=True):
                if len(heap) < self.k:
                    heapq.heappush(heap, (s, -i))
                elif (s, -i) > heap[0]:
                    heapq.heapreplace(heap, (s, -i))
            if len(heap) == self.k:
                self.floor[q[a]] = heap[0][0]

    def rows(self) -> Iterator[tuple[int, int, int]]:
        for query, heap in zip(self.ids.tolist(), self.best, strict=True):
            yield from ((query, -i, s) for s, i in heap)


def matrices(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Vectors by length, each with its ids, from Arrow columns without nulls."""
    ids, sizes = ids.to_numpy(zero_copy_only=False), pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False)
    flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        places = (ends[at] - size)[:, None] + np.arange(size)[None, :]
        yield ids[at].astype(np.int64), flat[places].astype(np.int64).reshape(len(at), size)


def top_k(vectors: DataFrame, queries: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest products of each query with all other rows, ties to the smaller id.

    queries: condition that marks the query rows. Vectors that are null or hold null or non-finite components
    and rows with a null id take no part; vectors of other lengths than the query's are no candidates; a row
    with the query's own id is its own; of rows that repeat a query's id the first vector asks. Products must
    fit 64 bits. Empty tables give an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col)).alias("v")).filter("vec_id is not null and v is not null")
    asked = written(vectors.filter(queries).select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col)).alias("v")).filter("vec_id is not null and v is not null").groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    # The rows of a block by the longest query, so that a block is bounded in bytes too.
    longest = asked.agg(F.max(F.size("v"))).first()[0] or 1
    query_block = max(1, min(query_block, HELD // max(1, longest)))
    found, last = [], None
    while True:
        block = asked.filter(F.col("vec_id") > last) if last is not None else asked
        taken = block.orderBy("vec_id").limit(query_block).toArrow().combine_chunks()  # bounded by query_block
        if not taken.num_rows:
            break
        ids, held = (taken.column(c).combine_chunks() for c in ("vec_id", "v"))
        shared = spark.sparkContext.broadcast([(i.tobytes(), v.shape, v.tobytes()) for i, v in matrices(ids, held)])
        best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        block = arrow_map(rows, _search(shared, k), "query_id long, vec_id long, score long").withColumn("rank", F.row_number().over(best).cast("int"))
        found.append(block.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
        last = ids[-1].as_py()
        if len(ids) < query_block:
            break
        found[-1] = written(found[-1], "found")
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    merged = found[0]
    for more in found[1:]:
        merged = merged.unionByName(more)
    return merged


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers = {}
        for ids, shape, data in shared.value:
            searchers[shape[1]] = Searcher(np.frombuffer(ids, np.int64), np.frombuffer(data, np.int64).reshape(shape), k)
        for batch in batches:
            for at in range(0, batch.num_rows, ROW_BLOCK):
                part = batch.slice(at, ROW_BLOCK)
                for ids, m in matrices(part.column(0), part.column(1)):
                    step = max(1, HELD // max(1, m.shape[1]))
                    for lo in range(0, len(ids) if m.shape[1] in searchers else 0, step):
                        searchers[m.shape[1]].add(ids[lo : lo + step], m[lo : lo + step])
        for s in searchers.values():
            rows = list(s.rows())
            for lo in range(0, len(rows), 50_000):
                q, i, score = zip(*rows[lo : lo + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(score, pa.int64())], names=["query_id", "vec_id", "score"])

    return run
