"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors are cut into 1, 4 and 16 segments.  With means m and deviation norms d of a segment of length L,
its inner product is at most L*m_q*m_x + d_q*d_x, so the sum over segments bounds the score from
above (and the distance from below).  Bounds are tried from coarse to fine against the k-th best score so
far; only survivors get the exact integer score.

Queries and candidates meet in a grid of cells, candidate chunks by query chunks; each cell is
streamed in bounded blocks, keeps its k best for each query, and the bests of all cells are ranked. Chunks hold CHUNK bytes
of candidates, so that bests grow with the input and not with a number of partitions.

Null vectors and vectors with null or non-finite components take no part; vectors of different
length are never compared. A query's own row, found by id, is not a candidate. Rows that repeat an
id are candidates once each; a repeated query id is answered once, by its smallest vector. Ties go to the smaller
id. Null ids take no part. Scores beyond 64 bits are the nearest 64-bit number. Extra columns are ignored, whatever their
names, but for those that is_query reads. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import written

LEVELS = (1, 4, 16)
BLOCK = 512
QUERIES = 16384
CHUNK = 32 << 20
_LONGS = np.iinfo(np.int64)
_UNSET = -(1 << 63)


def _stats(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means scaled by the root of the segment's length, and norms of deviations from them."""
    means, norms = [], []
    for part in np.array_split(x, min(segments, x.shape[1]), axis=1):
        mean = part.mean(axis=1)
        means.append(mean * part.shape[1] ** 0.5)
        norms.append(np.sqrt(((part - mean[:, None]) ** 2).sum(axis=1)))
    return np.stack(means, 1), np.stack(norms, 1)


class _Best:
    """The k best of each query of a cell."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.levels = [_stats(vectors.astype(np.float64), s) for s in LEVELS]
        self.norms, self.top = np.linalg.norm(vectors.astype(np.float64), axis=1), float(np.abs(vectors.astype(np.float64)).max(initial=0))
        self.score = np.full((len(ids), k), _UNSET)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def _scores(self, x: np.ndarray, query: np.ndarray, safe: bool) -> np.ndarray:
        if safe:
            return x @ query
        return np.array([min(max(sum(map(int.__mul__, row, query.tolist())), _LONGS.min + 1), _LONGS.max) for row in x.tolist()], dtype=np.int64)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        real = x.astype(np.float64)
        norms = np.linalg.norm(real, axis=1)
        safe = float(np.abs(real).max(initial=0)) * self.top * x.shape[1] < 2.0**62
        for at in range(0, len(self.ids), BLOCK):
            part = slice(at, at + BLOCK)
            last = self.score[part, -1]
            floor = np.where(last == _UNSET, -np.inf, last.astype(np.float64))
            alive = self.ids[part, None] != ids[None, :]
            for (mq, dq), s in zip(self.levels, LEVELS):
                mx, dx = _stats(real, s)
                bound = mq[part] @ mx.T + dq[part] @ dx.T
                slack = 1e-9 * np.outer(self.norms[part], norms)  # no sum of the bound's terms without signs is above the product of norms
                alive &= bound + slack + 1e-3 >= floor[:, None]
                if not alive.any():
                    break
            for i in np.flatnonzero(alive.any(axis=1)).tolist():
                pick = np.flatnonzero(alive[i])
                score = np.concatenate([self.score[at + i], self._scores(x[pick], self.vectors[at + i], safe)])
                found = np.concatenate([self.found[at + i], ids[pick]])
                best = np.lexsort((found, ~score))[: self.k]
                self.score[at + i], self.found[at + i] = score[best], found[best]

    def rows(self) -> pa.RecordBatch:
        q, j = np.nonzero(self.score != _UNSET)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(self.found[q, j]), pa.array(self.score[q, j])], names=["query_id", "vec_id", "score"])


def _cells(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, queries, best = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column("cell").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(cells[1:] != cells[:-1]) + 1, [len(cells)]])
            for lo, hi in zip(edges[:-1], edges[1:]):
                if cells[lo] != cell:
                    if best is not None:
                        yield best.rows()
                    cell, queries, best = cells[lo], [], None
                part = batch.slice(int(lo), int(hi - lo))
                ids = part.column("id").to_numpy()
                is_query = part.column("kind").to_numpy() == 0
                vec = part.column("vec")
                x = vec.flatten().to_numpy().reshape(len(ids), -1)
                if not x.shape[1]:
                    x = np.zeros((len(ids), 1), np.int64)
                if is_query.any():
                    queries.append((ids[is_query], x[is_query]))
                rest = np.flatnonzero(~is_query)
                if len(rest) and (queries or best is not None):
                    if best is None:
                        best = _Best(np.concatenate([q[0] for q in queries]), np.concatenate([q[1] for q in queries]), k)
                        queries = []
                    for at in range(0, len(rest), BLOCK):
                        best.add(ids[rest[at : at + BLOCK]], x[rest[at : at + BLOCK]])
        if best is not None:
            yield best.rows()

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, chunks: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row of vectors (vec_id, embedding, ...) where is_query."""
    spark = vectors.sparkSession
    x = F.col("embedding").cast("array<double>")
    fit = F.expr("vec_id IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    rows = vectors.withColumn("_query", is_query).where(fit).select(F.col("vec_id").cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long")).alias("vec"), F.coalesce("_query", F.lit(False)).alias("query"))
    rows = written(rows, "vectors")
    size = rows.agg(F.sum(F.size("vec").cast("long") * 8)).first()[0] or 0
    chunks = chunks or max(spark.sparkContext.defaultParallelism, size // CHUNK)
    queries = rows.where("query").groupBy("id").agg(F.min("vec").alias("vec"))
    parts = 1 + queries.count() // QUERIES
    asked = queries.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    given = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "vec"), F.lit(chunks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    both = asked.select("chunk", "part", "id", "vec", F.lit(0).alias("kind")).unionByName(given.select("chunk", "part", "id", "vec", F.lit(1).alias("kind")))
    cells = both.select(F.xxhash64("chunk", "part", F.size("vec")).alias("cell"), "kind", "id", "vec").repartition(chunks * parts, "cell").sortWithinPartitions("cell", "kind")
    found = cells.mapInArrow(_cells(k), "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
