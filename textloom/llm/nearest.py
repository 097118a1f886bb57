"""Nearest neighbours by randomly rotated one-bit codes.

Vectors are scaled to unit length and turned by one random rotation (fixed by a seed).
The index holds, for every vector, the signs of its coordinates, packed into 64-bit
words, and a correction scalar: its inner product with its own sign vector. A query's
rotated coordinates are cut to ``PLANES`` bits; popcounts of code and bit planes give the
inner product with the sign vector, the scalar corrects it to an estimate of the cosine,
and the scalar's distance from one bounds the estimate's error. Vectors whose upper
bound reaches the exact score of the best k so far are reranked by the exact cosine.

Every row is indexed, block by block, where it lies; nothing is fitted. The queries are
broadcast in pieces of at most ``MAX_QUERY_BYTES``, each piece a pass over the rows. A
task returns at most k rows a query, and these are ranked by query. Of equal vectors in
a block only the k + 1 smallest ids can be among any k nearest; the others are left out
exactly, so a vector that a third of all rows share costs no more than others.

Defined results: rows with a null id, and vectors that are null, empty, zero, or hold
null or non-finite components, take no part; only vectors of equal length are compared;
of query rows with one id the smallest vector is the query; a candidate id counts once,
with its best score; ties go to the smaller id; other columns play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

K, EVERY, SEED, PLANES = 5, 50, 11, 6
#: Width of the error bound in standard deviations, and rows of a block.
SIGMAS, BLOCK = 3.0, 4096
MAX_QUERY_BYTES = 16 << 20


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def parse(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors (doubles) of the rows that take part, by length."""
    lens = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    first = np.concatenate(([0], np.cumsum(lens)))[:-1]
    known = pc.is_valid(ids).to_numpy(zero_copy_only=False)
    numbers = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    out = {}
    for n in np.unique(lens[known]):
        if n:
            rows = np.flatnonzero(known & (lens == n))
            x = flat[first[rows][:, None] + np.arange(n)]
            good = np.isfinite(x).all(1) & (x != 0).any(1)
            if good.any():
                out[int(n)] = (numbers[rows[good]], np.ascontiguousarray(x[good]))
    return out


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def bits(x: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    packed = np.packbits(x, axis=1)
    wide = np.zeros((len(x), -(-packed.shape[1] // 8) * 8), np.uint8)
    wide[:, : packed.shape[1]] = packed
    return wide.view(np.uint64)


class Index:
    """The codes of a block of vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, turn: np.ndarray):
        dim = x.shape[1]
        self.ids, self.x, self.norm = ids, x, norms(x)
        turned = (x / self.norm[:, None]) @ turn
        self.code = bits(turned > 0)
        self.ones = np.bitwise_count(self.code).sum(1).astype(float)
        self.fit = np.abs(turned).sum(1) / math.sqrt(dim)
        self.slack = np.sqrt(np.maximum(0, 1 - self.fit**2)) / self.fit / math.sqrt(max(1, dim - 1))


class Queries:
    """Queries of one length, cut to bit planes."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, seed: int = SEED):
        self.ids, self.x, self.norm, self.dim = ids, x, norms(x), x.shape[1]
        self.turn = rotation(self.dim, seed)
        turned = (x / self.norm[:, None]) @ self.turn
        self.low = turned.min(1)
        self.step = np.maximum((turned.max(1) - self.low) / (2**PLANES - 1), 1e-12)
        steps = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        self.planes = [bits((steps >> j) & 1 > 0) for j in range(PLANES)]
        self.total = self.low * self.dim + self.step * steps.sum(1)

    def estimate(self, index: Index, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """Estimated cosines and their error bounds, queries x vectors."""
        dot = np.zeros((len(self.ids[rows]), len(index.ids)))
        for j, plane in enumerate(self.planes):
            for w in range(index.code.shape[1]):
                dot += np.bitwise_count(plane[rows, w][:, None] & index.code[None, :, w]) * float(1 << j)
        inside = self.low[rows][:, None] * index.ones + self.step[rows][:, None] * dot
        scale = 1 / (math.sqrt(self.dim) * index.fit)
        est = (2 * inside - self.total[rows][:, None]) * scale
        rounding = self.step[rows][:, None] * (0.5 * math.sqrt(self.dim / 3) * SIGMAS) * scale
        return est, SIGMAS * index.slack + rounding


def exact(q: Queries, i: np.ndarray, index: Index, j: np.ndarray) -> np.ndarray:
    """Cosines of pairs, each a fixed order of additions, so equal vectors score equally everywhere."""
    out = np.empty(len(i))
    for at in range(0, len(i), 50_000):
        a, b = i[at : at + 50_000], j[at : at + 50_000]
        out[at : at + 50_000] = (q.x[a] * index.x[b]).sum(1) / (q.norm[a] * index.norm[b])
    return out


class Best:
    """The k best exact scores of each query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id = np.full((n, k), -np.inf), np.zeros((n, k), np.int64)

    def add(self, i: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        rows = np.unique(i)
        kept = self.score[rows] > -np.inf
        i = np.concatenate((i, np.repeat(rows, self.k)[kept.ravel()]))
        ids = np.concatenate((ids, self.id[rows][kept]))
        scores = np.concatenate((scores, self.score[rows][kept]))
        order = np.lexsort((-scores, ids, i))  # an id's best first
        i, ids, scores = i[order], ids[order], scores[order]
        once = np.ones(len(i), bool)
        once[1:] = (i[1:] != i[:-1]) | (ids[1:] != ids[:-1])
        i, ids, scores = i[once], ids[once], scores[once]
        order = np.lexsort((ids, -scores, i))
        i, ids, scores = i[order], ids[order], scores[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        top = rank < self.k
        self.score[rows], self.id[rows] = -np.inf, 0
        self.score[i[top], rank[top]], self.id[i[top], rank[top]] = scores[top], ids[top]


def distinct(ids: np.ndarray, x: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal vectors those with the ``keep`` smallest distinct ids."""
    rows = np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, 8 * x.shape[1]))).ravel()
    _, group = np.unique(rows, return_inverse=True)
    order = np.lexsort((ids, group))
    g, n = group[order], ids[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (n[1:] != n[:-1])
    order, g = order[new], g[new]
    order = np.sort(order[np.arange(len(g)) - np.searchsorted(g, g) < keep])
    return ids[order], x[order]


def search(q: Queries, best: Best, ids: np.ndarray, x: np.ndarray) -> None:
    """Adds what a block of vectors holds for the queries."""
    index = Index(*distinct(ids, x, best.k + 1), q.turn)
    step = max(1, (1 << 20) // max(1, len(index.ids)))
    for at in range(0, len(q.ids), step):
        rows = slice(at, at + step)
        est, err = q.estimate(index, rows)
        est[q.ids[rows][:, None] == index.ids[None, :]] = -np.inf
        floor = best.score[rows, -1]
        open_ = np.flatnonzero(floor == -np.inf)
        if len(open_):  # first the likeliest few, for a score to beat
            few = min(len(index.ids), 4 * best.k)
            j = np.argpartition(-est[open_], few - 1, axis=1)[:, :few].ravel()
            i = np.repeat(open_, few)
            live = est[i, j] > -np.inf
            i, j = i[live], j[live]
            best.add(i + at, index.ids[j], exact(q, i + at, index, j))
            floor = best.score[rows, -1]
        i, j = np.nonzero((est + err >= floor[:, None]) & (est > -np.inf))
        if len(i):
            best.add(i + at, index.ids[j], exact(q, i + at, index, j))


def _scan(shared, k: int):
    def run(batches):
        queries = shared.value
        best = {n: Best(len(q.ids), k) for n, q in queries.items()}
        for batch in batches:
            for n, (ids, x) in parse(batch.column(0), batch.column(1)).items():
                if n in queries:
                    for at in range(0, len(ids), BLOCK):
                        search(queries[n], best[n], ids[at : at + BLOCK], x[at : at + BLOCK])
        for n, q in queries.items():
            i, r = np.nonzero(best[n].score > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(q.ids[i]), pa.array(best[n].id[i, r]), pa.array(best[n].score[i, r])], names=["query_id", "vec_id", "score"])

    return run


def neighbours(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY, seed: int = SEED, max_query_bytes: int = MAX_QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id ``every`` divides, its k nearest of all other rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    asked = rows.where((F.col("vec_id") % every == 0) & F.col("x").isNotNull()).groupBy("vec_id").agg(F.min("x").alias("x"))
    size = asked.agg(F.coalesce(F.sum(F.size("x") * 8 * 3), F.lit(0)).alias("b")).first()["b"]  # vectors, planes, rotation
    pieces = max(1, math.ceil(size / max_query_bytes))
    parts = []
    for p in range(pieces):
        table = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(pieces)) == p).toArrow().combine_chunks()
        found = parse(*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (table["vec_id"], table["x"]))) if table.num_rows else {}
        shared = spark.sparkContext.broadcast({n: Queries(ids, x, seed) for n, (ids, x) in found.items()})
        part = rows.mapInArrow(_scan(shared, k), "query_id bigint, vec_id bigint, score double")
        if pieces > 1:
            part = cut(part)
            shared.unpersist()
        parts.append(part)
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    out = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
