"""Exact top-k by inner product with multi-resolution segment statistics.

A vector cut into equal segments is a mean and a deviation for each. For vectors x and y and segments of n components,
the inner product is at most the sum of n * mean * mean + norm of the deviations * norm of the deviations, so the squared
distance |x|^2 + |y|^2 - 2xy has the matching lower bound. Bounds from one segment, then from more and shorter ones, are
held against the k-th best score so far, coarse to fine, each resolution for the pairs that the coarser ones left; only pairs
that survive all are scored, in whole numbers. A cell takes its candidates longest first, so that the k-th best score rises
early and pieces of short vectors fall at the coarsest bound. How much that saves depends on the vectors: of rows in groups or
of unlike lengths few pairs are scored; rows drawn alike in all directions are as near to one another as the bounds are wide.

Queries meet all vectors in blocks: a grid of blocks of queries and of candidates, of fixed size, each cell a key of
its own, so a task holds one block of queries and a piece of candidates at a time; the cells' best k are merged for each
query. That is the stated search of a set of queries over all rows, quadratic in their number by definition.

Components are floor(scale * x). Vectors that are null or hold null or non-finite components take no part, nor do rows
without an id. Vectors of other lengths are compared as if filled up with zeros. Rows that share an id are not
candidates of one another. Ties go to the smaller id. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slidegrid.llm.shared import tidied

QUERY_BLOCK, CANDIDATE_BLOCK = 4096, 8192
#: Pairs that are bounded or scored one by one at a time.
_AT_ONCE = 16_384
#: Candidates that are bounded at a time; fewer at first, to get scores to hold bounds against.
PIECE, FIRST_PIECE = 2048, 128
RESOLUTIONS = (1, 4, 16)
#: Share of a piece's pairs below which survivors are bounded and scored one by one instead of by a product of matrices.
FEW = 0.05


def _segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """For each segment root(n) * mean and the norm of the deviations: their inner product bounds that of the vectors."""
    parts = np.array_split(x, min(segments, x.shape[1]), axis=1)
    means = [p.mean(axis=1, keepdims=True) for p in parts]
    return np.hstack([m * np.sqrt(p.shape[1]) for p, m in zip(parts, means, strict=True)] + [np.linalg.norm(p - m, axis=1, keepdims=True) for p, m in zip(parts, means, strict=True)])


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), max(width, int(lengths.max(initial=0)))))
    if len(column) and (lengths == out.shape[1]).all():
        return values.reshape(len(column), -1)
    out[np.repeat(np.arange(len(column)), lengths), np.concatenate([np.arange(n) for n in lengths] or [np.empty(0, int)]).astype(int)] = values
    return out


class _Search:
    """The best k of a block of queries among the candidates that have been offered."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.features = [_segment_features(vectors, r) for r in RESOLUTIONS]
        self.rows = self.found = self.scores = np.empty(0, dtype=np.int64)
        self.least = np.full(len(ids), -np.inf)  # of each query's k best so far
        self.met = self.scored = 0  # pairs offered, and those that survived all bounds

    def offer(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        width = max(vectors.shape[1], self.vectors.shape[1])
        if width > self.vectors.shape[1]:
            self.vectors = np.pad(self.vectors, ((0, 0), (0, width - self.vectors.shape[1])))
            self.features = [_segment_features(self.vectors, r) for r in RESOLUTIONS]
        vectors = np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))
        alive = self.ids[:, None] != ids[None, :]
        self.met += int(alive.sum())
        few = FEW * alive.size
        if np.isfinite(self.least).any():
            for r, own in zip(RESOLUTIONS, self.features, strict=True):
                if (left := np.count_nonzero(alive)) <= few:
                    row, at = np.nonzero(alive)
                    part = _segment_features(vectors, r)
                    bound = np.concatenate([np.einsum("ij,ij->i", own[row[k : k + _AT_ONCE]], part[at[k : k + _AT_ONCE]]) for k in range(0, left, _AT_ONCE)] or [np.empty(0)])
                    gone = bound < self.least[row] - 1e-6 * (1 + np.abs(bound).max(initial=0))
                    alive[row[gone], at[gone]] = False
                else:
                    columns = np.flatnonzero(alive.any(axis=0))
                    bound = own @ _segment_features(vectors[columns], r).T
                    alive[:, columns] &= bound >= self.least[:, None] - 1e-6 * (1 + np.abs(bound).max(initial=0))
        left = np.count_nonzero(alive)
        self.scored += left
        if not left:
            return
        # float64 products of whole numbers are exact below 2^53; larger ones are multiplied as whole numbers.
        columns = np.flatnonzero(alive.any(axis=0))
        exact = width * np.abs(self.vectors).max(initial=0) * np.abs(vectors[columns]).max(initial=0) < 2**53
        a, b = (self.vectors, vectors[columns]) if exact else (self.vectors.astype(np.int64), vectors[columns].astype(np.int64))
        if left <= few:
            row, at = np.nonzero(alive[:, columns])
            scores = np.concatenate([np.einsum("ij,ij->i", a[row[k : k + _AT_ONCE]], b[at[k : k + _AT_ONCE]]) for k in range(0, left, _AT_ONCE)])
            better = scores >= self.least[row]
            row, at, scores = row[better], at[better], scores[better]
        else:
            scores = a @ b.T
            row, at = np.nonzero(alive[:, columns] & (scores >= self.least[:, None]))
            scores = scores[row, at]
        rows, found, scores = (np.concatenate(x) for x in ((self.rows, row), (self.found, ids[columns][at]), (self.scores, scores.astype(np.int64))))
        order = np.lexsort((found, -scores, rows))
        rows, found, scores = rows[order], found[order], scores[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        best = rank < self.k
        last = rank == self.k - 1
        self.least[rows[last]] = scores[last]
        self.rows, self.found, self.scores = rows[best], found[best], scores[best]


def top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best candidates of each row for which `queries` holds."""
    usable = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.col(id_col).isNotNull()
    whole = F.transform(vector_col, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    rows = vectors.where(usable).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    n = rows.agg(F.count("*").alias("all"), F.count(F.when(F.col("asks"), 1)).alias("asking"), F.max(F.size("v")).alias("width")).first()
    wide, high, width = max(1, -(-n["all"] // CANDIDATE_BLOCK)), max(1, -(-n["asking"] // QUERY_BLOCK)), n["width"] or 1
    own = lambda seed, m: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(m)).cast("int")
    all_ = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    candidates = rows.select(own(1, wide).alias("c"), all_(high).alias("q"), F.lit(1).alias("kind"), "id", "v")
    asking = rows.where("asks").select(all_(wide).alias("c"), own(2, high).alias("q"), F.lit(0).alias("kind"), "id", "v")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, parts, block = None, [], [], None
        for batch in batches:
            cells = np.stack([batch.column(i).to_numpy() for i in range(3)])
            cuts = [0, *(np.flatnonzero((cells[:, 1:] != cells[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                c, q, kind = cells[:, lo].tolist()
                if (c, q) != key:
                    if block is not None:
                        yield result(block)
                    key, ids, parts, block = (c, q), [], [], None
                own_ids, own_vectors = batch.column(3).slice(lo, hi - lo).to_numpy(), _matrix(batch.column(4).slice(lo, hi - lo), width)
                if kind == 0:
                    ids.append(own_ids)
                    parts.append(own_vectors)
                    continue
                if block is None:
                    if not ids:
                        continue
                    block = _Search(np.concatenate(ids), np.vstack(parts), k)
                at = 0
                while at < len(own_ids):
                    step = PIECE if np.isfinite(block.least).any() else FIRST_PIECE
                    block.offer(own_ids[at : at + step], own_vectors[at : at + step])
                    at += step
        if block is not None:
            yield result(block)

    def result(block: _Search) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(block.ids[block.rows]), pa.array(block.found), pa.array(block.scores)], names=["query_id", "vec_id", "score"])

    length = F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x)
    dealt = candidates.union(asking).repartition(wide * high, "c", "q").sortWithinPartitions("c", "q", "kind", length.desc())
    best = dealt.mapInArrow(tidied(search), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
