"""Exact top-k inner products by block-at-a-time pruning.

Candidates are dealt into chunks of bounded size by a hash of id and vector, each to one chunk; a chunk is sorted so that like vectors stand together and cut into
blocks (document ranges) that know each term's largest and smallest weight. For a query, the sum over its terms of weight times the block's extreme bounds
the score of every document in a block. Blocks are taken by falling bound; a block's documents are scored through its forward index (the block's rows of
weights) until the next bound is below the k-th score so far. Bounds equal to it are still scored, since a tie may have a smaller id.

A query visits one chunk first; its k-th score there is a floor that the k-th score of all can't be below, and with which it visits all chunks. So a chunk is left
as soon as no block's bound reaches the floor, and sends only what reaches it. A last step merges what the chunks send. A candidate is copied only once for
each MEET queries, as a task holds one chunk and at most about MEET queries.

Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without an id; a vector whose length is not that of the query
is no candidate for it. Repeated rows are candidates each; they
travel as one row with a count, at most k, as no more can be among the k best. Ties go to the smaller id. Query rows that repeat
are one query; different vectors under one query id are each searched and their lists merged, so a candidate may stand in it for each. Where products
could leave the range in which doubles are exact, a chunk is scored as whole numbers of any size, without bounds; a component or score that does not fit
64 bits counts as the largest or least that does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK, QUERIES, BLOCK, MEET = 8192, 512, 64, 1 << 15
#: Below every score.
NO_FLOOR = -(1 << 63)


def integer_vectors(rows: DataFrame, id_column: str, vector_column: str, scale: int = 64) -> DataFrame:
    """id and floor(scale * x) of every component, for the rows that take part."""
    x = F.col(vector_column).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(math.inf)))
    return rows.where(F.col(id_column).isNotNull() & x.isNotNull() & (F.size(x) > 0) & fine).select(
        F.col(id_column).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * scale)).alias("v"))


def _exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of any size, brought into 64 bits."""
    scores = vectors.astype(object) @ query.astype(object)
    return np.array([min(max(s, 1 - (1 << 63)), (1 << 63) - 1) for s in scores], np.int64)


class Blocks:
    """A chunk of candidates, cut into blocks."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        # Like vectors together: by the term of the largest weight, then by that weight.
        top = np.abs(vectors).argmax(1)
        order = np.lexsort((ids, vectors[np.arange(len(ids)), top], top))
        self.ids, self.whole = ids[order], vectors[order]
        self.vectors = self.whole.astype(np.float64)
        self.cuts = np.arange(0, len(ids), BLOCK)
        self.most = np.maximum.reduceat(self.vectors, self.cuts)
        self.least = np.minimum.reduceat(self.vectors, self.cuts)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and scores of each query's k best in this chunk, of those that reach its floor."""
        q = queries.astype(np.float64)
        exact = np.abs(q).max(initial=0) * np.abs(self.vectors).max(initial=0) * max(1, q.shape[1]) < 2.0 ** 53
        bounds = np.maximum(q, 0) @ self.most.T + np.minimum(q, 0) @ self.least.T if exact else np.full((len(q), len(self.cuts)), np.inf)
        orders = np.argsort(-bounds, axis=1, kind="stable")
        for row, (own, order) in enumerate(zip(query_ids, orders, strict=True)):
            ids, scores, kth, at, step = np.zeros(0, np.int64), np.zeros(0, float if exact else np.int64), int(floors[row]), 0, 4
            while at < len(order) and bounds[row, order[at]] >= kth:
                blocks = order[at:at + step]
                blocks = blocks[bounds[row, blocks] >= kth]
                at, step = at + step, 2 * step
                places = (self.cuts[blocks][:, None] + np.arange(BLOCK)).ravel()
                places = places[places < len(self.ids)]
                got = self.vectors[places] @ q[row] if exact else _exact(self.whole[places], queries[row])
                keep = (got >= kth) & (self.ids[places] != own)
                ids, scores = np.r_[ids, self.ids[places[keep]]], np.r_[scores, got[keep]]
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                if len(ids) == k:
                    kth = max(kth, int(scores[-1]))
            yield ids, scores.astype(np.int64)


def _searched(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> Iterator[tuple[pd.DataFrame, list[tuple[np.ndarray, np.ndarray]]]]:
    """Queries of one length, and what each finds in a chunk; those without candidates of their length are left out."""
    candidates = candidates.loc[candidates.index.repeat(candidates.times)]
    width = candidates.v.str.len()
    for w, some in queries.groupby(queries.v.str.len()):
        other = candidates[width == w]
        if len(other):
            blocks = Blocks(other.id.to_numpy(), np.stack(other.v.to_numpy()))
            for a in range(0, len(some), QUERIES):
                own = some.iloc[a:a + QUERIES]
                yield own, list(blocks.search(own.id.to_numpy(), np.stack(own.v.to_numpy()), own.floor.to_numpy(), k))


def top_k(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    """query_id, rank, id and score of the k best candidates of each query. rows: id, v (64-bit integers); is_query: over id."""
    rows = rows.select("id", F.col("v").cast("array<long>").alias("v"))
    n, asked = rows.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    chunks, parts = max(1, math.ceil(n / CHUNK)), max(1, math.ceil(asked / MEET))

    def numbers(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)).cast("array<long>"))

    def dealt(seed: int, count: int) -> Column:
        return F.pmod(F.xxhash64("id", "v", F.lit(seed)), F.lit(count))

    rows = rows.groupBy("id", "v").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("times"))
    candidates = rows.withColumn("chunk", dealt(0, chunks)).withColumn("part", numbers(parts)).groupBy("chunk", "part")
    queries = rows.where(is_query).select("id", "v", F.lit(NO_FLOOR).alias("floor"), dealt(1, parts).alias("part"))

    def floors(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        floor = pd.Series(NO_FLOOR, left.index)
        for own, found in _searched(left, right, k):
            floor[own.index] = [int(scores[-1]) if len(scores) == k else NO_FLOOR for _, scores in found]
        return left[["id", "v", "part"]].assign(floor=floor)

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns: tuple[list[np.ndarray], ...] = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
        for own, found in _searched(left, right, k):
            for query, (ids, scores) in zip(own.id, found, strict=True):
                for column, values in zip(columns, (np.full(len(ids), query), ids, scores), strict=True):
                    column.append(values)
        return pd.DataFrame({c: np.concatenate(v) for c, v in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    if chunks > 1:
        queries = queries.withColumn("chunk", dealt(2, chunks)).groupBy("chunk", "part").cogroup(candidates).applyInPandas(
            floors, "id long, v array<long>, part long, floor long")
    found = queries.withColumn("chunk", numbers(chunks)).groupBy("chunk", "part").cogroup(candidates).applyInPandas(
        search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = len(embedding)),
s AS (
  SELECT q.id AS query_id, c.id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.id % 20 = 0 AND q.id <> c.id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
