"""Nearest neighbours by vantage-point trees, one per shard, with a tunable relaxation of the triangle inequality.

Rows are dealt to shards by row number. A shard's tree is a written table: rows in the order of the tree, each inner node with the range
of distances from it to the rows of either half (halves are cut by rank, so equal vectors can't unbalance a tree). A block
of queries goes through a tree at once; a half whose distances lie ``gap`` off the query's is left out if ``factor * gap`` exceeds the
distance of the k-th nearest so far. Factor one is exact; larger ones skip more. Every row is indexed and every shard is
searched for every query; per query and shard at most k rows come back.

Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, take no part. Only
vectors of one length are compared. A query's own id is never its neighbour; repeated query rows are answered each, repeated
candidates count each; ties go to the smaller id. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill.llm.common import CHUNK_ROWS, numbered, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAF = 48
#: Queries of one block.
BLOCK = 1024


def shard_rows(n: int) -> int:
    """Vectors per shard: grows with the root of their number, so that neither shards nor answers per query get too many."""
    return int(min(65_536, max(1024, 8 * n**0.5)))


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: F.coalesce(x, F.lit(0.0)) != 0)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows of ``a`` (q x d) to rows of ``b`` (n x d); each value depends on its two rows alone."""
    out = np.empty((len(a), len(b)))
    step = max(1, 2_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        out[i : i + step] = np.sqrt(((a[i : i + step, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    return out


def _halves(a: int, b: int) -> int:
    """Where the outer half of node a .. b begins."""
    return a + 1 + (b - a) // 2


def planted(x: np.ndarray, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(order, bounds): rows in tree order, and for each inner node the least and largest distance to its inner and outer half."""
    rng, order, bounds = np.random.default_rng(seed), np.arange(len(x)), np.full((len(x), 4), np.nan)
    todo = [(0, len(x))]
    while todo:
        a, b = todo.pop()
        if b - a <= LEAF:
            continue
        own = order[a:b]
        sample, tries = x[rng.choice(own, min(64, len(own)), replace=False)], rng.choice(len(own), min(4, len(own)), replace=False)
        best = max(tries.tolist(), key=lambda t: _apart(x[own[t : t + 1]], sample).var())
        own[[0, best]] = own[[best, 0]]
        d = _apart(x[own[:1]], x[own[1:]])[0]
        by = np.argsort(d, kind="stable")
        order[a + 1 : b] = own[1:][by]
        m = _halves(a, b)
        d = d[by]
        bounds[a] = d[0], d[m - a - 2], d[m - a - 1], d[-1]
        todo += [(a + 1, m), (m, b)]
    return order, bounds


class _Search:
    def __init__(self, x, ids, bounds, queries, own, k, factor):
        self.x, self.ids, self.bounds, self.q, self.own, self.k, self.factor = x, ids, bounds, queries, own, k, factor
        self.d, self.found = np.full((len(queries), k), np.inf), np.full((len(queries), k), np.iinfo(np.int64).max)

    def offer(self, at: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        d = np.where(ids[None, :] == self.own[at, None], np.inf, d)
        use = (d <= self.d[at, -1:]).any(axis=1)
        at, d = at[use], d[use]
        if len(at):
            all_d = np.hstack([self.d[at], d])
            all_ids = np.hstack([self.found[at], np.broadcast_to(ids, d.shape)])
            first = np.lexsort((all_ids, all_d), axis=1)[:, : self.k]
            self.d[at], self.found[at] = np.take_along_axis(all_d, first, 1), np.take_along_axis(all_ids, first, 1)

    def visit(self, a: int, b: int, at: np.ndarray) -> None:
        if not len(at) or a >= b:
            return
        if b - a <= LEAF:
            self.offer(at, _apart(self.q[at], self.x[a:b]), self.ids[a:b])
            return
        d = _apart(self.q[at], self.x[a : a + 1])
        self.offer(at, d, self.ids[a : a + 1])
        d, m, (in0, in1, out0, out1) = d[:, 0], _halves(a, b), self.bounds[a]
        gap_in, gap_out = np.maximum(in0 - d, d - in1).clip(0), np.maximum(out0 - d, d - out1).clip(0)
        inner = gap_in <= gap_out
        self.visit(a + 1, m, at[inner])
        self.visit(m, b, at[~inner])
        # what rounding may add to a gap must not hide a tie
        self.visit(m, b, at[inner][self.factor * gap_out[inner] <= self.d[at[inner], -1] * (1 + 1e-12) + 1e-12])
        self.visit(a + 1, m, at[~inner][self.factor * gap_in[~inner] <= self.d[at[~inner], -1] * (1 + 1e-12) + 1e-12])


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def index(vectors: DataFrame) -> DataFrame:
    """(dim, shard, pos, vec_id, embedding, bounds) of every usable row, written."""
    rows = written(numbered(vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))), "vectors")
    n = rows.count()
    shards = max(1, -(-n // shard_rows(n)))
    dealt = rows.select(F.size("embedding").alias("dim"), F.pmod(F.col("_chunk") * CHUNK_ROWS + F.col("_pos") + F.col("_chunk"), F.lit(shards)).alias("shard"), "vec_id", "embedding")

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", ignore_index=True)
        order, bounds = planted(_matrix(pdf["embedding"]))
        pdf = pdf.iloc[order].reset_index(drop=True)
        return pdf.assign(pos=np.arange(len(pdf)), bounds=[None if np.isnan(x[0]) else x.tolist() for x in bounds])[["dim", "shard", "pos", "vec_id", "embedding", "bounds"]]

    return written(dealt.groupBy("dim", "shard").applyInPandas(plant, "dim int, shard long, pos long, vec_id long, embedding array<float>, bounds array<double>"), "index")


def search(tree: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each usable row of ``queries`` (vec_id, embedding)."""
    asked = queries.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    asked = written(numbered(asked).select((F.col("_chunk") * CHUNK_ROWS + F.col("_pos")).alias("query"), "vec_id", "embedding", F.size("embedding").alias("dim")), "queries")
    blocks = max(1, -(-asked.count() // BLOCK))
    shards = written(tree.select("dim", "shard").distinct(), "shards")
    left = tree.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    right = asked.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks))).join(shards, "dim")

    def one(tree: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []}).astype({"query": "int64", "query_id": "int64", "vec_id": "int64"})
        if not len(tree) or not len(asked):
            return empty
        tree = tree.sort_values("pos")
        bounds = np.stack([np.full(4, np.nan) if v is None else np.asarray(v) for v in tree["bounds"]])
        own = asked["vec_id"].to_numpy(np.int64)
        s = _Search(_matrix(tree["embedding"]), tree["vec_id"].to_numpy(np.int64), bounds, _matrix(asked["embedding"]), own, k, factor)
        s.visit(0, len(tree), np.arange(len(asked)))
        q, j = np.nonzero(np.isfinite(s.d))
        return pd.DataFrame({"query": asked["query"].to_numpy()[q], "query_id": own[q], "vec_id": s.found[q, j], "score": s.d[q, j]})

    keys = ["dim", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(one, "query long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
