"""Nearest neighbours by inner product with vantage-point trees, one per shard of the vectors.

Inner products are turned into distances: with M the longest vector of a shard, x gets one more coordinate
sqrt(M**2 - |x|**2) and a query gets 0 there. Then distance**2 = |q|**2 + M**2 - 2 * q.x, so the nearest are those of the
largest product. A tree splits a shard at the median distance to a vantage point; a search goes down the nearer side first
and enters the other side only if  factor * |distance - median| <= distance of the k-th best so far.  By the
triangle inequality factor 1 loses nothing; a larger one leaves out sides that rarely hold an answer.

Queries are not broadcast: they are sent to every shard and stream past its tree in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.joins import hot_keys, join_apart
from millrace.session import stage

K = 20
FACTOR = 1.1
SHARD_ROWS = 8192
LEAF = 128
# Queries that go down a tree together.
BLOCK = 2048


class VantageTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF, seed: int = 0) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], vectors[order].astype(np.float64)
        square = (self.x**2).sum(axis=1)
        self.top = float(square.max(initial=0.0))
        self.extra = np.sqrt(np.maximum(self.top - square, 0))
        self.leaf, self.rng = leaf, np.random.default_rng(seed)
        self.root = self._built(np.arange(len(self.ids)))

    def _built(self, rows: np.ndarray):
        """A leaf as its rows, else (vantage row, median distance, inside, outside)."""
        if len(rows) <= self.leaf:
            return rows
        vantage = rows[self.rng.integers(len(rows))]
        product = self.x[rows] @ self.x[vantage] + self.extra[rows] * self.extra[vantage]
        distance = np.sqrt(np.maximum(2 * self.top - 2 * product, 0))
        middle = float(np.median(distance))
        inside = distance <= middle
        if inside.all():  # equal vectors cannot be told apart
            middle = float(distance.max()) if distance.max() > distance.min() else middle
            inside = distance < middle
            if not inside.any() or inside.all():
                return rows
            middle = float(distance[inside].max())
        return vantage, middle, self._built(rows[inside]), self._built(rows[~inside])

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(scores, rows) of the k best of each query, best first, ties to the smaller id; -1 where there is none."""
        q = queries.astype(np.float64)
        self.q, self.query_ids, self.k, self.factor = q, query_ids, k, factor
        self.square = (q**2).sum(axis=1)
        self.scores = np.full((len(q), k), -np.inf)
        self.rows = np.full((len(q), k), -1, np.int64)
        self._visit(self.root, np.arange(len(q)))
        return self.scores, self.rows

    def _reach(self, at: np.ndarray) -> np.ndarray:
        """Distance of the k-th best so far, a little enlarged so that rounding loses no tie."""
        worst = self.scores[at, -1]
        square = self.square[at] + self.top
        with np.errstate(invalid="ignore"):
            reach = np.sqrt(np.maximum(square - 2 * worst + 1e-9 * square, 0))
        return np.where(np.isneginf(worst), np.inf, reach)

    def _visit(self, node, at: np.ndarray) -> None:
        if not len(at):
            return
        if isinstance(node, np.ndarray):
            return self._scan(node, at)
        vantage, middle, inside, outside = node
        square = self.square[at] + self.top
        distance = np.sqrt(np.maximum(square - 2 * (self.q[at] @ self.x[vantage]), 0))
        near = distance <= middle
        self._visit(inside, at[near])
        self._visit(outside, at[~near])
        margin = self.factor * np.abs(distance - middle)
        self._visit(outside, at[near][margin[near] <= self._reach(at[near])])
        self._visit(inside, at[~near][margin[~near] <= self._reach(at[~near])])

    def _scan(self, rows: np.ndarray, at: np.ndarray) -> None:
        rough = self.q[at] @ self.x[rows].T
        rough[self.ids[rows][None, :] == self.query_ids[at][:, None]] = -np.inf
        slack = 1e-9 * (self.square[at] + self.top)
        one, two = np.nonzero((rough >= (self.scores[at, -1] - slack)[:, None]) & ~np.isneginf(rough))
        if not len(one):
            return
        # Added coordinate by coordinate, so equal vectors have equal scores wherever they lie.
        exact = np.zeros(len(one))
        qs, xs = self.q[at[one]], self.x[rows[two]]
        for d in range(qs.shape[1]):
            exact += qs[:, d] * xs[:, d]
        touched = np.unique(one)
        held = at[touched]
        who = np.concatenate([np.repeat(held, self.k), at[one]])
        score = np.concatenate([self.scores[held].reshape(-1), exact])
        row = np.concatenate([self.rows[held].reshape(-1), rows[two]])
        order = np.lexsort((row, -score, who))  # rows lie in the order of their ids
        who, score, row = who[order], score[order], row[order]
        first = np.searchsorted(who, held)
        take = first[:, None] + np.arange(self.k)
        self.scores[held], self.rows[held] = score[take], row[take]


def usable(vector: str) -> Column:
    """Whether a vector takes part: not null, of finite components, not all of them zero."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = K,
    factor: float = FACTOR,
    shard_rows: int = SHARD_ROWS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every query the ``k`` rows of largest inner product that were found.

    Vectors that are null, zero or hold null or non-finite components take no part, on either side, nor do null
    ids; vectors of another length than a query's are no candidates of it. Rows with the query's own id are no candidates.
    Repeated rows are candidates each. Fewer than ``k`` candidates give fewer rows, none gives none. Ties go to the smaller id.
    Scores are sums of products in double precision. Other columns are not passed on.
    """
    taken = lambda df: df.where(usable(vector_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.size(vector_col).alias("width")
    )
    held = taken(vectors)
    per_width = held.groupBy("width").agg(F.count(F.lit(1)).alias("n")).withColumn("shards", F.ceil(F.col("n") / shard_rows))
    sizes = stage(per_width, "vp-widths")
    parts = sizes.agg(F.sum("shards")).first()[0]
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    hot = stage(hot_keys(sizes, "width"), "vp-hot")
    numbered = lambda df: join_apart(df, sizes.select("width", "shards"), "width", hot)
    # Repeated rows of one id are dealt over all shards as well.
    rows = numbered(held).select(F.struct("width", F.pmod(F.xxhash64("id", "v"), F.col("shards")).alias("no")).alias("shard"), F.lit(0).alias("kind"), "id", "v")
    asked = numbered(taken(queries)).select(
        F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1), lambda s: F.struct("width", s.alias("no")))).alias("shard"), F.lit(1).alias("kind"), "id", "v"
    )
    dealt = rows.union(asked).select(F.xxhash64("shard").alias("shard"), "kind", "id", "v").repartition(parts, "shard").sortWithinPartitions("shard", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, blocks, tree = None, [], [], None
        for batch in batches:
            of, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((of[1:] != of[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(of)]):
                part = batch.slice(a, b - a)
                if of[a] != shard:
                    shard, ids, blocks, tree = of[a], [], [], None
                key = part.column(2).to_numpy()
                x = part.column(3).flatten().to_numpy().reshape(len(key), -1)
                if kind[a] == 0:
                    ids.append(key)
                    blocks.append(x)
                    continue
                if not ids:
                    continue
                if tree is None:
                    tree = VantageTree(np.concatenate(ids), np.concatenate(blocks))
                for at in range(0, len(key), BLOCK):
                    q = key[at : at + BLOCK]
                    scores, found = tree.search(q, x[at : at + BLOCK], k, factor)
                    real = found >= 0
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.broadcast_to(q[:, None], found.shape)[real]),
                            pa.array(tree.ids[found[real]]),
                            pa.array(scores[real]),
                        ],
                        ["query_id", "vec_id", "score"],
                    )

    found = dealt.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    # At most k rows of each shard come together here.
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
