"""Approximate nearest neighbours by inner product (operator 7).

Inner product search becomes Euclidean search by one more component: with M the
largest norm, a candidate x is (x, sqrt(M^2 - |x|^2)) and a query q is (q, 0), so
the nearest candidate is the one with the largest inner product.

Candidates are dealt into shards of about ``shard_rows`` distinct vectors. Each
(shard, query block) cell builds a vantage-point tree of its shard and descends
with all queries of the block at once: a node's vantage point splits its vectors
at the median distance, and a half is skipped for a query when the triangle
inequality, relaxed by ``factor``, shows that it cannot hold one of its k best:
|d - median| > factor * (distance of the k-th best so far). Factor 1 is exact;
smaller factors prune more.

Copies of a vector are searched once and expanded afterwards (at most k + 1 of
the smallest ids of a vector can be among k neighbours). Only k rows per query
and shard leave a cell; a window keeps the k best.

Vectors that are null, empty, zero or hold null or non-finite components take no
part; vectors are compared with those of the same length. Equal scores go to the
smaller id, also where more vectors than k are tied: a query with a tie at its k-th
product is searched exactly. Fewer than k candidates give fewer rows. Repeated rows
(same id and vector) count as one candidate; an id with several vectors is a candidate
with each and a query with the smallest; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankfold.llm.common import materialise

SHARD_ROWS = 16384
QUERY_ROWS = 4096
LEAF = 256
#: share of the exact pruning radius; measured recall is in the README
FACTOR = 0.35


def usable(vec: Column) -> Column:
    return (F.coalesce(F.size(vec), F.lit(-1)) > 0) \
        & F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)) \
        & F.coalesce(F.exists(vec, lambda x: x != 0), F.lit(False))


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    flat = col.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1).astype(np.float64)


class Tree:
    """Vantage-point tree over the rows of ``x``; nodes are index ranges of ``order``."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x, self.leaf = x, leaf
        self.order = np.arange(len(x))
        self.root = self._build(0, len(x))

    def _build(self, lo: int, hi: int):
        if hi - lo <= self.leaf:
            return lo, hi, None
        own = self.order[lo:hi]
        spread = np.linalg.norm(self.x[own] - self.x[own].mean(0), axis=1)
        vp = own[np.argmax(spread)]  # a far point separates better than a central one
        d = np.linalg.norm(self.x[own] - self.x[vp], axis=1)
        mid = (hi - lo) // 2
        part = np.argpartition(d, mid)
        self.order[lo:hi] = own[part]
        return lo, hi, (vp, float(d[part[mid]]), self._build(lo, lo + mid), self._build(lo + mid, hi))

    def search(self, q: np.ndarray, k: int, factor: float, order: np.ndarray,
               wanted: int | None = None) -> np.ndarray:
        """Rows of the k largest inner products of every query, shape (queries, k), in
        no order; -1: none. Equal products: smaller ``order`` first. A query whose
        ``wanted``-th product is tied is searched again with factor 1, as halves that
        the relaxed rule skips may hold more of the tie."""
        own = self.x[:, :q.shape[1]]
        self.q, self.k, self.order_of, self.plain = q, k, order, own
        self.q2 = (q * q).sum(1)
        self.m2 = float((self.x * self.x).sum(1).max(initial=0.0))
        self.tol = 1e-12 * np.sqrt(self.q2 * self.m2)
        self.dot = np.full((len(q), k), -np.inf)
        self.row = np.full((len(q), k), -1)
        self.bound = np.full(len(q), -np.inf)
        self.crowded = np.zeros(len(q), bool)
        everyone = np.arange(len(q))
        self.factor = factor
        self._descend(self.root, everyone)
        if factor < 1:
            at = -np.sort(-self.dot, axis=1)
            last = min(wanted or k, k) - 1
            near = (np.abs(at - at[:, last:last + 1]) <= self.tol[:, None]) & np.isfinite(at)
            again = everyone[self.crowded | (near.sum(1) > 1)]
            self.bound[again] = at[again, k - 1]
            self.dot[again], self.row[again], self.factor = -np.inf, -1, 1.0
            self._descend(self.root, again)
        return self.row

    def _take(self, who: np.ndarray, own: np.ndarray) -> None:
        """Offers the rows ``own`` to the queries ``who``."""
        s = np.hstack([self.dot[who], self.q[who] @ self.plain[own].T])
        rows = np.hstack([self.row[who], np.broadcast_to(own, (len(who), len(own)))])
        if s.shape[1] > self.k:
            best = np.argpartition(-s, self.k - 1, axis=1)[:, :self.k]
            kth = np.take_along_axis(s, best, 1).min(1)
            near = s >= (kth - self.tol[who])[:, None]
            tied = np.flatnonzero(np.isfinite(kth) & (near.sum(1) > self.k))
            for i in tied:
                c = np.flatnonzero(near[i])
                exact = (self.q[who[i]] * self.plain[rows[i, c]]).sum(1)
                best[i] = c[np.lexsort((self.order_of[rows[i, c]], -exact))[:self.k]]
            self.crowded[who[tied]] = True
            s, rows = np.take_along_axis(s, best, 1), np.take_along_axis(rows, best, 1)
        self.dot[who], self.row[who] = s, rows

    def _descend(self, node, who: np.ndarray) -> None:
        lo, hi, inner = node
        if not len(who):
            return
        if inner is None:
            self._take(who, self.order[lo:hi])
            return
        vp, median, near, far = inner
        x2 = float(self.x[vp] @ self.x[vp])
        d = np.sqrt(np.maximum(self.q2[who] + x2 - 2 * (self.q[who] @ self.plain[vp]), 0))
        inside = d <= median
        for first, second, side in ((near, far, inside), (far, near, ~inside)):
            mine, gap = who[side], np.abs(d[side] - median)
            self._descend(first, mine)
            kth = np.maximum(self.dot[mine].min(1), self.bound[mine]) - self.tol[mine]
            span = self.q2[mine] + self.m2
            radius = np.sqrt(np.maximum(span - 2 * kth, 0))
            # a bound that equals the radius is never skipped, whatever was rounded
            self._descend(second, mine[gap <= self.factor * radius + 1e-7 * np.sqrt(span)])


def search(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vec: str = "embedding",
           factor: float = FACTOR, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id long, rank int, vec_id long, score double): for every row of
    ``vectors`` that fulfils ``is_query``, its k nearest other rows."""
    good = vectors.select(F.col(key).cast("long").alias("id"), F.col(vec).alias("v"), is_query.alias("isq")) \
        .where(usable(F.col("v")) & F.col("id").isNotNull()) \
        .withColumn("v", F.col("v").cast("array<double>")).withColumn("dim", F.size("v")) \
        .withColumn("h", F.xxhash64("v"))
    # one row per distinct vector, with the k + 1 smallest of its ids
    ranked = good.select("h", "v", "dim", "id").distinct() \
        .withColumn("rn", F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))).where(F.col("rn") <= k + 1)
    distinct = materialise(ranked.groupBy("h", "v", "dim").agg(F.array_sort(F.collect_list("id")).alias("ids")), "ann")
    info = distinct.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate(
        "v", F.lit(0.0), lambda a, x: a + x * x)).alias("m2")).first()
    n, m2 = info["n"], info["m2"] or 0.0
    shards = max(1, math.ceil(n / shard_rows))
    queries = good.where(F.coalesce("isq", F.lit(False))).groupBy("id").agg(F.min("v").alias("v")) \
        .withColumn("dim", F.size("v"))
    blocks = max(1, math.ceil(queries.count() / QUERY_ROWS))

    def cell(group: tuple, q: pa.Table, c: pa.Table) -> pa.Table:
        names = ["id", "ids", "score"]
        if not q.num_rows or not c.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.list_(pa.int64())),
                             pa.array([], pa.float64())], names=names)
        qm, cm = _matrix(q["v"]), _matrix(c["v"])
        extra = np.sqrt(np.maximum(m2 - (cm * cm).sum(1), 0))
        tree = Tree(np.hstack([cm, extra[:, None]]))
        # a few more than k: the query itself may be among them, and products that
        # differ in the last places are settled by the exact scores below
        first_id = c["ids"].combine_chunks()
        order = first_id.flatten().to_numpy()[first_id.offsets.to_numpy()[:-1] - first_id.offsets[0].as_py()]
        rows = tree.search(qm, min(len(cm), k + 6), factor, order, k + 1)
        qi = np.repeat(np.arange(len(qm)), rows.shape[1])
        ri = rows.ravel()
        qi, ri = qi[ri >= 0], ri[ri >= 0]
        score = (qm[qi] * cm[ri]).sum(1)
        return pa.table([q["id"].combine_chunks().take(pa.array(qi)), c["ids"].combine_chunks().take(pa.array(ri)),
                         pa.array(score)], names=names)

    left = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")) \
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = distinct.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int")) \
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = left.groupBy("dim", "shard", "block").cogroup(right.groupBy("dim", "shard", "block")) \
        .applyInArrow(cell, "id long, ids array<long>, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.select(F.col("id").alias("query_id"), F.explode("ids").alias("vec_id"), "score") \
        .where("vec_id <> query_id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
