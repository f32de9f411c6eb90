"""Embedding near-duplicates by a pivot-permutation index (operator 9).

A vector is described by its ``LENGTH`` nearest of a set of reference vectors
(pivots), in order of nearness. Inverted lists, one per label and pivot, bring
together the vectors that name the pivot; two vectors are candidates when they
share at least ``SHARED`` pivots, and candidates are verified by their cosine in
double precision. A pair that meets in several lists counts in the list of its
smallest shared pivot only.

No pair becomes a row. Lists are cut into blocks, a cell is a pair of blocks, and
a cell returns, per vector, how many links it has there and one edge to the
smallest vector it is connected with inside the cell. Copies of a vector (equal
label and components) are one member with a weight and are never expanded.

Pivots are a bounded sample (smallest hash first) whose number grows with the
vectors per label so that lists stay short; every vector is indexed. A sampled
vector nearer than ``APART`` to an earlier pivot is no pivot: within a large group
of near copies all nearest pivots would be members of the group, and noise would
decide which. The lists of such a group are long and fall to the block cells.

Labels that are null, and vectors that are null, empty, zero or hold null or
non-finite components, link with nothing. Vectors of different length never
link. Repeated rows are copies: rows of one id and vector link with each other's
id only once per row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.llm.common import materialise
from rankfold.llm.components import components
from rankfold.llm.vptree import usable

LENGTH = 8
SHARED = 2
MIN_PIVOTS, MAX_PIVOTS = 64, 4096
#: largest cosine of two pivots
APART = 0.9
#: vectors sampled for one pivot
OVERSAMPLE = 2
LIST_ROWS = 1024
BLOCK_ROWS = 1024


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return arr.flatten().to_numpy(zero_copy_only=False).reshape(len(arr), -1)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index for n members and the undirected edges a-b."""
    low = np.arange(n)
    while True:
        m = low.copy()
        np.minimum.at(m, a, low[b])
        np.minimum.at(m, b, low[a])
        m = m[m]
        if (m == low).all():
            return low
        low = m


def _apart(sample: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` unit vectors no nearer than ``APART`` to one before them."""
    out, n = np.empty((count, sample.shape[1])), 0
    for x in sample:
        if n < count and not (out[:n] @ x > APART).any():
            out[n] = x
            n += 1
    return out[:n]


def links(vectors: DataFrame, threshold: float = 0.98, key: str = "vec_id", vec: str = "embedding",
          label: str = "label") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, counts, edges): members (rep, h, w) of each distinct vector,
    counts (rep, n) of weighted links found per cell, edges (src, dst) that span
    the linked vectors."""
    good = vectors.select(F.col(key).cast("long").alias("id"), F.col(vec).alias("v"), F.col(label).alias("label")) \
        .where(usable(F.col("v")) & F.col("label").isNotNull() & F.col("id").isNotNull()) \
        .withColumn("v", F.col("v").cast("array<double>"))
    members = materialise(good.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("w")), "pm")
    n, n_labels = members.agg(F.count(F.lit(1)), F.countDistinct("label")).first()
    count = min(MAX_PIVOTS, max(MIN_PIVOTS, math.ceil(n * LENGTH / max(1, n_labels) / LIST_ROWS)))
    rows = members.select("v").orderBy(F.xxhash64("v", F.lit(7))).limit(count * OVERSAMPLE).collect()
    width = max((len(r["v"]) for r in rows), default=1)
    sample = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        sample[i, :len(r["v"])] = np.asarray(r["v"]) / np.linalg.norm(r["v"])
    pivots = _apart(sample, count)
    shared_pivots = vectors.sparkSession.sparkContext.broadcast(pivots)
    length = min(LENGTH, max(1, len(pivots)))
    need = min(SHARED, length)

    def describe(batches):
        p = shared_pivots.value
        for b in batches:
            vs = b.column(b.schema.get_field_index("v"))
            out = np.empty((len(vs), length), np.int32)
            for i, x in enumerate(vs):
                x = np.asarray(x.as_py())
                d = min(len(x), p.shape[1])
                sims = p[:, :d] @ x[:d]
                top = np.argpartition(-sims, length - 1)[:length]
                out[i] = top[np.lexsort((top, -sims[top]))]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), length).cast(pa.list_(pa.int32()))],
                names=[*b.schema.names, "desc"])

    spec = f"label {members.schema['label'].dataType.simpleString()}, v array<double>, rep long, w long"
    described = members.select("label", "v", "rep", "w").mapInArrow(describe, spec + ", desc array<int>") \
        .withColumn("dim", F.size("v"))
    listed = described.withColumn("pivot", F.explode("desc"))
    sizes = described.select("label", "dim", F.explode("desc").alias("pivot")).groupBy("label", "dim", "pivot") \
        .agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    cells = listed.join(sizes, ["label", "dim", "pivot"]) \
        .withColumn("b", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")) \
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("label", "dim", "pivot", "v", "rep", "w", "desc", "b",
                F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"))

    def cell(group: tuple, t: pa.Table) -> pa.Table:
        _, _, pivot, lo, hi = (g.as_py() for g in group)
        x = _matrix(t["v"])
        x = x / np.sqrt((x * x).sum(1, keepdims=True))
        desc, rep, w = _matrix(t["desc"]), t["rep"].to_numpy(), t["w"].to_numpy()
        side = t["b"].to_numpy()
        i_of, j_of = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
        # what two vectors share is counted over the pivots of this cell only
        names, codes = np.unique(desc, return_inverse=True)
        hot = np.zeros((len(rep), len(names)), np.float32)
        hot[np.arange(len(rep))[:, None], codes.reshape(desc.shape)] = 1
        smaller = hot[:, :np.searchsorted(names, pivot)]
        shares = hot[i_of] @ hot[j_of].T >= need
        first = smaller[i_of] @ smaller[j_of].T == 0  # no smaller shared pivot: this list counts the pair
        a, b = np.nonzero(shares & first & (x[i_of] @ x[j_of].T >= threshold - 1e-9))
        a, b = i_of[a], j_of[b]
        if lo == hi:
            a, b = a[a < b], b[a < b]
        ok = (x[a] * x[b]).sum(1) >= threshold
        a, b = a[ok], b[ok]
        n = np.bincount(a, w[b], len(rep)) + np.bincount(b, w[a], len(rep))
        by_rep = np.argsort(rep, kind="stable")
        place = np.empty(len(rep), np.int64)
        place[by_rep] = np.arange(len(rep))
        root = rep[by_rep][_roots(len(rep), place[a], place[b])[place]]
        at = n > 0
        return pa.table([pa.array(rep[at]), pa.array(n[at].astype(np.int64)), pa.array(root[at])],
                        names=["rep", "n", "root"])

    found = materialise(cells.groupBy("label", "dim", "pivot", "lo", "hi").applyInArrow(
        cell, "rep long, n long, root long"), "pl")
    return members, found.select("rep", "n"), found.select(F.col("rep").alias("src"), F.col("root").alias("dst"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, key: str = "vec_id", vec: str = "embedding",
                    label: str = "label") -> DataFrame:
    """(key, n_links long, component_id long, kept boolean) per row."""
    members, counts, edges = links(vectors, threshold, key, vec, label)
    comp = components(edges)
    n = counts.groupBy("rep").agg(F.sum("n").alias("n"))
    per = members.join(n, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left") \
        .select(F.col("label").alias("_l"), F.col("v").alias("_v"),
                (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"),
                F.coalesce("component", "rep").alias("component_id"))
    ok = usable(F.col("v")) & F.col("label").isNotNull() & F.col("id").isNotNull()
    rows = vectors.select(F.col(key).alias("id"), F.col(vec).alias("v"), F.col(label).alias("label"))
    linked = rows.where(ok).withColumn("v", F.col("v").cast("array<double>")) \
        .join(per, (F.col("label") == F.col("_l")) & (F.col("v") == F.col("_v")))
    alone = rows.where(~ok).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.select("id", "n_links", "component_id").unionByName(alone) \
        .select(F.col("id").alias(key), "n_links", "component_id",
                F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
