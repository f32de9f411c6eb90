"""Truncated SVD of a sparse matrix given as long rows (M12, M13): block Lanczos.

One method for every size. With A the matrix and its short side the columns, the basis
of a Krylov space of A'A grows by one block of vectors a step:

  Z = A'(A V)          two sparse-by-dense products
  T = B'Z              coefficients on the basis so far; Z loses them (twice, so that
                       the basis stays orthonormal) and what is left, whitened, is
                       the next block V
  T = S diag(t) S'     Ritz values and vectors of a small matrix on the driver

The residual of a Ritz vector, |A'A v - t v|, is the norm of the left-over block's share
in it, so no further pass is needed to know it. Steps end when the residuals of all k
wanted vectors are below ``TOLERANCE`` times the largest Ritz value, or when nothing is
left over (the basis then spans an invariant space: the decomposition is exact; a matrix
with at most 2 k columns gets there in one step). A basis that grows beyond ``BASIS`` k and
``LEAST_BASIS`` columns is restarted from its best Ritz vectors.

Sparse-by-dense product: the entries are dealt into a grid of cells by (source block,
destination part), so neither a hot row nor a hot column meets in one task. A task holds
its block of the dense matrix and streams its entries, sorted by destination: what leaves
it is one row of sums per destination, not one row per entry. Blocks are bounded in bytes,
and the grid is cut so that the dense rows copied and the sums sent are fewest: parts for
a short source side, blocks for a short destination side. Only if there are several blocks
are the cells' sums added up by a second exchange.

The driver sees matrices of basis x block numbers; all tables stay distributed and each
step is checkpointed in the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.session import checkpoint_dir, ship_package

#: relative residual at which a vector counts as found; share below which a direction is none
TOLERANCE, NOTHING = 1e-8, 1e-9
#: a restart keeps the basis at about so many times k columns, but at least so many
BASIS, LEAST_BASIS = 8, 256
BLOCK_BYTES = 64 << 20
ROW = "id string, arr array<double>"


@dataclass
class Decomposition:
    columns: DataFrame     # id, arr: right vectors, one row per column of the matrix
    sigma: np.ndarray
    residual: float        # largest |A'A v - t v| / largest t
    steps: int


def _matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(n, -1)


def _arrays(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


def _batch(ids, m: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids if isinstance(ids, pa.Array) else pa.array(ids, pa.string()), _arrays(m)],
                                      names=["id", "arr"])


class _Sums:
    """Adds up vectors of equal consecutive ids; the last id waits for what follows."""

    def __init__(self):
        self.id, self.sum = None, None

    def add(self, ids: pa.Array, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        codes = pc.dictionary_encode(ids).combine_chunks() if isinstance(ids, pa.ChunkedArray) else pc.dictionary_encode(ids)
        at = np.flatnonzero(np.diff(codes.indices.to_numpy(), prepend=-1))
        sums = np.add.reduceat(rows, at)
        names = codes.dictionary
        if self.id is not None:
            if names[0].as_py() == self.id:
                sums[0] += self.sum
            else:
                yield from self.rest()
        if len(names) > 1:
            yield _batch(names.slice(0, len(names) - 1), sums[:-1])
        self.id, self.sum = names[len(names) - 1].as_py(), sums[-1]

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.id is not None:
            yield _batch([self.id], self.sum[None, :])
        self.id = None


def sum_rows(rows: DataFrame) -> DataFrame:
    """(id, arr): the sum of the vectors of each id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for b in batches:
            if b.num_rows:
                yield from sums.add(b.column(0), _matrix(b.column(1), b.num_rows))
        yield from sums.rest()

    parts = rows.sparkSession.sparkContext.defaultParallelism
    return rows.select("id", "arr").repartition(parts, "id").sortWithinPartitions("id").mapInArrow(run, ROW)


def blocks_for(n_src: int, n_dst: int | None, width: int, cells: int) -> int:
    """Source blocks of a product: enough for their bytes, and of those up to ``cells`` the
    number with the fewest rows sent (copies of dense rows, sums of several blocks)."""
    least = max(1, math.ceil(n_src * width * 8 / BLOCK_BYTES))
    if n_dst is None or least >= cells:
        return least
    sent = lambda b: n_src * max(1, cells // b) + (n_dst * b if b > 1 else 0)
    return min((b for b in {least, *(2 ** i for i in range(16)), cells} if least <= b <= cells), key=lambda b: (sent(b), b))


def multiply(a: DataFrame, x: DataFrame, src: str, dst: str, n_src: int, width: int, n_dst: int | None = None) -> DataFrame:
    """(id, arr): for every ``dst`` the sum over its entries of s * x[src]. ``a`` has the
    columns src, dst, s; ``x`` (id, arr of ``width``); sources without a vector add nothing."""
    ship_package(a.sparkSession)
    cells = 2 * a.sparkSession.sparkContext.defaultParallelism
    blocks = blocks_for(n_src, n_dst, width, cells)
    parts = max(1, cells // blocks)
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    part = F.pmod(F.xxhash64(F.lit(1), dst), F.lit(parts)).cast("int")
    none = lambda t: F.lit(None).cast(t)
    every = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: i * blocks + block("id"))
    # an empty array, not a null one: null arrays reach the tasks several times slower
    no_vector = F.array().cast("array<double>")
    dense = x.select(F.explode(every).alias("cell"),
                     F.lit(0).alias("side"), F.col("id").alias("src"), none("string").alias("dst"),
                     none("double").alias("s"), "arr")
    sparse = a.select((part * blocks + block(src)).alias("cell"), F.lit(1).alias("side"), F.col(src).alias("src"),
                      F.col(dst).alias("dst"), "s", no_vector.alias("arr"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, rows, held, sums = None, [], [], None, _Sums()
        for b in batches:
            cell, side = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(cell) != 0) | (np.diff(side) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, b.num_rows]):
                if hi <= lo:
                    continue
                if cell[lo] != now:
                    yield from sums.rest()
                    now, ids, rows, held = cell[lo], [], [], None
                own = b.slice(lo, hi - lo)
                if side[lo] == 0:
                    ids.append(own.column(2))
                    rows.append(_matrix(own.column(5), own.num_rows))
                    continue
                if held is None and ids:
                    held = pa.concat_arrays(ids), np.vstack(rows)
                if held is None:
                    continue
                at = pc.fill_null(pc.index_in(own.column(2), value_set=held[0]), -1).to_numpy()
                part_of = held[1][at] * own.column(4).to_numpy()[:, None]
                part_of[at < 0] = 0.0
                yield from sums.add(own.column(3), part_of)
        yield from sums.rest()

    out = dense.unionByName(sparse).repartitionById(parts * blocks, "cell") \
        .sortWithinPartitions("cell", "side", "dst").mapInArrow(run, ROW)
    return out if blocks == 1 else sum_rows(out)


def squared_error(a: DataFrame, rows: DataFrame, cols: DataFrame, row: str, col: str,
                  n_rows: int, n_cols: int, width: int) -> tuple[int, float]:
    """(entries, sum of (s - x.y)^2) over the entries of ``a`` (row, col, s) whose row has a
    vector x in ``rows`` and whose column a vector y in ``cols``, both (id, arr of ``width``).

    Entries are dealt into a grid of (row block, column block) cells; a task holds both
    blocks, bounded in bytes, and streams its entries. No entry ever carries a vector."""
    spark = a.sparkSession
    ship_package(spark)
    need = lambda n: max(1, math.ceil(n * width * 8 / BLOCK_BYTES))
    rb, cb = need(n_rows), need(n_cols)
    while rb * cb < 2 * spark.sparkContext.defaultParallelism:  # the cheaper copies first
        rb, cb = (2 * rb, cb) if n_cols * rb <= n_rows * cb else (rb, 2 * cb)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    no = lambda t: F.lit(None).cast(t)

    def side(x: DataFrame, number: int, cells) -> DataFrame:
        return x.select(F.explode(cells).alias("cell"), F.lit(number).alias("side"), F.col("id").alias("r"),
                        no("string").alias("c"), no("double").alias("s"), "arr")

    every = side(rows, 0, F.transform(F.sequence(F.lit(0), F.lit(cb - 1)), lambda j: block("id", rb) * cb + j)) \
        .unionByName(side(cols, 1, F.transform(F.sequence(F.lit(0), F.lit(rb - 1)), lambda i: i * cb + block("id", cb)))) \
        .unionByName(a.select((block(row, rb) * cb + block(col, cb)).alias("cell"), F.lit(2).alias("side"), F.col(row).alias("r"),
                              F.col(col).alias("c"), "s", F.array().cast("array<double>").alias("arr")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, got, held, n, total = None, ([], []), None, 0, 0.0
        for b in batches:
            cell, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(cell) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, b.num_rows]):
                if hi <= lo:
                    continue
                if cell[lo] != now:
                    now, got, held = cell[lo], ([], []), None
                own = b.slice(lo, hi - lo)
                if kind[lo] < 2:
                    got[kind[lo]].append((own.column(2), _matrix(own.column(5), own.num_rows)))
                    continue
                if held is None and got[0] and got[1]:
                    held = [(pa.concat_arrays([i for i, _ in g]), np.vstack([m for _, m in g])) for g in got]
                if held is None:
                    continue
                at = [pc.fill_null(pc.index_in(own.column(j), value_set=ids), -1).to_numpy()
                      for j, (ids, _) in zip((2, 3), held)]
                ok = (at[0] >= 0) & (at[1] >= 0)
                off = own.column(4).to_numpy()[ok] - np.einsum("ij,ij->i", held[0][1][at[0][ok]], held[1][1][at[1][ok]])
                n, total = n + int(ok.sum()), total + float(off @ off)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.float64())], names=["n", "e"])

    got = every.repartitionById(rb * cb, "cell").sortWithinPartitions("cell", "side") \
        .mapInArrow(run, "n long, e double").agg(F.sum("n").alias("n"), F.sum("e").alias("e")).first()
    return int(got["n"] or 0), float(got["e"] or 0.0)


def checkpoint(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _gauss_block(ids: DataFrame, width: int, seed: int) -> DataFrame:
    """Deterministic N(0,1) block: hash-based Box-Muller, reproducible on recompute."""
    two_pi = 2 * math.pi
    u1 = lambda j: (F.pmod(F.xxhash64(F.col("id"), j, F.lit(seed)), F.lit(2 ** 52)) + 1) / F.lit(2.0 ** 52 + 2)
    u2 = lambda j: (F.pmod(F.xxhash64(F.col("id"), j, F.lit(seed + 1)), F.lit(2 ** 52)) + 1) / F.lit(2.0 ** 52 + 2)
    return ids.select("id", F.transform(F.sequence(F.lit(0), F.lit(width - 1)),
                                        lambda j: F.sqrt(-2 * F.log(u1(j))) * F.cos(two_pi * u2(j))).alias("arr"))


def mapped(rows: DataFrame, fn) -> DataFrame:
    """(id, arr) -> (id, fn(matrix of the batch's rows))."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _batch(b.column(0), np.ascontiguousarray(fn(_matrix(b.column(1), b.num_rows))))
    return rows.select("id", "arr").mapInArrow(run, ROW)


def moments(rows: DataFrame, fn) -> np.ndarray:
    """Sum over batches of left' right, where (left, right) = fn(matrix of the batch's
    rows): partials of each task, added up by Spark per row of the result."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for b in batches:
            if b.num_rows:
                left, right = fn(_matrix(b.column(1), b.num_rows))
                total = total + left.T @ right
        if not np.isscalar(total):
            yield _batch([f"{i:06d}" for i in range(len(total))], total)

    out = sum_rows(rows.select("id", "arr").mapInArrow(run, ROW)).orderBy("id").toArrow()
    return _matrix(out["arr"], out.num_rows)


def _whitening(gram: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(M, R) with Y = (Y M) R and Y M orthonormal, for the Gram matrix of Y; directions
    shorter than ``least`` are left out."""
    lam, vec = np.linalg.eigh((gram + gram.T) / 2)
    keep = lam > least * least
    root = np.sqrt(lam[keep])
    return vec[:, keep] / root, root[:, None] * vec[:, keep].T


def truncated_svd(a: DataFrame, row: str, col: str, columns: DataFrame, n_rows: int, n_cols: int, k: int,
                  max_steps: int, seed: int = 42, tolerance: float = TOLERANCE) -> Decomposition:
    """The k largest singular values of ``a`` (row, col, s) and their right vectors, one row
    per id of ``columns``."""
    width = min(n_cols, max(2 * k, 16))
    block = _gauss_block(columns, width, seed)               # the same numbers whenever it is computed
    gram = moments(block, lambda y: (y, y))
    m, _ = _whitening(gram, 1e-8)
    if np.linalg.cond(gram) > 1e7:                           # one whitening left errors: once more
        again, _ = _whitening(moments(block, lambda y: (y @ m, y @ m)), 1e-8)
        m = m @ again
    width = m.shape[1]
    basis = checkpoint(mapped(block, lambda y: y @ m))
    t = np.zeros((0, 0))
    for step in range(1, max_steps + 1):
        n = len(t) + width                                   # columns of the basis
        old = n - width
        t = np.pad(t, (0, width))
        newest = basis.select("id", F.slice("arr", old + 1, width).alias("arr"))
        y = multiply(a, newest, col, row, n_cols, width, n_rows)
        z = multiply(a, y, row, col, n_rows, width, n_cols).withColumnRenamed("arr", "z")
        both = checkpoint(basis.join(z, "id", "left").select(
            "id", F.concat("arr", F.coalesce("z", F.array_repeat(F.lit(0.0), width))).alias("arr")))
        c1 = moments(both, lambda x: (x[:, :n], x[:, n:]))                                  # B'Z
        left = lambda x: x[:, n:] - x[:, :n] @ c1
        g = moments(both, lambda x: (np.hstack([x[:, :n], left(x)]), left(x)))
        c2, s = g[:n], g[n:]
        t[:, old:], t[old:, :] = c1 + c2, (c1 + c2).T
        t = (t + t.T) / 2
        theta, vec = np.linalg.eigh(t)
        theta, vec = np.clip(theta[::-1], 0.0, None), vec[:, ::-1]
        top = max(float(theta[0]), 1e-300)
        m, r = _whitening(s - c2.T @ c2, NOTHING * top)
        share = np.linalg.norm(r @ vec[old:, :k], axis=0) if len(r) else np.zeros(1)
        residual = float(share.max() / top)
        if not len(r) or residual <= tolerance or step == max_steps:
            break
        following = lambda x: (left(x) - x[:, :n] @ c2) @ m
        keep = np.eye(n)
        if n + m.shape[1] > max(BASIS * k, LEAST_BASIS):               # restart from the best Ritz vectors
            keep = vec[:, :min(n, k + width // 2)]
            t = np.diag(theta[:keep.shape[1]])
        basis = checkpoint(mapped(both, lambda x: np.hstack([x[:, :n] @ keep, following(x)])))
        width = m.shape[1]
    found = int(min(k, max(1, (theta > 1e-24 * top).sum())))
    right = vec[:, :found]
    return Decomposition(checkpoint(mapped(both, lambda x: x[:, :n] @ right)), np.sqrt(theta[:found]), residual, step)
