"""Pruned exact top-n by dot product.

For every query vector, the k candidates with the largest dot product, in the order
(score rounded to 9 places descending, candidate id ascending).

Plan: queries and candidates are dealt into a grid of cells. The number of cells
follows the cluster's parallelism, not the rows; query parts and candidate shards
divide it so that the copies shuffled (candidates x query parts + queries x shards)
and the rows kept are fewest. Only a shard or a part that would not fit a task's memory
(``SHARD_ROWS``, ``PART_ROWS``) makes more of them. One exchange brings the rows of a cell together (``repartitionById``, sorted by
cell, side and k), a task holds its shard as flat arrays and streams the queries past
it, and at most k rows per query leave a cell. A window merges the shards' lists.
No pair of rows is ever a Spark row.

Inside a cell candidates lie in blocks of similar vectors, and a block is skipped for
every query whose bound for the block is below its k-th score so far:

* dense: blocks are bands of similar norm, cut further between far points; by
  Cauchy-Schwarz q.c <= |q| largest norm and q.c <= q.centre + |q| radius, the smaller
  one counts;
* sparse: candidates are sorted by length and heaviest features, and each has a sketch:
  its weights in the heaviest columns and its norms over groups of the others. The product
  of two sketches bounds that of the rows (Cauchy-Schwarz in every group), that with the
  largest parts of a block's sketches bounds the block. Sketches are multiplied as dense
  single floats; only pairs whose bound reaches the k-th score are scored.

Blocks with the largest bounds come first, so the k-th scores rise early. The bounds
are exact, hence so is the result; ``pruning`` reports the share of pairs skipped.

Vectors are dense (``val`` array<double>) or sparse (parallel ``idx`` array<bigint>,
``val`` array<double>, an index at most once a row).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankfold import fixed
from rankfold.session import ship_package

OUT_SCHEMA = "qid string, cid string, score double, key double, rank int, k long, kb long"
STAT_SCHEMA = "cell int, queries long, candidates long, pairs long, scored long"
#: candidates that a task may hold, queries that it may sort; fewer of sparse ones, whose
#: rows are longer
SHARD_ROWS, PART_ROWS = 1 << 18, 1 << 18
SPARSE_ROWS = 1 << 16
#: kept rows that cost as much to send as one query row
KEPT_ROWS = 12
#: rows of a block (more of sparse ones, whose bounds cost more), queries compared at once,
#: kept entries of those queries at most
LEAF, QUERY_ROWS, QUERY_ENTRIES = 128, 1024, 1 << 21
SPARSE_LEAF, SPARSE_QUERIES = 512, 512
#: entries of a sparse row up to which its sketch has the places below (longer ones the last);
#: entries of a shard's sketches at most; places after which blocks are also bounded by norms;
#: what single floats may lose of a product
LENGTHS, WIDTHS = (128, 256, 512), (640, 1024, 1792, 5120)
ENTRIES = 1 << 26
PLACES = (0, 3, 6, 12, 32, 128)
ROUNDING = 4e-4
#: scoring single pairs: entries of a piece of a row, pieces at once, entries of the queries
#: laid out at most; share of a block beyond which a query is scored against all of it
PIECE, PIECES, WIDE = 32, 1 << 12, 1 << 23
FULL = 0.3
#: pairs that are scored first, of each query and as a multiple of k, at most one of a group
#: of candidates; candidates after which that is done for the first time (then after 8 times
#: as many, and so on)
SEEDS, GROUP, AHEAD = 3, 64, 1 << 11
#: pairs that are worth a cell of their own
CELL_PAIRS = 1 << 21
#: a rounded score can exceed the raw one by half a unit of the last place
SLACK = 1e-9


class Rows:
    """Row vectors as flat arrays; dense ones all have the same length."""

    def __init__(self, val: np.ndarray, idx: np.ndarray | None, start: np.ndarray):
        self.val, self.idx, self.start = val, idx, start

    def __len__(self) -> int:
        return len(self.start) - 1

    @property
    def matrix(self) -> np.ndarray:
        return self.val.reshape(len(self), -1) if len(self) else self.val.reshape(0, 0)

    def norms(self) -> np.ndarray:
        return np.sqrt(np.bincount(self.row_of(), self.val * self.val, len(self)))

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.start))

    def heaviest(self) -> np.ndarray:
        """The three heaviest features of each row."""
        by = np.lexsort((self.idx, -np.abs(self.val), self.row_of()))
        first, size = np.zeros((3, len(self)), np.int64), np.diff(self.start)
        for k in range(3):
            has = size > k
            first[k, has] = self.idx[by[self.start[:-1][has] + k]]
        return first

    def take(self, rows: np.ndarray) -> Rows:
        if self.idx is None:
            m = self.matrix[rows]
            return Rows(m.ravel(), None, np.arange(len(rows) + 1) * m.shape[1])
        size = np.diff(self.start)[rows]
        start = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(start[-1]) + np.repeat(self.start[:-1][rows] - start[:-1], size)
        return Rows(self.val[at], self.idx[at], start)


def _flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    return values, offsets - offsets[0]


def _rows(table: pa.Table, dense: bool) -> Rows:
    val, start = _flat(table["val"])
    return Rows(np.asarray(val, np.float64), None if dense else np.asarray(_flat(table["idx"])[0], np.int64),
                start.astype(np.int64))


class DenseShard:
    def __init__(self, rows: Rows, leaf: int):
        x = rows.matrix
        self.order, cuts = self._split(x, leaf)
        self.x = x[self.order]
        self.cuts = np.array(cuts)
        pairs = list(zip(cuts, cuts[1:]))
        self.centre = np.array([self.x[a:b].mean(0) for a, b in pairs]).reshape(len(pairs), -1)
        self.radius = np.array([np.sqrt(((self.x[a:b] - c) ** 2).sum(1).max()) for (a, b), c in zip(pairs, self.centre)])
        self.norm = np.array([np.sqrt((self.x[a:b] ** 2).sum(1).max()) for a, b in pairs])

    @staticmethod
    def _split(x: np.ndarray, leaf: int) -> tuple[np.ndarray, list[int]]:
        """Bands of similar norm, each cut along the line between two far points, down to
        ``leaf`` rows: in the middle of that line, or at the median if that leaves a small
        side."""
        band = np.floor(2 * np.log2(np.sqrt((x * x).sum(1)) + 1e-100))
        order, cuts = np.argsort(-band, kind="stable"), [0]
        edges = [0, *(np.flatnonzero(np.diff(band[order])) + 1).tolist(), len(x)]
        todo = list(zip(edges, edges[1:]))
        while todo:
            a, b = todo.pop()
            if b - a <= leaf:
                cuts.append(b)
                continue
            own = order[a:b]
            y = x[own]
            one = y[((y - y.mean(0)) ** 2).sum(1).argmax()]
            two = y[((y - one) ** 2).sum(1).argmax()]
            along = y @ (two - one)
            by = np.argsort(along, kind="stable")
            mid = int(np.searchsorted(along[by], (one + two) @ (two - one) / 2))
            mid = mid if 8 * min(mid, b - a - mid) >= b - a else (b - a) // 2
            order[a:b] = own[by]
            todo += [(a, a + mid), (a + mid, b)]
        return order, sorted(cuts)

    def prepare(self, q: Rows) -> tuple[np.ndarray, np.ndarray]:
        m = q.matrix
        size = np.sqrt((m * m).sum(1))[:, None]
        return m, np.minimum(m @ self.centre.T + size * self.radius, size * self.norm) + 1e-12 * size * self.norm

    def search(self, best: Best, q: np.ndarray, bound: np.ndarray, own: np.ndarray | None) -> int:
        """Offers every pair that may count; the number of pairs that were scored."""
        done = 0
        for j in np.argsort(-bound.max(0), kind="stable"):
            a, b = int(self.cuts[j]), int(self.cuts[j + 1])
            rows = np.flatnonzero(bound[:, j] >= best.floor - SLACK)
            if not len(rows):
                continue
            s = (q if len(rows) == len(q) else q[rows]) @ self.x[a:b].T
            if own is not None:
                hit = np.flatnonzero((own[rows] >= a) & (own[rows] < b))
                s[hit, own[rows[hit]] - a] = -np.inf
            best.offer(rows, s, a)
            done += s.size
        return done


class Sketch:
    """Short dense forms of sparse rows: the values in the columns of most weight, and norms
    over groups of the other columns. By Cauchy-Schwarz in every group the product of two
    sketches is no less than that of the rows. They are single floats of rows over a norm;
    ``ROUNDING`` covers what that loses."""

    def __init__(self, by: np.ndarray, width: int):
        """``by``: the columns by falling weight."""
        self.width = min(len(by), width)
        self.alone = len(by) if len(by) <= width else width * 3 // 8
        at = np.arange(len(by))
        self.place = np.empty(len(by), np.int64)
        self.place[by] = np.where(at < self.alone, at, self.alone + (at - self.alone) % max(1, width - self.alone))

    def of(self, start: np.ndarray, col: np.ndarray, val: np.ndarray, over: np.ndarray) -> np.ndarray:
        out = np.zeros((len(over), self.width), np.float32)
        step = max(1, (1 << 21) // max(1, self.width))
        for a in range(0, len(over), step):
            b = min(len(over), a + step)
            lo, hi = start[a], start[b]
            row, place = np.repeat(np.arange(b - a), np.diff(start[a:b + 1])), self.place[col[lo:hi]]
            at, x = row * self.width + place, val[lo:hi] / over[a:b][row]
            one = place < self.alone
            part = out[a:b].reshape(-1)
            part[:] = np.sqrt(np.bincount(at[~one], x[~one] ** 2, part.size))
            part[at[one]] = x[one]
        return out

    @staticmethod
    def beyond(sketch: np.ndarray) -> np.ndarray:
        """Norms of the sketches without their first places, for each of ``PLACES``."""
        return np.sqrt(np.array([np.einsum("ij,ij->i", x, x) for x in (sketch[:, p:] for p in PLACES)])).T


class SparseShard:
    """Candidates as rows over the columns that the shard has, short rows first, and their
    sketches (longer ones for longer rows). Only pairs whose sketches reach the k-th score
    are scored."""

    def __init__(self, rows: Rows, leaf: int):
        kind = np.searchsorted(LENGTHS, np.diff(rows.start))
        self.order = np.lexsort((*rows.heaviest()[::-1], kind))
        self.rows = rows.take(self.order)
        kind, n = kind[self.order], len(rows)
        self.columns, col = np.unique(self.rows.idx, return_inverse=True)
        self.col, self.rows.idx = col.astype(np.int32), None
        edges = np.searchsorted(kind, np.arange(len(WIDTHS) + 1))
        self.cuts = np.array(sorted({0, n, *(x for a, b in zip(edges, edges[1:]) for x in range(a, b, leaf))}))
        # columns by falling weight; of the first, those with the largest single weights lead
        square = self.rows.val * self.rows.val
        by = np.argsort(-np.bincount(self.col, square, len(self.columns)), kind="stable")
        lead = by[:PLACES[-1]]
        by[:PLACES[-1]] = lead[np.argsort(-np.bincount(self.col, square * square, len(self.columns))[lead], kind="stable")]
        norm = self.rows.norms()
        self.norm = float(max(norm[np.isfinite(norm)].max(initial=0.0), 1e-150))
        widths = [min(w, len(by)) for w in WIDTHS]
        while sum(w * x for w, x in zip(widths, np.diff(edges).tolist())) > ENTRIES and max(widths) > PLACES[-1]:
            most = max(w for w, x in zip(widths, np.diff(edges)) if x)
            widths = [min(w, max(most // 2, PLACES[-1])) for w in widths]
        # rows of one kind: first and last row, sketch of their columns, sketches; of a block:
        # the largest part in each place, the largest norms of what lies beyond the first places
        self.kinds = []
        for a, b, width in zip(edges.tolist(), edges[1:].tolist(), widths):
            if a == b:
                continue
            s = Sketch(by, width)
            x = s.of(self.rows.start[a:b + 1], self.col, self.rows.val, np.full(b - a, self.norm))
            at = self.cuts[(self.cuts >= a) & (self.cuts < b)] - a
            self.kinds.append((a, b, s, x, np.fmax.reduceat(np.abs(x), at), np.fmax.reduceat(s.beyond(x), at)))
        # the rows cut into pieces of one length, for scoring single pairs
        size = np.diff(self.rows.start)
        self.pieces = np.maximum(1, -(-size // PIECE))
        self.piece = np.cumsum(self.pieces) - self.pieces
        at = np.arange(len(self.col)) + np.repeat(self.piece * PIECE - self.rows.start[:-1], size)
        self.piece_col = np.zeros((int(self.pieces.sum()), PIECE), np.int32)
        self.piece_val = np.zeros(self.piece_col.shape)
        self.piece_col.ravel()[at] = self.col
        self.piece_val.ravel()[at] = self.rows.val

    def prepare(self, q: Rows) -> tuple[tuple, np.ndarray]:
        """Queries over the shard's columns, and bounds: of the first places by the largest
        parts in a block, of the rest by norms; the smallest one counts."""
        at = np.searchsorted(self.columns, q.idx)
        at[at == len(self.columns)] = 0
        known = self.columns[at] == q.idx if len(self.columns) else np.zeros(len(q.idx), bool)
        row, col, val = q.row_of()[known], at[known], q.val[known]
        start = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(q)))])
        norm = np.sqrt(np.bincount(row, val * val, len(q)))
        norm = np.where(norm > 0, norm, 1.0)
        sketches, bounds = [], []
        for *_, s, _, most, rest in self.kinds:
            x = s.of(start, col, val, norm)
            beyond, size = s.beyond(x), np.abs(x)
            bound = size @ most.T
            for k, p in enumerate(PLACES):
                bound = np.minimum(bound, size[:, :p] @ most[:, :p].T + beyond[:, k:k + 1] * rest[:, k])
            sketches.append(x)
            bounds.append(bound)
        scale = norm * self.norm
        # the queries side by side: single pairs are scored from them, if there is room over
        # all columns or else over the queries' own
        wide = where = None
        if len(q) * len(self.columns) > WIDE:
            own = np.unique(col)
            where = np.full(len(self.columns), len(own), np.int32)
            where[own] = np.arange(len(own), dtype=np.int32)
        size = max(1, len(self.columns)) if where is None else len(own) + 1
        if len(q) * size <= WIDE:
            wide = np.zeros((len(q), size)), where
            wide[0][row, col if where is None else where[col]] = val
        return (start, col, val, sketches, scale, wide), (np.concatenate(bounds, 1) + ROUNDING) * scale[:, None]

    def search(self, best: Best, q: tuple, bound: np.ndarray, own: np.ndarray | None) -> int:
        """Offers every pair that may count; the number of pairs that were scored."""
        scale, wide = q[4:]
        n, blocks = len(self.order), list(zip(self.cuts, self.cuts[1:]))
        order = np.argsort(-bound.max(0), kind="stable")
        most = np.full((len(scale), -(-n // GROUP) * GROUP), -np.inf, np.float32)  # sketch products
        done, ahead, due = 0, 0, AHEAD
        for j in order:
            a, b = blocks[j]
            rows = np.flatnonzero(bound[:, j] >= best.floor - SLACK)
            if len(rows):
                most[rows, a:b] = self._products(q, rows, a, b, own)
            ahead += b - a
            if ahead >= due:  # k-th scores that many other blocks cannot reach
                done, due = done + self._seed(best, wide, most), 8 * due
        done += self._seed(best, wide, most)
        for j in order:
            a, b = blocks[j]
            rows = np.flatnonzero(bound[:, j] >= best.floor - SLACK)
            ok = most[rows, a:b] >= ((best.floor[rows] - SLACK) / scale[rows] - ROUNDING)[:, None].astype(np.float32)
            full = ok.sum(1) > (FULL * (b - a) if wide else 0)
            if full.any():
                best.offer(rows[full], self._without(self.scores(q, rows[full], a, b), own, rows[full], a, b), a)
                done += int(full.sum()) * (b - a)
                ok[full] = False
            r, c = np.nonzero(ok)
            if len(r):
                best.take(rows[r], c + a, self._pairs(wide, rows[r], c + a))
            done += len(r)
        return done

    def _products(self, q: tuple, rows: np.ndarray, a: int, b: int, own: np.ndarray | None) -> np.ndarray:
        k = next(i for i, kind in enumerate(self.kinds) if a < kind[1])
        first, sketches = self.kinds[k][0], self.kinds[k][3]
        x = q[3][k] if len(rows) == len(q[3][k]) else q[3][k][rows]
        return self._without(x @ sketches[a - first:b - first].T, own, rows, a, b)

    def _seed(self, best: Best, wide: tuple | None, most: np.ndarray) -> int:
        """Scores the largest sketch products, one of a group of candidates, for k-th scores to
        begin with; the pairs are not offered."""
        top = SEEDS * int(best.k.max())
        if wide is None or 2 * top > most.shape[1] // GROUP:
            return 0
        by = most.reshape(len(most), -1, GROUP)
        largest = by.max(2)
        g = np.argpartition(largest, largest.shape[1] - top, axis=1)[:, -top:]
        r = np.repeat(np.arange(len(most)), top)
        c = by[r, g.ravel()].argmax(1) + g.ravel() * GROUP
        ok = np.isfinite(most[r, c])
        s = np.full(len(r), -np.inf)
        s[ok] = self._pairs(wide, r[ok], c[ok])
        s[~np.isfinite(s)] = -np.inf
        kth = np.sort(s.reshape(-1, top), axis=1)[np.arange(len(most)), top - best.k]
        best.floor = np.maximum(best.floor, kth)
        return int(ok.sum())

    @staticmethod
    def _without(s: np.ndarray, own: np.ndarray | None, rows: np.ndarray, a: int, b: int) -> np.ndarray:
        if own is not None:
            hit = np.flatnonzero((own[rows] >= a) & (own[rows] < b))
            s[hit, own[rows[hit]] - a] = -np.inf
        return s

    def _pairs(self, wide: tuple, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Products of single pairs of a query and a candidate."""
        x, where = wide
        out = np.empty(len(r))
        cut = np.concatenate([[0], np.cumsum(self.pieces[c])])
        i = 0
        while i < len(r):
            j = max(i + 1, int(np.searchsorted(cut, cut[i] + PIECES, "right")) - 1)
            n = self.pieces[c[i:j]]
            first = cut[i:j] - cut[i]
            at = np.arange(cut[j] - cut[i]) + np.repeat(self.piece[c[i:j]] - first, n)
            cell = np.take(self.piece_col, at, axis=0)
            cell = (cell if where is None else np.take(where, cell)) + np.repeat(r[i:j] * x.shape[1], n)[:, None]
            got = np.einsum("ij,ij->i", np.take(x, cell), np.take(self.piece_val, at, axis=0))
            out[i:j] = np.add.reduceat(got, first)
            i = j
        return out

    def scores(self, q: tuple, rows: np.ndarray, a: int, b: int) -> np.ndarray:
        start, col, val = q[:3]
        if len(rows) < len(start) - 1:
            size = np.diff(start)[rows]
            cut = np.concatenate([[0], np.cumsum(size)])
            at = np.arange(cut[-1]) + np.repeat(start[:-1][rows] - cut[:-1], size)
            start, col, val = cut, col[at], val[at]
        lo, hi = self.rows.start[a], self.rows.start[b]
        own = np.repeat(np.arange(b - a), np.diff(self.rows.start[a:b + 1]))
        return product((start, col, val), own, self.col[lo:hi], self.rows.val[lo:hi], b - a, len(self.columns))


def product(q: tuple, row: np.ndarray, col: np.ndarray, val: np.ndarray, n: int, width: int) -> np.ndarray:
    """Queries (starts, columns, values) times n sparse rows (row, col, val). Columns that
    many queries have go through a dense product, the others pair by pair."""
    start, qcol, qval = q
    m = len(start) - 1
    qrow = np.repeat(np.arange(m), np.diff(start))
    nq, nc = np.bincount(qcol, minlength=width), np.bincount(col, minlength=width)
    # measured: a pair costs about as much as 40 multiply-adds of the dense product
    common = np.flatnonzero(40 * nq * nc > m * n)
    out = np.zeros((m, n))
    place = np.full(width, -1)
    place[common] = np.arange(len(common))
    if len(common):
        qd, cd = np.zeros((m, len(common))), np.zeros((n, len(common)))
        x, y = place[qcol] >= 0, place[col] >= 0
        qd[qrow[x], place[qcol[x]]] = qval[x]
        cd[row[y], place[col[y]]] = val[y]
        out = qd @ cd.T
    rare = (place < 0) & (nq > 0) & (nc > 0)
    y = rare[col]
    if y.any():
        by = np.argsort(qcol, kind="stable")
        first = np.concatenate([[0], np.cumsum(nq)])
        times = nq[col[y]]
        cut = np.concatenate([[0], np.cumsum(times)])
        at = by[np.arange(cut[-1]) + np.repeat(first[col[y]] - cut[:-1], times)]
        flat = qrow[at] * n + np.repeat(row[y], times)
        out += np.bincount(flat, qval[at] * np.repeat(val[y], times), m * n).reshape(m, n)
    return out


class Best:
    """The best entries of some queries so far, and the key below which nothing counts."""

    def __init__(self, k: np.ndarray, place: np.ndarray, min_score: float | None):
        self.k, self.place, self.min_score = k, place, min_score
        self.floor = np.full(len(k), -np.inf if min_score is None else min_score + 1.5 * SLACK)
        self.kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.pending: list[tuple] = []

    def offer(self, rows: np.ndarray, s: np.ndarray, a: int) -> None:
        """Scores of the queries ``rows`` against the candidates from ``a`` on."""
        ok = s >= (self.floor[rows] - SLACK)[:, None]
        many = np.flatnonzero(ok.sum(1) > 2 * self.k[rows])
        if len(many):  # the block alone has k better ones
            k = int(self.k[rows[many]].max())
            if k < s.shape[1]:
                kth = np.partition(s[many], s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                self.floor[rows[many]] = np.maximum(self.floor[rows[many]], kth)
                ok[many] = s[many] >= (self.floor[rows[many]] - SLACK)[:, None]
        r, c = np.nonzero(ok)
        self.take(rows[r], c + a, s[r, c])

    def take(self, row: np.ndarray, col: np.ndarray, s: np.ndarray) -> None:
        """Scores of pairs of a query and a candidate."""
        ok = (s >= self.floor[row] - SLACK) & np.isfinite(s)
        if ok.any():
            self.pending.append((row[ok], col[ok], s[ok]))
            if sum(len(p[0]) for p in self.pending) > max(4096, int(self.k.sum())):
                self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate, score, key, position) of the best entries, in order."""
        row, col, score = (np.concatenate(x) for x in zip(self.kept, *self.pending))
        self.pending = []
        key = np.round(score, fixed.RANK_PLACES)
        if self.min_score is not None:
            ok = key > self.min_score
            row, col, score, key = row[ok], col[ok], score[ok], key[ok]
        o = np.lexsort((self.place[col], -key, row))
        row, col, score, key = row[o], col[o], score[o], key[o]
        pos = np.arange(len(row)) - np.searchsorted(row, np.arange(len(self.k)))[row]
        ok = pos < self.k[row]
        row, col, score, key, pos = row[ok], col[ok], score[ok], key[ok], pos[ok]
        full = pos == self.k[row] - 1
        self.floor[row[full]] = np.maximum(self.floor[row[full]], key[full])
        self.kept = (row, col, score)
        return row, col, score, key, pos


class Cell:
    """The shard of one cell, and the queries that pass it."""

    def __init__(self, table: pa.Table, dense: bool, exclude_self: bool, min_score: float | None, leaf: int):
        self.dense, self.min_score = dense, min_score
        rows = _rows(table, dense)
        self.shard = (DenseShard if dense else SparseShard)(rows, leaf)
        self.ids = table["id"].combine_chunks().take(pa.array(self.shard.order))
        plain = self.ids.to_numpy(zero_copy_only=False)
        self.place = np.empty(len(plain), np.int64)
        self.place[np.argsort(plain, kind="stable")] = np.arange(len(plain))
        self.at = {x: i for i, x in enumerate(plain)} if exclude_self else {}
        self.queries = self.pairs = self.scored = 0

    def search(self, table: pa.Table) -> pa.RecordBatch:
        k = table["k"].to_numpy().astype(np.int64)
        q, bound = self.shard.prepare(_rows(table, self.dense))
        best = Best(k, self.place, self.min_score)
        own = np.array([self.at.get(x, -1) for x in table["id"].to_pylist()]) if self.at else None
        if len(k):
            self.scored += self.shard.search(best, q, bound, own)
        self.queries += len(k)
        self.pairs += len(k) * len(self.ids)
        row, col, score, key, pos = best.settle()
        take = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [table["id"].combine_chunks().take(take), self.ids.take(pa.array(col)), pa.array(score), pa.array(key),
             pa.array((pos + 1).astype(np.int32)), table["k"].combine_chunks().take(take),
             table["kb"].combine_chunks().take(take)], names=["qid", "cid", "score", "key", "rank", "k", "kb"])


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.Table]]:
    """Consecutive rows of one (cell, side)."""
    cell, side = batch.column("cell").to_numpy(), batch.column("side").to_numpy()
    edges = np.flatnonzero((np.diff(cell) != 0) | (np.diff(side) != 0)) + 1
    for a, b in zip([0, *edges], [*edges, batch.num_rows]):
        if b > a:
            yield int(cell[a]), int(side[a]), pa.Table.from_batches([batch.slice(a, b - a)])


def _portions(table: pa.Table, dense: bool) -> Iterator[pa.Table]:
    """Queries in portions whose kept entries stay within bounds (sorted by k); sparse ones
    of like features together."""
    if not dense:
        table = table.take(pa.array(np.lexsort((*_rows(table, dense).heaviest()[::-1], table["k"].to_numpy()))))
    a, k = 0, table["k"].to_numpy()
    while a < len(k):
        b = min(len(k), a + (QUERY_ROWS if dense else SPARSE_QUERIES))
        while b > a + 1 and int(k[b - 1]) * (b - a) > QUERY_ENTRIES:
            b = a + max(1, (b - a) // 2)
        yield table.slice(a, b - a)
        a = b


def _task(dense: bool, exclude_self: bool, min_score: float | None, leaf: int | None, report: bool):
    leaf = leaf or (LEAF if dense else SPARSE_LEAF)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, waiting, cell = None, [], None

        def stats(number: int, c: Cell) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int32())] + [pa.array([x], pa.int64()) for x in
                                                    (c.queries, len(c.ids), c.pairs, c.scored)],
                names=["cell", "queries", "candidates", "pairs", "scored"])

        for batch in batches:
            for number, side, rows in _runs(batch):
                if number != now:
                    if report and cell is not None:
                        yield stats(now, cell)
                    now, waiting, cell = number, [], None
                if side == 0:
                    waiting.append(rows)
                    continue
                if cell is None and waiting:
                    cell = Cell(pa.concat_tables(waiting), dense, exclude_self, min_score, leaf)
                    waiting = []
                if cell is not None:
                    for portion in _portions(rows, dense):
                        found = cell.search(portion)
                        if not report:
                            yield found
        if report and cell is not None:
            yield stats(now, cell)

    return run


def grid(n_queries: int, n_cands: int, cells: int, shard_rows: int = SHARD_ROWS, k: float = 0,
         part_rows: int = PART_ROWS) -> tuple[int, int]:
    """(query parts, candidate shards): about ``cells`` together, fewest rows shuffled, with
    k rows of a query kept in each shard; none holds more rows than it may."""
    cells = max(1, min(cells, math.ceil(n_queries * n_cands / CELL_PAIRS)))
    shards = min(cells, max(1, round(math.sqrt(cells * n_cands / (n_queries * (1 + k / KEPT_ROWS))))))
    shards = max(shards, math.ceil(n_cands / shard_rows))
    return max(1, min(cells // shards, n_queries), math.ceil(n_queries / part_rows)), shards


def _cells(queries: DataFrame, cands: DataFrame, n: int | str, dense: bool, exclude: DataFrame | None,
           cells: int | None, n_cands: int | None, shard_rows: int | None):
    """The rows of all cells, dealt and sorted; the number of shards; the exclusions."""
    spark = queries.sparkSession
    ship_package(spark)
    vec = ["val"] if dense else ["idx", "val"]
    k_col = F.col(n) if isinstance(n, str) else F.lit(int(n))
    # fresh aliases: queries and candidates are often the same table (self product)
    q = queries.select(F.col("qid").alias("id"), *[F.col(v).alias(v) for v in vec],
                       k_col.cast("long").alias("kb")).where(F.col("kb") > 0)
    c = cands.select(F.col("cid").alias("id"), *[F.col(v).alias(v) for v in vec])
    # only the row counts are needed: vector columns are never built for them
    asked = q.agg(F.count(F.lit(1)).alias("n"), F.avg("kb").alias("k")).first()
    nq = asked["n"]
    nc = n_cands if n_cands is not None else c.select("id").count()
    if nq == 0 or nc == 0:
        return None, 0, None
    rows = SHARD_ROWS if dense else SPARSE_ROWS
    parts, shards = grid(nq, nc, cells or 2 * spark.sparkContext.defaultParallelism, shard_rows or rows, asked["k"],
                         PART_ROWS if dense else SPARSE_ROWS)
    shard_of = lambda x: F.pmod(F.xxhash64(x), F.lit(shards)).cast("int")
    qx = q.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")) \
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    ex = None
    if exclude is not None:
        ex = exclude.select(F.col("qid").alias("qid"), F.col("cid").alias("cid")).distinct()
        # a cell fetches as many more as it holds excluded pairs of the query
        more = ex.groupBy(F.col("qid").alias("id"), shard_of("cid").alias("shard")).agg(F.count(F.lit(1)).alias("more"))
        qx = qx.join(more, ["id", "shard"], "left").withColumn("k", F.col("kb") + F.coalesce("more", F.lit(0)))
    else:
        qx = qx.withColumn("k", F.col("kb"))
    cx = c.withColumn("shard", shard_of("id")) \
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    at = (F.col("part") * shards + F.col("shard")).alias("cell")
    zero = F.lit(0).cast("long")
    both = cx.select(at, F.lit(0).alias("side"), "id", *vec, zero.alias("k"), zero.alias("kb")) \
        .unionByName(qx.select(at, F.lit(1).alias("side"), "id", *vec, "k", "kb"))
    return both.repartitionById(parts * shards, "cell").sortWithinPartitions("cell", "side", "k"), shards, ex


def top_n_dot(queries: DataFrame, cands: DataFrame, n: int | str, *,
              dense: bool, exclude_self: bool = False, min_score: float | None = None,
              exclude: DataFrame | None = None, cells: int | None = None,
              n_cands: int | None = None, leaf: int | None = None, shard_rows: int | None = None) -> DataFrame:
    """Top-k candidates per query by dot product.

    queries: columns qid, and val (dense) or idx, val (sparse); optional k column.
    cands:   columns cid, and the same vector columns.
    n:       k for every query, or the name of a per-query k column.
    n_cands: the candidate row count when the caller knows it (saves a job).
    cells:   size of the grid (default: twice the parallelism).
    exclude: optional (qid, cid) pairs that must not be returned. Each
             (query, shard) cell over-fetches by the number of its excluded
             pairs that fall in that shard (a small aggregate joined to the
             query rows), and the pairs are anti-joined afterwards, so the
             result is exact without shipping exclusion lists anywhere.
    Returns (qid, cid, score, rank) with rank 1..k.
    """
    dealt, shards, ex = _cells(queries, cands, n, dense, exclude, cells, n_cands, shard_rows)
    if dealt is None:
        return queries.sparkSession.createDataFrame([], "qid string, cid string, score double, rank int")
    found = dealt.mapInArrow(_task(dense, exclude_self, min_score, leaf, False), OUT_SCHEMA)
    if shards == 1 and ex is None:
        # one shard: each query's list is already global and ranked
        return found.drop("k", "kb", "key")
    if ex is not None:
        found = found.join(ex, ["qid", "cid"], "left_anti")
    # merge the shards' lists on the same (rounded key desc, id asc) order
    w = Window.partitionBy("qid").orderBy(F.col("key").desc(), F.col("cid"))
    return (found.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= F.col("kb")).drop("k", "kb", "key"))


def pruning(queries: DataFrame, cands: DataFrame, n: int | str, *, dense: bool, exclude_self: bool = False,
            min_score: float | None = None, exclude: DataFrame | None = None, cells: int | None = None,
            leaf: int | None = None, shard_rows: int | None = None) -> DataFrame:
    """What ``top_n_dot`` does for the same arguments: (cell, queries, candidates, pairs,
    scored), one row a cell; ``pairs - scored`` were skipped by a bound."""
    dealt, _, _ = _cells(queries, cands, n, dense, exclude, cells, None, shard_rows)
    if dealt is None:
        return queries.sparkSession.createDataFrame([], STAT_SCHEMA)
    return dealt.mapInArrow(_task(dense, exclude_self, min_score, leaf, True), STAT_SCHEMA)
