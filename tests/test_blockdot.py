"""Blocked top-n product vs NumPy brute force: many blocks, ties, exclusions."""

import numpy as np
from pyspark.sql import functions as F

from rankfold.operators.blockdot import grid, pruning, top_n_dot


def brute(qv, cv, qids, cids, k, excl, min_score=None):
    s = qv @ cv.T
    out = {}
    for i, q in enumerate(qids):
        cand = [(-round(s[i, j], 9), c, s[i, j]) for j, c in enumerate(cids)
                if (q, c) not in excl and (min_score is None or round(s[i, j], 9) > min_score)]
        cand.sort(key=lambda t: (t[0], t[1]))
        out[q] = [(c, sc) for _, c, sc in cand[:k]]
    return out


def test_blocked_product_exact(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(-2, 3, size=(40, 6)).astype(float)       # few distinct rows -> many ties
    qv = base[rng.integers(0, 40, 300)]
    cv = base[rng.integers(0, 40, 900)]
    qids = [f"q{i:04d}" for i in range(300)]
    cids = [f"c{i:04d}" for i in range(900)]
    excl = {(qids[i], cids[j]) for i, j in zip(rng.integers(0, 300, 2000), rng.integers(0, 900, 2000))}
    q = spark.createDataFrame([(a, v.tolist()) for a, v in zip(qids, qv)], "qid string, val array<double>")
    c = spark.createDataFrame([(a, v.tolist()) for a, v in zip(cids, cv)], "cid string, val array<double>")
    e = spark.createDataFrame(sorted(excl), "qid string, cid string")
    for k, ms in ((7, None), (15, 0.0)):
        got = top_n_dot(q, c, k, dense=True, exclude=e, min_score=ms, leaf=32, shard_rows=200).collect()
        want = brute(qv, cv, qids, cids, k, excl, ms)
        mine = {}
        for r in sorted(got, key=lambda r: (r.qid, r.rank)):
            mine.setdefault(r.qid, []).append((r.cid, r.score))
        for qid in qids:
            w = want[qid]
            m = mine.get(qid, [])
            assert [x for x, _ in m] == [x for x, _ in w], qid
            assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(m, w))


def sparse_rows(rng, n, prefix, width=400):
    """Rows with common and rare features, some empty, some alike."""
    rows = []
    for i in range(n):
        idx = np.unique(np.concatenate([rng.integers(0, 6, rng.integers(0, 4)), rng.zipf(1.4, rng.integers(0, 12)) % width]))
        rows.append((f"{prefix}{i:04d}", (idx * 7919 - 5).tolist(), rng.integers(1, 5, len(idx)).astype(float).tolist()))
    return rows


def test_sparse_product_exact(spark):
    rng = np.random.default_rng(8)
    qr, cr = sparse_rows(rng, 260, "x"), sparse_rows(rng, 900, "x")
    wide = {f: k for k, f in enumerate(sorted({f for _, idx, _ in qr + cr for f in idx}))}

    def full(rows):
        m = np.zeros((len(rows), len(wide)))
        for i, (_, idx, val) in enumerate(rows):
            m[i, [wide[f] for f in idx]] = val
        return m

    q = spark.createDataFrame(qr, "qid string, idx array<long>, val array<double>")
    c = spark.createDataFrame(cr, "cid string, idx array<long>, val array<double>")
    qids, cids = [r[0] for r in qr], [r[0] for r in cr]
    itself = {(a, a) for a in qids}
    for k, ms, shard_rows in ((5, 0.0, 100), (9, None, 5000)):
        got = top_n_dot(q, c, k, dense=False, exclude_self=True, min_score=ms, leaf=20, shard_rows=shard_rows, cells=6)
        want = brute(full(qr), full(cr), qids, cids, k, itself, ms)
        mine = {}
        for r in sorted(got.collect(), key=lambda r: (r.qid, r.rank)):
            mine.setdefault(r.qid, []).append((r.cid, round(r.score, 9)))
        assert mine == {a: [(x, round(y, 9)) for x, y in w] for a, w in want.items() if w}


def test_k_of_each_query_and_huge_exclusions(spark):
    rng = np.random.default_rng(9)
    cv = rng.normal(size=(2000, 8))
    c = spark.createDataFrame([(f"c{i:04d}", v.tolist()) for i, v in enumerate(cv)], "cid string, val array<double>")
    q = spark.createDataFrame([(f"q{i}", cv[i].tolist(), k) for i, k in enumerate((1, 0, 40, 3))],
                              "qid string, val array<double>, n int")
    e = spark.range(1990).select(F.lit("q3").alias("qid"), F.format_string("c%04d", F.col("id")).alias("cid"))
    got = top_n_dot(q, c, "n", dense=True, exclude=e, leaf=64, shard_rows=300).collect()
    assert {(r.qid, r.rank) for r in got} == {("q0", 1), *(("q2", r + 1) for r in range(40)), *(("q3", r + 1) for r in range(3))}
    s = cv @ cv[3]
    assert [r.cid for r in sorted(got, key=lambda r: r.rank) if r.qid == "q3"] == [
        f"c{i}" for i in sorted(range(1990, 2000), key=lambda i: -s[i])[:3]]


def test_blocks_are_skipped(spark):
    """Factors with falling norms, and unit rows in clusters: most pairs are never scored."""
    rng = np.random.default_rng(10)
    falling = rng.normal(size=(6000, 10)) * np.geomspace(1, 1e-3, 6000)[:, None]
    middle = rng.normal(size=(30, 10))
    near = middle[rng.integers(0, 30, 6000)] + 0.05 * rng.normal(size=(6000, 10))
    for rows in (falling, near / np.linalg.norm(near, axis=1)[:, None]):
        c = spark.createDataFrame([(f"c{i:05d}", v.tolist()) for i, v in enumerate(rows)], "cid string, val array<double>")
        q = c.where("cid < 'c00200'").withColumnRenamed("cid", "qid")
        total = pruning(q, c, 10, dense=True, cells=4).agg(F.sum("pairs"), F.sum("scored")).first()
        assert total[0] == 200 * 6000 and total[1] < 0.5 * total[0]
        got = top_n_dot(q, c, 10, dense=True, cells=4).collect()
        s = rows[:200] @ rows.T
        for r in got:
            assert abs(np.sort(s[int(r.qid[1:])])[-r.rank] - r.score) < 1e-9


def test_grid_follows_the_cluster_not_the_rows():
    assert grid(2_000_000, 2_000_000, 64) == (8, 8)
    assert grid(200_000, 200_000, 64) == (8, 8)
    assert grid(10, 100_000, 64) == (1, 1)
    parts, shards = grid(10_000_000, 1000, 64)
    assert shards == 1 and parts == 64
    parts, shards = grid(100, 10_000_000, 64)
    assert parts == 1 and shards == 64
    assert grid(100, 10_000_000, 8)[1] == 39  # no shard beyond what a task holds


def test_grid_bounds_the_rows_of_a_cell():
    parts, shards = grid(40_000_000, 1000, 64)
    assert shards == 1 and parts == 153           # no part beyond what a task sorts
    assert grid(2_000_000, 2_000_000, 64, k=1000) == (8, 8)
    assert grid(200_000, 200_000, 64, k=1000) == (64, 1)  # long lists: few shards to merge
    assert grid(200_000, 200_000, 64, shard_rows=1 << 16, part_rows=1 << 16) == (8, 8)


def test_sparse_pairs_are_skipped_by_their_sketches(spark):
    """Unit rows of random words, short and long, half their weight in one of two common features: blocks
    cannot be told apart, but few pairs are scored, and the lists are those of all pairs."""
    rng = np.random.default_rng(11)
    n, width = 2400, 6000
    m = np.zeros((n, width))
    for i, size in enumerate(rng.choice([4, 30, 100, 200, 400, 900], n, p=[.1, .3, .3, .15, .1, .05])):
        np.add.at(m[i], 2 + ((width - 2) * rng.random(size) ** 3).astype(int), 1.0 + rng.random(size))
        m[i] /= np.linalg.norm(m[i])
    m[np.arange(n), rng.integers(0, 2, n)] = 1.0
    m /= np.linalg.norm(m, axis=1)[:, None]
    ids = [f"c{i:04d}" for i in range(n)]
    c = spark.createDataFrame([(a, np.flatnonzero(v).tolist(), v[v > 0].tolist()) for a, v in zip(ids, m)],
                              "cid string, idx array<long>, val array<double>")
    q = c.where("cid < 'c0300'").withColumnRenamed("cid", "qid")
    total = pruning(q, c, 10, dense=False, min_score=0.0, cells=2).agg(F.sum("pairs"), F.sum("scored")).first()
    assert total[0] == 300 * n and total[1] < 0.2 * total[0]
    want = brute(m[:300], m, ids[:300], ids, 10, set(), 0.0)
    mine = {}
    for r in sorted(top_n_dot(q, c, 10, dense=False, min_score=0.0, cells=2).collect(), key=lambda r: (r.qid, r.rank)):
        mine.setdefault(r.qid, []).append((r.cid, round(r.score, 9)))
    assert mine == {a: [(x, round(y, 9)) for x, y in w] for a, w in want.items()}
