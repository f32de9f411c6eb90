"""N-gram join, nearest neighbours, embedding near-duplicates, components."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from rankfold.llm import ngram_join, pivots, vptree
from rankfold.llm.components import components

SF = "/root/testdata/sf0.001"


def roots(ids, edges):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def plain_join(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = roots(ids, links)
    return {i: (len(sets[i]), root[i]) for i in ids}


def near_copies(seed, families, size, words):
    rng = random.Random(seed)
    out = []
    for f in range(families):
        base = [f"w{rng.randrange(400)}" for _ in range(words)]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randrange(0, max(2, words // 12))):
                t[rng.randrange(len(t))] = f"x{rng.randrange(10 ** 6)}"
            out.append(" ".join(t))
    return out


def check_join(spark, texts):
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, component_id int")
    got = {r[0]: (r[1], r[2]) for r in ngram_join.near_duplicates(df).collect()}
    assert got == plain_join(rows)


def test_join_of_families_that_stars_split(spark):
    check_join(spark, near_copies(1, 3, 40, 60) + near_copies(2, 4, 25, 150) + near_copies(3, 30, 4, 12))


def test_join_edges(spark):
    hot = " ".join(f"p{i}" for i in range(60))
    texts = [None, "", " \n\t", "a", "A a", "a a", "one two three four", "ONE two\tthree  four", "One two three four five",
             "one two three four five", "É b c d e", "é b c d e", *[f"{hot} " + " ".join(f"u{k}_{i}" for i in range(40 + k))
                                                                   for k in range(25)],
             *[f"{hot} tail {k}" for k in range(6)], "long " + " ".join(map(str, range(30000))),
             "long " + " ".join(map(str, range(29900)))]
    check_join(spark, texts)


def test_join_given_table_repeats_and_empty(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(r[0], r[1]) for r in d.collect()]
    got = ngram_join.near_duplicates(d.unionByName(d)).collect()
    assert len(got) == 2 * len(rows) and {r[0]: (r[1], r[2]) for r in got} == plain_join(rows)
    assert ngram_join.near_duplicates(d.limit(0)).count() == 0
    null = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (None, "q")], "doc_id long, text string")
    assert sorted(ngram_join.near_duplicates(null).collect(), key=str) == sorted(
        [(None, 2, 7), (7, 2, 7), (None, 1, None)], key=str)


def test_long_text_hashes_like_a_short_one():
    text = " ".join(f"w{i}" for i in range(5000))
    whole = next(ngram_join.sets_of([text]))
    size, ngram_join.BATCH_BYTES = ngram_join.BATCH_BYTES, 500
    parts = next(ngram_join.sets_of([text]))
    ngram_join.BATCH_BYTES = size
    assert (whole == parts).all() and len(whole) == 4996


def test_components_of_a_chain_and_a_hub(spark):
    n = 200
    edges = [(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (None, 3)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000 + i: 1000 for i in range(300)}


def test_components_of_stars_take_no_round(spark, monkeypatch):
    import rankfold.llm.components as cc
    written, write = [], cc.materialise
    monkeypatch.setattr(cc, "materialise", lambda df, name: written.append(name) or write(df, name))
    stars = [(1, 5), (6, 1), (1, 6), (2, 9), (9, 2), (3, 3), (None, 4)]
    got = components(spark.createDataFrame(stars, "src long, dst long")).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 2), (5, 1), (6, 1), (9, 2)] and len(written) == 1
    path = spark.createDataFrame([(1, 5), (5, 9), (9, 2), (7, 8)], "src long, dst long")
    assert {r[0]: r[1] for r in components(path).collect()} == {1: 1, 5: 1, 9: 1, 2: 1, 7: 7, 8: 7}
    assert components(path.limit(0)).collect() == []


def test_join_merges_found_components_only(spark, monkeypatch):
    edges = []
    monkeypatch.setattr(ngram_join, "components", lambda e: edges.append(e.collect()) or components(e))
    texts = near_copies(1, 3, 40, 60)
    check_join(spark, texts)
    first, second = edges
    root = roots(range(len(texts)), [tuple(e) for e in first])
    assert second and all(root[a] == a and root[b] == b and a != b for a, b in second)


VECTORS = "vec_id long, embedding array<float>, label int, rank string"


def vectors(seed=3, n=400, d=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[100:160] = x[100] + rng.normal(size=(60, d)) * 0.05
    x[200:230] = x[200]
    rows = [(i, [float(np.float32(v)) for v in x[i]], i % 3 if i < 390 else None, "c") for i in range(n)]
    rows += [(n, None, 1, "c"), (n + 1, [], 1, "c"), (n + 2, [0.0] * d, 1, "c"), (n + 3, [float("nan")] + [1.0] * (d - 1), 1, "c"),
             (n + 4, [1.0, 2.0], 1, "c"), (n + 5, [2.0, 4.0], 1, "c"), (n + 6, [float("inf")] * d, 1, "c"), rows[5]]
    return rows


def usable(v):
    return v is not None and len(v) > 0 and all(math.isfinite(a) for a in v) and any(v)


def test_nearest_is_exact_at_factor_one(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS)
    good = {i: np.asarray(v, float) for i, v, _, _ in rows if usable(v)}
    for shard_rows in (64, 1000):
        got = {}
        for r in vptree.search(df, F.col("vec_id") % 20 == 0, 20, factor=1.0, shard_rows=shard_rows).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert set(got) == {i for i in good if i % 20 == 0}
        for q, hits in got.items():
            want = sorted(((-float((good[q] * v).sum()), i) for i, v in good.items() if i != q and len(v) == len(good[q])))[:20]
            assert [(k + 1, i) for k, (_, i) in enumerate(want)] == [(a, b) for a, b, _ in sorted(hits)]
    assert vptree.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_settles_ties_by_id(spark):
    rng = np.random.default_rng(7)
    flat = [(0, [1.0, 0.0], None, 0)] + [(j, [1.0, float(j)], None, 0) for j in range(1, 401)]
    coarse = [(i, [float(x) for x in rng.integers(-2, 3, 6)], None, 0) for i in range(3000)]
    coarse[40] = (40, coarse[41][1], None, 0)
    coarse += [coarse[20], (20, [2.0] * 6, None, 0)]  # a repeated row, an id with two vectors
    for rows in (flat, coarse):
        df = spark.createDataFrame(rows, VECTORS)
        each = sorted({(i, tuple(v)) for i, v, _, _ in rows if usable(v)})
        query = {}
        for i, v in each:
            if i % 20 == 0:
                query.setdefault(i, v)  # the smallest
        ids, m = np.array([i for i, _ in each]), np.array([v for _, v in each])
        for factor in (0.35, 1.0):
            got = {}
            for r in vptree.search(df, F.col("vec_id") % 20 == 0, 20, factor=factor, shard_rows=700).collect():
                got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
            assert set(got) == set(query)
            for i, v in query.items():
                s = m @ np.array(v)
                best = [k for k in np.lexsort((ids, -s)) if ids[k] != i][:20]
                assert [(b, c) for _, b, c in sorted(got[i])] == [(ids[k], s[k]) for k in best]


def test_nearest_recall_of_the_production_factor(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    a = {(r[0], r[2]) for r in vptree.search(df, F.col("vec_id") % 20 == 0).collect()}
    b = {(r[0], r[2]) for r in vptree.search(df, F.col("vec_id") % 20 == 0, factor=1.0).collect()}
    assert len(a & b) >= 0.95 * len(b)


def test_embedding_near_duplicates(spark):
    rows = vectors()
    got = {r["vec_id"]: r for r in pivots.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    good = [(i, np.asarray(v, float), lb) for i, v, lb, _ in rows if usable(v) and lb is not None]
    links = [(i, j) for k, (i, v, a) in enumerate(good) for j, w, b in good[k + 1:]
             if a == b and len(v) == len(w) and (v @ w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98]
    ids = {r[0] for r in rows}
    root = roots(ids, links)
    n = {i: 0 for i in ids}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    for i in ids - {5}:  # 5 is the repeated row
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n[i], root[i], root[i] == i), i
    assert pivots.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_embedding_links_of_a_large_noisy_group_with_many_pivots(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 64))
    x[:1000] = x[0] + rng.normal(size=(1000, 64)) * 0.1
    monkeypatch.setattr(pivots, "LIST_ROWS", 24)  # 1,000 pivots
    df = spark.createDataFrame([(i, v.tolist(), 1, "c") for i, v in enumerate(x)],
                               "vec_id long, embedding array<double>, label int, rank string")
    found = pivots.near_duplicates(df).agg(F.sum("n_links")).first()[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = int((x @ x.T >= 0.98).sum()) - len(x)
    assert true > 100_000 and found >= 0.99 * true, (found, true)


def test_join_of_long_documents_in_two_size_classes(spark):
    rng = random.Random(8)
    texts = []
    for f, (n, changes) in enumerate([(9000, 160), (9000, 125), (9000, 100), (9600, 150), (18000, 320), (18000, 230), (8500, 195)]):
        base = [f"f{f}w{i}" for i in range(n + 4)]
        for c in range(2):
            t = list(base)
            for i in rng.sample(range(3, n, 7), changes * c):
                t[i] = f"f{f}c{c}x{i}"
            texts.append(" ".join(t))
    # one pivot, members on both sides of a class boundary
    base = [f"w{i}" for i in range(9000)]
    for cut, seed, changes in ((9000, 1, 150), (9000, 2, 130), (8150, 2, 130), (8600, 3, 60), (8100, 3, 60)):
        t, r = list(base), random.Random(seed)
        for i in r.sample(range(3, 8000, 7), changes):
            t[i] = f"s{seed}x{i}"
        texts.append(" ".join(t[:cut]))
    check_join(spark, texts)
