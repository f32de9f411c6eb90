"""Collaborative model: SVD products against NumPy, serving rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankfold.operators import collab as K
from rankfold.operators import svd

# own matrix: two groups of users and one row between them
MATRIX = np.array([
    [0.7, 1.0, 0.2, 0.0, 0.6],
    [0.4, 0.9, 0.0, 0.1, 0.8],
    [0.0, 0.1, 1.0, 0.6, 0.0],
    [0.1, 0.0, 0.7, 0.8, 0.3],
    [0.3, 0.6, 0.4, 0.2, 0.5],
])
USERS = [f"user_{i}" for i in range(1, 6)]
ITEMS = [f"item_{i}" for i in range(1, 6)]


@pytest.fixture(scope="module")
def strengths(spark):
    rows = [(u, i, float(MATRIX[a, b])) for a, u in enumerate(USERS) for b, i in enumerate(ITEMS)
            if MATRIX[a, b] != 0]
    return spark.createDataFrame(rows, "user_id string, item_id string, strength double")


@pytest.fixture(scope="module")
def model(strengths):
    return K.train(strengths)


def factors(model):
    uf = {r.user_id: np.array(r.f) for r in model.user_factors.collect()}
    vf = {r.item_id: np.array(r.f) for r in model.item_factors.collect()}
    return uf, vf


def test_products_match_numpy(model):
    k = model.k
    assert k == 4
    u, s, vt = np.linalg.svd(MATRIX)
    want = (u[:, :k] * s[:k]) @ vt[:k]
    uf, vf = factors(model)
    got = np.array([[uf[a] @ vf[b] for b in ITEMS] for a in USERS])
    assert np.abs(got - want).max() < 1e-9
    # item factors orthonormal
    v = np.array([vf[b] for b in ITEMS])
    assert np.abs(v.T @ v - np.eye(k)).max() < 1e-9


def test_metrics_match_numpy(model):
    k = model.k
    u, s, vt = np.linalg.svd(MATRIX)
    rec = (u[:, :k] * s[:k]) @ vt[:k]
    mask = MATRIX > 0
    assert abs(model.info["reconstruction_mse"] - np.mean((MATRIX[mask] - rec[mask]) ** 2)) < 1e-9
    evr = (u[:, :k] * s[:k]).var(axis=0).sum() / MATRIX.var(axis=0).sum()
    assert abs(model.info["explained_variance_ratio"] - evr) < 1e-9
    assert abs(model.global_mean - MATRIX[mask].mean()) < 1e-12
    assert abs(model.info["sparsity"] - (1 - mask.sum() / 25)) < 1e-12


def test_transposed_orientation(spark):
    m = np.array([[1.0, 0.5], [0.2, 0.0], [0.0, 0.9]]).T  # 2 users x 3 items -> items side longer
    rows = [(f"u{a}", f"i{b}", float(m[a, b])) for a in range(2) for b in range(3) if m[a, b]]
    mod = K.train(spark.createDataFrame(rows, "user_id string, item_id string, strength double"))
    u, s, vt = np.linalg.svd(m)
    k = mod.k
    want = (u[:, :k] * s[:k]) @ vt[:k]
    uf, vf = factors(mod)
    got = np.array([[uf[f"u{a}"] @ vf[f"i{b}"] for b in range(3)] for a in range(2)])
    assert np.abs(got - want).max() < 1e-9


def random_matrix(rng, n_rows, n_cols, density):
    """Sparse, with a hot row, a hot column and a slowly falling spectrum."""
    at = np.unique(np.concatenate([rng.integers(0, n_rows * n_cols, int(density * n_rows * n_cols)),
                                   np.arange(n_cols), np.arange(n_rows) * n_cols]))
    return at // n_cols, at % n_cols, rng.random(len(at)) + 0.05


@pytest.mark.parametrize("n_rows, n_cols, k, least", [(400, 90, 50, 256), (300, 260, 8, 80), (150, 700, 6, 256)])
def test_svd_of_every_shape_by_one_method(spark, monkeypatch, n_rows, n_cols, k, least):
    monkeypatch.setattr(svd, "LEAST_BASIS", least)  # the second case is restarted
    a, b, s = random_matrix(np.random.default_rng(n_cols), n_rows, n_cols, 0.05)
    m = np.zeros((n_rows, n_cols))
    m[a, b] = s
    df = spark.createDataFrame([(f"u{x}", f"i{y}", float(z)) for x, y, z in zip(a, b, s)],
                               "user_id string, item_id string, strength double")
    mod = K.train(df, n_factors=k)
    u, sv, vt = np.linalg.svd(m, full_matrices=False)
    assert mod.k == k and np.abs(np.array(mod.info["singular_values"]) - sv[:k]).max() < 1e-8 * sv[0]
    assert mod.info["residual"] < 1e-6
    uf, vf = factors(mod)
    got = np.array([uf[f"u{x}"] for x in range(n_rows)]) @ np.array([vf[f"i{y}"] for y in range(n_cols)]).T
    assert np.abs(got - (u[:, :k] * sv[:k]) @ vt[:k]).max() < 1e-5


def test_product_over_several_blocks(spark, monkeypatch):
    a, b, s = random_matrix(np.random.default_rng(3), 120, 80, 0.1)
    m = np.zeros((120, 80))
    m[a, b] = s
    x = np.random.default_rng(4).normal(size=(80, 3))
    entries = spark.createDataFrame([(f"u{i}", f"i{j}", float(z)) for i, j, z in zip(a, b, s)], "u string, i string, s double")
    dense = spark.createDataFrame([(f"i{j}", v.tolist()) for j, v in enumerate(x) if j != 7], "id string, arr array<double>")
    x[7] = 0
    for size in (svd.BLOCK_BYTES, 400):
        monkeypatch.setattr(svd, "BLOCK_BYTES", size)
        got = {r.id: r.arr for r in svd.multiply(entries, dense, "i", "u", 80, 3).collect()}
        assert len(got) == 120
        assert np.abs(np.array([got[f"u{i}"] for i in range(120)]) - m @ x).max() < 1e-12


def test_invariants_hold(model, strengths):
    rows = {(r.part, r.a, r.b): r.value for r in K.invariants(model, strengths).collect()}
    assert len(rows) == 16 + 12 + 1 + 4
    for (part, a, b), value in rows.items():
        want = (MATRIX ** 2).sum() if part == "sum_squares" else float(part == "orthonormal" and a == b)
        assert abs(value - want) < 1e-9


def test_predict_and_recommend(spark, model):
    pairs = spark.createDataFrame([("user_1", "item_1"), ("nobody", "item_1"), ("user_1", "nothing")],
                                  "user_id string, item_id string")
    pred = {(r.user_id, r.item_id): r.prediction for r in K.predict_rating(model, pairs).collect()}
    assert 0 <= pred[("user_1", "item_1")] <= 1
    assert pred[("nobody", "item_1")] == pytest.approx(model.global_mean)
    assert pred[("user_1", "nothing")] == pytest.approx(model.global_mean)
    users = spark.createDataFrame([("user_1",), ("cold",)], "user_id string")
    excl = spark.createDataFrame([("user_1", "item_1"), ("user_1", "item_2")], "user_id string, item_id string")
    recs = K.recommend(model, users, excl, 2).collect()
    u1 = [r for r in recs if r.user_id == "user_1"]
    assert len(u1) == 2 and not {r.item_id for r in u1} & {"item_1", "item_2"}
    assert all(0 <= r.score <= 1 for r in recs)
    cold = sorted([r for r in recs if r.user_id == "cold"], key=lambda r: r.rank)
    assert len(cold) == 2 and cold[0].score == pytest.approx(1.0)


def test_similar_excludes_self(model):
    for fac, col in ((model.user_factors, "user_id"), (model.item_factors, "item_id")):
        rows = K.similar(fac, col, 3).collect()
        assert rows and all(getattr(r, col) != r.other_id and r.score > 0 for r in rows)


def test_empty_matrix(spark):
    with pytest.raises(ValueError):
        K.train(spark.createDataFrame([], "user_id string, item_id string, strength double"))


def test_cold_users_lose_their_excluded_items(spark, model):
    pop = [r.item_id for r in K.popular_items(model, 5).orderBy("rank").collect()]
    users = spark.createDataFrame([("cold",), ("none",), ("all",)], "user_id string")
    excl = spark.createDataFrame([("cold", pop[0]), ("cold", pop[2]), ("cold", "other")] + [("all", i) for i in pop],
                                 "user_id string, item_id string")
    got = {}
    for r in K.recommend(model, users, excl, 2).orderBy("user_id", "rank").collect():
        got.setdefault(r.user_id, []).append((r.rank, r.item_id, r.score))
    assert [x[:2] for x in got["cold"]] == [(1, pop[1]), (2, pop[3])] and got["cold"][0][2] == pytest.approx(1.0)
    assert [x[:2] for x in got["none"]] == [(1, pop[0]), (2, pop[1])]
    assert "all" not in got


def test_product_grid_sends_few_rows():
    assert svd.blocks_for(54_000, 100, 100, 16) == 16  # a short destination: sums are sent, dense rows once
    assert svd.blocks_for(100, 54_000, 100, 16) == 1   # a short source: its rows are copied
    assert svd.blocks_for(100, None, 100, 16) == 1
    assert svd.blocks_for(10 ** 9, 100, 100, 16) == -(-10 ** 9 * 800 // svd.BLOCK_BYTES)


def test_squared_error_over_a_grid_of_blocks(spark, monkeypatch):
    a, b, s = random_matrix(np.random.default_rng(5), 90, 40, 0.1)
    x, y = np.random.default_rng(6).normal(size=(90, 3)), np.random.default_rng(7).normal(size=(40, 3))
    entries = spark.createDataFrame([(f"u{i}", f"i{j}", float(z)) for i, j, z in zip(a, b, s)], "u string, i string, s double")
    rows = spark.createDataFrame([(f"u{i}", v.tolist()) for i, v in enumerate(x) if i != 4], "id string, arr array<double>")
    cols = spark.createDataFrame([(f"i{j}", v.tolist()) for j, v in enumerate(y) if j != 7], "id string, arr array<double>")
    ok = (a != 4) & (b != 7)
    want = ((s - (x[a] * y[b]).sum(1))[ok] ** 2).sum()
    for size in (svd.BLOCK_BYTES, 500):
        monkeypatch.setattr(svd, "BLOCK_BYTES", size)
        n, e = svd.squared_error(entries, rows, cols, "u", "i", 90, 40, 3)
        assert n == ok.sum() and abs(e - want) < 1e-9
    assert svd.squared_error(entries.limit(0), rows, cols, "u", "i", 90, 40, 3) == (0, 0.0)


def test_norm_is_worked_out_once_a_row(spark):
    """Not for every element: that grows with the square of the vector's length."""
    from rankfold.operators import content as C
    f = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "f array<double>")
    u = f.select(K._unit(F.col("f")).alias("u"))
    assert [r.u for r in u.collect()] == [[0.6, 0.8], None, None]
    raw = spark.createDataFrame([("a", [(1, 3.0), (2, 4.0)]), ("b", [])], "item_id string, f array<struct<fid: bigint, weight: double>>")
    v = C.unit_vectors(raw)
    assert [(r.item_id, r.idx, r.val) for r in v.collect()] == [("a", [1, 2], [0.6, 0.8]), ("b", [], [])]
    for df in (u, v):
        assert "/ SQRT" not in df._jdf.queryExecution().optimizedPlan().toString()
