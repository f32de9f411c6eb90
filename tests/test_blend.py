"""Blending rules on hand-made candidate tables and the trained fixture models."""

import pytest
from pyspark.sql import functions as F

from rankfold import fixed
from rankfold.operators import blend as B
from rankfold.operators import collab as K
from rankfold.operators import content as C
from rankfold.operators import strength
from rankfold.plans import q_blend


@pytest.fixture()
def models(spark, fix_items, fix_interactions):
    cm = C.train(fix_items)
    km = K.train(strength.strength_fold(fix_interactions))
    return cm, km


def test_hybrid_weights_and_labels(spark, models, fix_interactions, monkeypatch):
    cm, km = models
    content = spark.createDataFrame([("u", 1, "a", 0.5), ("u", 2, "b", 0.4)],
                                    "user_id string, rank int, item_id string, score double")
    collab = spark.createDataFrame([("u", 1, "b", 1.0), ("u", 2, "c", 0.25)],
                                   "user_id string, rank int, item_id string, score double")
    monkeypatch.setattr(B, "content_leg", lambda *a, **k: content)
    monkeypatch.setattr(B, "collab_leg", lambda *a, **k: collab)
    users = spark.createDataFrame([("u",)], "user_id string")
    few = spark.createDataFrame([("u", "x", 4)], "user_id string, item_id string, n_likes long")
    got = {r.item_id: (r.score, r.explanation) for r in B.recommend_hybrid(cm, km, users, few, None, 10).collect()}
    assert got["a"] == (pytest.approx(0.8 * 0.5), fixed.EXPLAIN_CONTENT)
    assert got["b"] == (pytest.approx(0.8 * 0.4 + 0.2 * 1.0), fixed.EXPLAIN_BOTH)
    assert got["c"] == (pytest.approx(0.2 * 0.25), fixed.EXPLAIN_COLLAB)
    many = spark.createDataFrame([("u", "x", 5)], "user_id string, item_id string, n_likes long")
    got = {r.item_id: r.score for r in B.recommend_hybrid(cm, km, users, many, None, 10).collect()}
    assert got["b"] == pytest.approx(0.4 * 0.4 + 0.6 * 1.0)


def test_tie_order_content_first(spark, models, monkeypatch):
    cm, km = models
    content = spark.createDataFrame([("u", 1, "z", 0.5)], "user_id string, rank int, item_id string, score double")
    collab = spark.createDataFrame([("u", 1, "a", 2.0)], "user_id string, rank int, item_id string, score double")
    monkeypatch.setattr(B, "content_leg", lambda *a, **k: content)
    monkeypatch.setattr(B, "collab_leg", lambda *a, **k: collab)
    users = spark.createDataFrame([("u",)], "user_id string")
    liked = spark.createDataFrame([("u", "x", 1)], "user_id string, item_id string, n_likes long")
    # 0.8 * 0.5 == 0.2 * 2.0: the content entry ranks first
    r = sorted(B.recommend_hybrid(cm, km, users, liked, None, 10).collect(), key=lambda r: r.rank)
    assert [x.item_id for x in r] == ["z", "a"]


def test_similar_items_hybrid(spark, models):
    cm, km = models
    rows = B.similar_items(cm, km, 3).collect()
    assert rows
    by_src = {}
    for r in rows:
        assert r.item_id != r.other_id
        by_src.setdefault(r.item_id, []).append(r)
    for lst in by_src.values():
        assert len(lst) <= 3 and len({r.other_id for r in lst}) == len(lst)
        assert [r.rank for r in sorted(lst, key=lambda r: r.rank)] == list(range(1, len(lst) + 1))


def test_fallback_and_serve(spark, fix_items, fix_interactions):
    users = spark.createDataFrame([("user_1",), ("new",)], "user_id string")
    touched = strength.touched_items(fix_interactions)
    fb = B.fallback(fix_items, users, touched, 3).collect()
    assert all(r.score == 0.5 and r.explanation == fixed.EXPLAIN_FALLBACK for r in fb)
    assert not {(r.user_id, r.item_id) for r in fb} & {(r.user_id, r.item_id) for r in touched.collect()}
    assert len([r for r in fb if r.user_id == "new"]) == 3
    res = spark.createDataFrame([("u", 1, "mv_11", 1.7, "x"), ("u", 2, "bk_21", 0.3, "x"),
                                 ("u", 3, "gone", 0.2, "x"), ("u", 4, "mv_12", -0.1, "x")],
                                "user_id string, rank int, item_id string, score double, explanation string")
    served = sorted(B.serve(res, fix_items, 10, item_type="movie").collect(), key=lambda r: r.rank)
    assert [r.item_id for r in served] == ["mv_11", "mv_12"]
    assert served[0].score == 1.0 and served[1].score == 0.0
    f = B.serve(res, fix_items, 10, filters={"director": "I. Varga"}).collect()
    assert [r.item_id for r in f] == ["mv_11"]
    g = B.serve(res, fix_items, 10, filters={"year": 1952}).collect()
    assert [r.item_id for r in g] == ["bk_21"]
    h = B.serve(res, fix_items, 10, filters={"year": "1952"}).collect()
    assert h == []


def test_train_models_isolates_failures(spark, fix_items, fix_interactions):
    empty = spark.createDataFrame([], "user_id string, item_id string, strength double")
    res = B.train_models(fix_items, empty, "hybrid", item_types=["movie"])
    assert res["content"] is not None and res["content"].n_items == 3
    assert res["collaborative"] is None and "Empty" in res["errors"]["collaborative"]


def test_dispatch_and_info(spark, models, fix_interactions):
    cm, km = models
    users = spark.createDataFrame([("user_1",)], "user_id string")
    items = spark.createDataFrame([("mv_11",)], "item_id string")
    liked = strength.liked_items(fix_interactions)
    touched = strength.touched_items(fix_interactions)
    sim = B.dispatch(cm, km, 3, items=items).collect()
    assert sim and all(r.item_id == "mv_11" for r in sim)
    for strat, label in (("content_based", fixed.EXPLAIN_CONTENT), ("collaborative", fixed.EXPLAIN_COLLAB)):
        rows = B.dispatch(cm, km, 2, strat, users=users, liked=liked, exclude=touched).collect()
        assert rows and all(r.explanation == label and r.user_id == "user_1" for r in rows)
    info = B.training_info(cm, km)
    assert info["is_content_trained"] and info["collaborative_model"]["n_factors"] == km.k
    with pytest.raises(ValueError):
        B.dispatch(cm, km, 2, "nope", users=users)


def test_users_without_history_are_ranked_once(spark, models, fix_interactions, monkeypatch):
    cm, km = models
    asked = []
    real = B.collab_leg
    monkeypatch.setattr(B, "collab_leg", lambda k, u, *a: asked.append(u.count()) or real(k, u, *a))
    users = spark.createDataFrame([(f"new_{i}",) for i in range(40)] + [("user_1",), ("user_2",)], "user_id string")
    liked, touched = strength.liked_items(fix_interactions), strength.touched_items(fix_interactions)
    got = {}
    for r in B.recommend_hybrid(cm, km, users, liked, touched, 3).collect():
        got.setdefault(r.user_id, []).append((r.rank, r.item_id, r.score, r.explanation))
    assert sorted(asked) == [1, 2]
    popular = K.popular_items(km, 3).orderBy("rank").collect()
    for i in range(40):
        mine = sorted(got[f"new_{i}"])
        assert [x[:2] for x in mine] == [(r["rank"], r["item_id"]) for r in popular]
        assert [x[2] for x in mine] == pytest.approx([fixed.COLD_START_COLLAB_WEIGHT * r["score"] for r in popular])
    assert {"user_1", "user_2"} <= set(got)


def test_filtered_query_filters_cuts_and_counts(spark, fix_interactions, monkeypatch):
    """Every stage of the query counts: type, metadata (or else feature) value, count, cut."""
    items = spark.createDataFrame(
        [(f"m{i:02d}", f"t{i}", "book" if i == 6 else "movie", '{"brand":"Brand#1"}' if i == 4 else "{}",
          "{}" if i == 4 else f'{{"brand":"Brand#{1 + i % 2}"}}') for i in range(1, 41)],
        "item_id string, title string, item_type string, features string, metadata string")
    ranked = spark.createDataFrame([("u", i, f"m{i:02d}", 1.5 - i / 100, "x") for i in range(1, 41)],
                                   "user_id string, rank int, item_id string, score double, explanation string")
    monkeypatch.setattr(q_blend.B, "recommend_hybrid", lambda *a: ranked.where(F.col("rank") <= a[5]))
    monkeypatch.setattr(q_blend.V, "items_v", lambda *a: items)
    monkeypatch.setattr(q_blend, "interactions", lambda *a: fix_interactions)
    monkeypatch.setattr(q_blend, "content_model", lambda *a: None)
    monkeypatch.setattr(q_blend, "collab_model", lambda *a: None)
    got = sorted(q_blend.q_filtered(spark, "").collect(), key=lambda r: r["rank"])
    passing = [i for i in range(1, 41) if i % 2 == 0 and i != 6]
    assert [r.item_id for r in got] == [f"m{i:02d}" for i in passing][:10] and len(passing) > 10
    assert [r["rank"] for r in got] == list(range(1, 11))
    assert {r.total_candidates for r in got} == {len(passing)}
    assert got[0].score == 1.0 and got[0].metadata == '{"brand":"Brand#1"}'
