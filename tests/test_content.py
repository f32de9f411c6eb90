"""Content model: features against a NumPy re-computation, neighbours,
liked-list recommendations, errors."""

import math

import numpy as np
import pytest
import regex

from rankfold import fixed
from rankfold.operators import content as C
from rankfold.operators import strength


def numpy_cosine(items, numeric=None):
    """Dense re-computation of the stacked feature cosine (text + one-hot)."""
    stops = set(fixed.STOP_WORDS)
    docs = []
    for it in items:
        text = " ".join(x for x in (it[1], it[3]) if x)
        toks = [t for t in regex.findall(r"[\p{L}\p{N}_]{2,}", text.lower()) if t not in stops]
        docs.append(toks + [f"{a} {b}" for a, b in zip(toks, toks[1:])])
    vocab = sorted({t for d in docs for t in d})
    n = len(items)
    df = {t: sum(t in d for d in docs) for t in vocab}
    tf = np.array([[d.count(t) for t in vocab] for d in docs], float)
    idf = np.array([math.log((1 + n) / (1 + df[t])) + 1 for t in vocab])
    w = tf * idf
    w = w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-300)
    types = sorted({it[2] for it in items})
    oh = np.array([[1.0 if it[2] == t else 0.0 for t in types] for it in items])
    x = np.hstack([w, oh])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T


def test_similar_items_match_numpy(spark, fix_items):
    from tests.conftest import FIX_ITEMS
    m = C.train(fix_items)
    sim = numpy_cosine(FIX_ITEMS)
    ids = [it[0] for it in FIX_ITEMS]
    got = C.similar_items(m, n=10).collect()
    assert got, "neighbours expected"
    for r in got:
        assert r.item_id != r.other_id
        want = sim[ids.index(r.item_id), ids.index(r.other_id)]
        assert abs(r.score - want) < 1e-9
    # every positive pair is present, ranked by score desc then id
    for i, a in enumerate(ids):
        exp = sorted([(-round(sim[i, j], 9), b) for j, b in enumerate(ids) if j != i and sim[i, j] > 0])
        mine = sorted([(r.rank, r.other_id) for r in got if r.item_id == a])
        assert [b for _, b in mine] == [b for _, b in exp]


def test_training_info_and_errors(spark, fix_items):
    m = C.train(fix_items)
    info = C.training_info(m)
    assert info["num_items"] == 5 and info["feature_dimensions"] > 2
    with pytest.raises(ValueError):
        C.train(fix_items.limit(0))


def test_recommend_from_liked(spark, fix_items, fix_interactions):
    m = C.train(fix_items)
    liked = strength.liked_items(fix_interactions)
    touched = strength.touched_items(fix_interactions)
    recs = C.recommend_from_liked(m, liked, touched, n=2).collect()
    seen = {(r.user_id, r.item_id) for r in touched.collect()}
    per_user = {}
    for r in recs:
        assert (r.user_id, r.item_id) not in seen
        assert r.score > 0
        per_user.setdefault(r.user_id, []).append(r.rank)
    for ranks in per_user.values():
        assert sorted(ranks) == list(range(1, len(ranks) + 1)) and len(ranks) <= 2
    # score = mean cosine to the liked list
    from tests.conftest import FIX_ITEMS
    sim = numpy_cosine(FIX_ITEMS)
    ids = [it[0] for it in FIX_ITEMS]
    u1 = [r for r in recs if r.user_id == "user_1"]
    for r in u1:
        liked_ids = ["mv_11", "mv_12", "bk_21"]
        want = np.mean([sim[ids.index(x), ids.index(r.item_id)] for x in liked_ids])
        assert abs(r.score - want) < 1e-9


def test_unknown_liked_and_empty_text(spark):
    items = spark.createDataFrame(
        [("a", "", "movie", None, "{}", "{}"), ("b", "red fox", "movie", "", "{}", "{}"),
         ("c", "red fox jumps", "book", "", "{}", "{}")],
        "item_id string, title string, item_type string, description string, features string, metadata string")
    m = C.train(items)
    got = {(r.item_id, r.other_id): r.score for r in C.similar_items(m, 5).collect()}
    # item a has only its type block: cosine with b = 1/sqrt(2)
    assert abs(got[("a", "b")] - 1 / math.sqrt(2)) < 1e-9
    liked = spark.createDataFrame([("u", "zzz", 1)], "user_id string, item_id string, n_likes long")
    assert C.recommend_from_liked(m, liked, None, 5).count() == 0


def test_minmax_constant_column(spark):
    items = spark.createDataFrame([("a", 3.0, 0.0), ("b", 3.0, 2.0), ("c", 3.0, 4.0)],
                                  "item_id string, price double, size double")
    cfg = C.ContentConfig(text_fields=[], categorical_fields=[], numerical_fields=["price", "size"])
    mm = {(r.item_id, r.field): r.value for r in C.minmax_features(C.corpus(items, cfg), cfg).collect()}
    assert mm[("a", "price")] == 0.0 and mm[("c", "size")] == 1.0 and mm[("b", "size")] == 0.5


def test_tokens_and_bigrams(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("The quick, brown fox; the FOX!",)], "t string")
    toks = df.select(C.tokens(F.col("t"), fixed.STOP_WORDS).alias("toks"))
    got = toks.select(C.with_bigrams(F.col("toks")).alias("x")).first().x
    assert got == ["quick", "brown", "fox", "fox", "quick brown", "brown fox", "fox fox"]


def test_signature_collapse_equals_direct(spark):
    """Many identical vectors and tied scores: collapsed result == direct result."""
    rows = []
    for i in range(60):
        name = ["red fox", "blue fox", "red cat", "green owl"][i % 4]
        rows.append((f"{i:03d}", name, ["movie", "book", "song"][i % 3], None, "{}", "{}"))
    items = spark.createDataFrame(rows, "item_id string, title string, item_type string, description string, "
                                        "features string, metadata string")
    m = C.train(items)
    for k in (1, 5, 12):
        a = sorted((r.item_id, r.rank, r.other_id, round(r.score, 9)) for r in C.similar_items(m, k).collect())
        b = sorted((r.item_id, r.rank, r.other_id, round(r.score, 9))
                   for r in C.similar_items_direct(m, k).collect())
        assert a == b


def test_recommendations_rank_distinct_vectors_once(spark, monkeypatch):
    """Equal vectors, tied scores, exclusions of whole vectors: as the plain product over all
    items, which is never made."""
    rows = [(f"{i:03d}", ["red fox", "blue fox", "red cat", "green owl", "blue cat"][i % 5], ["movie", "book"][i // 5 % 2], None, "{}", "{}")
            for i in range(70)]
    items = spark.createDataFrame(rows, "item_id string, title string, item_type string, description string, "
                                        "features string, metadata string")
    m = C.train(items)
    liked_rows = [("a", "000", 2), ("a", "001", 1), ("b", "003", 1), ("b", "gone", 4), ("c", "012", 1)]
    excl_rows = [("a", f"{i:03d}") for i in range(0, 70, 10)] + [("a", "065"), ("b", "013"), ("c", "gone")]
    liked = spark.createDataFrame(liked_rows, "user_id string, item_id string, n_likes long")
    excl = spark.createDataFrame(excl_rows, "user_id string, item_id string")
    vec = {r.item_id: dict(zip(r.idx, r.val)) for r in m.vectors.collect()}
    seen = []
    real = C.top_n_dot
    monkeypatch.setattr(C, "top_n_dot", lambda q, c, *a, **k: seen.append(c.count()) or real(q, c, *a, **k))
    limits = spark.createDataFrame([("a", 40), ("b", 3), ("c", 0)], "user_id string, n int")
    for n in (1, 6, 30, limits):
        got = {}
        for r in sorted(C.recommend_from_liked(m, liked, excl, n).collect(), key=lambda r: (r.user_id, r.rank)):
            got.setdefault(r.user_id, []).append((r.item_id, round(r.score, 9)))
        for u in "abc":
            mine = [(vec[i], k) for x, i, k in liked_rows if x == u and i in vec]
            gone = {i for x, i in excl_rows if x == u} | {i for x, i, _ in liked_rows if x == u}
            score = {i: round(sum(k * sum(w * v.get(f, 0.0) for f, w in l.items()) for l, k in mine) / sum(k for _, k in mine), 9)
                     for i, v in vec.items() if i not in gone}
            want = sorted(((i, s) for i, s in score.items() if s > 0), key=lambda x: (-x[1], x[0]))
            assert got.get(u, []) == want[:n if isinstance(n, int) else {"a": 40, "b": 3, "c": 0}[u]]
    assert seen == [10] * 4
