"""Mixed requests, blend weights that are saved and applied, exclude sets."""

import json

import pytest
from pyspark.sql import functions as F

from rankfold.functions import jsonfields as J
from rankfold.operators import blend as B
from rankfold.operators import collab as K
from rankfold.operators import content as C
from rankfold.operators import requests as R
from rankfold.operators import strength
from rankfold.sources import store


@pytest.fixture(scope="module")
def parts(spark):
    from tests.conftest import FIX_INTERACTIONS, FIX_ITEMS, INTER_SCHEMA, ITEM_SCHEMA
    items = spark.createDataFrame(FIX_ITEMS, ITEM_SCHEMA).withColumn("created_at", F.timestamp_seconds(F.lit(1704067200)).cast("timestamp_ntz"))
    log = spark.createDataFrame(FIX_INTERACTIONS, INTER_SCHEMA)
    return C.train(items), K.train(strength.strength_fold(log)), items, log


def ask(spark, rows):
    names = R.REQUEST.split(", ")
    return spark.createDataFrame([tuple(r.get(c.split()[0]) for c in names) for r in rows], R.REQUEST)


def by_request(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.request_id, []).append((r.rank, r.item_id, round(r.score, 9), r.explanation))
    return {k: [x[1:] for x in sorted(v)] for k, v in out.items()}


def test_answers_equal_the_single_operators(spark, parts):
    cm, km, items, log = parts
    rows = [{"request_id": f"{s}{u}{e}{n}", "user_id": u, "strategy": s, "n": n, "exclude_interacted": e}
            for s in ("hybrid", "content_based", "collaborative") for u in ("user_1", "user_3", "nobody") for e, n in ((True, 2), (False, 3))]
    rows += [{"request_id": f"item{i}", "item_id": i, "n": 2} for i in ("mv_11", "bk_22", "none")] + [
        {"request_id": "both", "user_id": "user_2", "item_id": "mv_11", "n": 3}]
    got, bad = R.answer(ask(spark, rows), cm, km, items, log)
    assert bad.count() == 0
    got = by_request(got)
    liked, touched = strength.liked_items(log), strength.touched_items(log)
    seen = 0
    for s in ("hybrid", "content_based", "collaborative"):
        for e, n in ((True, 2), (False, 3)):
            users = spark.createDataFrame([(u,) for u in ("user_1", "user_3", "nobody")], "user_id string")
            want = {}
            for x in B.dispatch(cm, km, n, s, users=users, liked=liked, exclude=touched if e else None).orderBy("rank").collect():
                want.setdefault(x.user_id, []).append((x.item_id, round(min(max(x.score, 0.0), 1.0), 9), x.explanation))
            for u in ("user_1", "user_3", "nobody"):
                assert got.get(f"{s}{u}{e}{n}", []) == want.get(u, [])
                seen += len(want.get(u, []))
    near = {}
    for x in B.similar_items(cm, km, 2, spark.createDataFrame([("mv_11",), ("bk_22",), ("none",)], "item_id string")).orderBy("rank").collect():
        near.setdefault(x.item_id, []).append((x.other_id, round(x.score, 9), x.explanation))
    assert {i: got.get(f"item{i}", []) for i in ("mv_11", "bk_22", "none")} == {**near, "none": []}
    assert seen > 20 and len(got["both"]) == 3


def test_filters_and_counts_of_each_request(spark, parts):
    cm, km, items, log = parts
    base = {"user_id": "user_2", "n": 5, "exclude_interacted": False, "strategy": "collaborative"}
    rows = [{"request_id": "all", **base}, {"request_id": "book", **base, "item_type": "book"},
            {"request_id": "western", **base, "filters": '{"genre":"Western"}'}, {"request_id": "two", **base, "filters": '{"genre":"Saga","year":1952.0}'},
            {"request_id": "absent", **base, "filters": '{"nothing":null}'}, {"request_id": "text", **base, "filters": '{"year":"1952"}'}]
    got, _ = R.answer(ask(spark, rows), cm, km, items, log)
    found = {}
    for r in got.collect():
        found.setdefault(r.request_id, set()).add((r.item_id, r.total_candidates))
    ids = {k: {i for i, _ in v} for k, v in found.items()}
    assert ids["book"] == {i for i in ids["all"] if i.startswith("bk")} and ids["absent"] == ids["all"]
    assert ids["western"] <= {"mv_11", "mv_12"} and ids.get("two", set()) <= {"bk_21"} and "text" not in ids
    assert all(n == len(v) for v in found.values() for _, n in v)


def test_items_that_are_gone_drop_out_after_the_count(spark, parts):
    cm, km, items, log = parts
    rows = [{"request_id": "a", "user_id": "user_1", "n": 5, "exclude_interacted": False, "strategy": "collaborative"}]
    whole = R.answer(ask(spark, rows), cm, km, items, log)[0].collect()
    fewer = R.answer(ask(spark, rows), cm, km, items.where(F.col("item_id") != whole[0].item_id), log)[0].collect()
    assert len(fewer) == len(whole) - 1 and {r.total_candidates for r in fewer} == {len(whole)}
    assert sorted(r["rank"] for r in fewer) == list(range(1, len(whole)))


def test_untrained_service_gives_the_newest(spark, parts):
    _, _, items, log = parts
    rows = [{"request_id": "a", "user_id": "user_1", "n": 3}, {"request_id": "b", "item_id": "mv_11", "n": 2, "item_type": "book"}]
    got = by_request(R.answer(ask(spark, rows), None, None, items, log)[0])
    # the first three by id (equal times) without what user_1 touched
    assert [x[0] for x in got["a"]] == ["bk_22"] and [x[0] for x in got["b"]] == ["bk_21", "bk_22"]
    assert all(x[1:] == (0.5, "Popular item") for v in got.values() for x in v)


def test_bad_requests_say_why(spark, parts):
    cm, km, items, log = parts
    rows = [{"request_id": "none"}, {"request_id": "empty", "user_id": "", "item_id": ""}, {"request_id": "n", "user_id": "u", "n": 101},
            {"request_id": "zero", "user_id": "u", "n": 0}, {"request_id": "s", "user_id": "u", "strategy": "x"},
            {"request_id": "t", "user_id": "u", "item_type": "gadget"}, {"request_id": "f", "user_id": "u", "filters": "[1]"}]
    good, bad = R.answer(ask(spark, rows), cm, km, items, log)
    assert good.count() == 0
    why = "Either user_id or item_id must be provided"
    assert {r.request_id: r.reason for r in bad.collect()} == {"none": why, "empty": why, "n": "n", "zero": "n", "s": "strategy",
                                                                "t": "item_type", "f": "filters"}


def test_one_trained_model_is_enough(spark, parts):
    cm, km, items, log = parts
    rows = [{"request_id": s, "user_id": "user_1", "n": 3, "strategy": s} for s in ("hybrid", "content_based", "collaborative")]
    only_c = by_request(R.answer(ask(spark, rows), cm, None, items, log)[0])
    only_k = by_request(R.answer(ask(spark, rows), None, km, items, log)[0])
    assert set(only_c) == {"hybrid", "content_based"} and set(only_k) == {"hybrid", "collaborative"}


def test_saved_weights_change_the_blend(spark, parts, tmp_dir):
    cm, km, _, log = parts
    users = spark.createDataFrame([("user_1",)], "user_id string")
    liked, n = strength.liked_items(log).where("user_id = 'user_1'"), 5
    mine = B.Weights(content_weight=1.0, collaborative_weight=0.0, cold_start_threshold=0)
    store.save_hybrid(tmp_dir, cm, km, mine)
    c2, k2, conf = store.load_hybrid(spark, tmp_dir)
    assert B.Weights.of(conf) == mine and B.Weights.of({}) == B.Weights()

    def scores(w):
        return {r.item_id: r.score for r in B.recommend_hybrid(c2, k2, users, liked, None, n, w).collect()}

    content = {r.item_id: r.score for r in C.recommend_from_liked(c2, liked, None, 3 * n).collect()}
    loaded = scores(B.Weights.of(conf))
    assert all(abs(s - content.get(i, 0.0)) < 1e-9 for i, s in loaded.items())
    assert loaded != scores(B.Weights())


def test_exclude_set_and_self(spark, parts):
    cm, km, _, _ = parts
    one = spark.createDataFrame([("mv_11",)], "item_id string")
    free = [r.other_id for r in B.similar_items(cm, km, 2, one).orderBy("rank").collect()]
    gone = spark.createDataFrame([("mv_11", free[0]), ("bk_21", "mv_13")], "item_id string, other_id string")
    left = [r.other_id for r in B.similar_items(cm, km, 2, one, exclude=gone).orderBy("rank").collect()]
    assert free[0] not in left and left[0] == free[1]
    own = {r.item_id: (r.other_id, round(r.score, 9)) for r in C.similar_items(cm, 3, exclude_self=False).where("rank = 1").collect()}
    assert len(own) == 5 and all(i == o and s == 1.0 for i, (o, s) in own.items())


def test_filter_values(spark):
    cases = [('{"a":1}', '{"a":1}', "{}", True), ('{"a":1}', '{"a":true}', "{}", True), ('{"a":1}', '{"a":"1"}', "{}", False),
             ('{"a":0}', '{"a":5}', '{"a":0}', False), ('{"a":0}', '{"a":""}', '{"a":0}', True), ('{"a":null}', "{}", "{}", True),
             ('{"a":null}', '{"a":0}', "{}", True), ('{"a":"x"}', '{"a":null}', '{"a":"x"}', True), ('{"a":[1,"b"]}', '{"a":[1,"b"]}', "{}", True),
             (None, "{}", "{}", True), ("{}", "{}", "{}", True), ('{"a":1,"b":2}', '{"a":1}', '{"b":3}', False)]
    df = spark.createDataFrame([(json.dumps(i), *c) for i, c in enumerate(cases)], "i string, f string, m string, x string, want boolean")
    bad = df.select("*", J.matches(F.col("f"), F.col("m"), F.col("x")).alias("got")).where("not (got <=> want)").collect()
    assert bad == []
