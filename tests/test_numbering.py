"""Row numbers per key across ranges, histories of a hot item, popular lists of cold users."""

import random

import pytest
from pyspark.sql import functions as F

from rankfold.operators import collab as K
from rankfold.operators import lookup, numbering
from rankfold.operators.heavy import materialise
from rankfold.operators.numbering import numbered


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_numbers_equal_a_window(spark, parts):
    rng = random.Random(parts)
    rows = [(None if rng.random() < .1 else "hot" if rng.random() < .6 else f"k{rng.randrange(40)}", rng.randrange(50), i)
            for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, v long, i long").repartition(5)
    got = numbered(df, "k", [F.col("v").desc(), F.col("i").asc()], parts=parts)
    want = {}
    for k, v, i in sorted(rows, key=lambda r: (-r[1], r[2])):
        want.setdefault(k, []).append(i)
    assert got.columns == ["k", "v", "i", "rn"]
    assert {(r.k, r.i): r.rn for r in got.collect()} == {(k, i): n + 1 for k, x in want.items() for n, i in enumerate(x)}
    assert numbered(df.limit(0), "k", [F.col("v").asc()]).count() == 0


def test_hot_item_is_spread(spark, monkeypatch):
    written = []
    monkeypatch.setattr(numbering, "materialise", lambda df, name: written.append(materialise(df, name)) or written[-1])
    log = spark.range(20_000).select(F.col("id").alias("seq"), F.lit("hot").alias("item_id"), (F.col("id") % 7).alias("timestamp"))
    out = lookup.full_history(log, "item_id")
    assert out.agg(F.min("rn"), F.max("rn"), F.count_distinct("rn")).first()[:] == (1, 20_000, 20_000)
    sizes = [r["count"] for r in written[0].groupBy("_range").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 8000


def test_cold_users_look_as_far_as_they_must(spark):
    rng = random.Random(9)
    items = [(f"i{i:03d}", [float(x)]) for i, x in enumerate(rng.choices(range(1, 40), k=300))]
    model = K.CollabModel(spark.createDataFrame([("warm", [1.0])], "user_id string, f array<double>"),
                          spark.createDataFrame(items, "item_id string, f array<double>"), 1, 0.5, {"num_items": 300})
    order = [i for i, f in sorted(items, key=lambda x: (-x[1][0], x[0]))]
    value = {i: f[0] for i, f in items}
    excluded = {"none": [], "top": order[:40], "tail": order[100:], "odd": order[::2], "all": order, "unknown": ["zz"],
                "some": rng.sample(order, 200), "most": order[:-3]}
    users = spark.createDataFrame([(u,) for u in [*excluded, "plain"]], "user_id string")
    excl = spark.createDataFrame([(u, i) for u, x in excluded.items() for i in x], "user_id string, item_id string")
    for head in (K.HEAD_PLACES, 20):
        K.HEAD_PLACES, before = head, K.HEAD_PLACES
        got = {}
        for r in K.recommend(model, users, excl, 10).collect():
            got.setdefault(r.user_id, []).append((r["rank"], r.item_id, round(r.score, 9)))
        K.HEAD_PLACES = before
        for u in [*excluded, "plain"]:
            left = [i for i in order if i not in set(excluded.get(u, []))][:10]
            assert sorted(got.get(u, [])) == [(k + 1, i, round(value[i] / value[left[0]], 9)) for k, i in enumerate(left)], u
