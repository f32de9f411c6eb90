"""Strength fold (A1), validation (V3/V4), liked and touched lists."""

from hypothesis import given, settings
from hypothesis import strategies as st

from rankfold import fixed
from rankfold.operators import strength, validate
from tests.conftest import INTER_SCHEMA


def python_fold(rows):
    """Row-by-row replay of the reference fold (arrival order)."""
    out = {}
    for _, u, i, t, v in sorted(rows):
        cur = out.get((u, i), 0.0)
        if t == "rating" and v is not None:
            cur = v / 10.0
        else:
            cur = max(cur, fixed.INTERACTION_WEIGHTS.get(t, fixed.DEFAULT_WEIGHT))
        out[(u, i)] = cur
    return out


def fold(spark, rows):
    df = spark.createDataFrame(rows, INTER_SCHEMA)
    return {(r.user_id, r.item_id): r.strength for r in strength.strength_fold(df).collect()}


def test_fixture_strengths(spark, fix_interactions):
    got = {(r.user_id, r.item_id): r.strength for r in strength.strength_fold(fix_interactions).collect()}
    assert got == {("user_1", "mv_11"): 0.7, ("user_1", "mv_12"): 0.7, ("user_1", "bk_21"): 0.9,
                   ("user_2", "mv_13"): 0.7, ("user_2", "mv_11"): 0.1, ("user_3", "mv_11"): 0.8,
                   ("user_3", "bk_22"): 1.0}


def test_edge_cases(spark):
    rows = [
        (0, "u", "dislike_only", "dislike", None),
        (1, "u", "r9_r2", "rating", 9.0), (2, "u", "r9_r2", "rating", 2.0),
        (3, "u", "r2_like", "rating", 2.0), (4, "u", "r2_like", "like", None),
        (5, "u", "like_r2", "like", None), (6, "u", "like_r2", "rating", 2.0),
        (7, "u", "rating_null", "rating", None),
        (8, "u", "view_after", "rating", 9.0), (9, "u", "view_after", "view", None),
    ]
    got = fold(spark, rows)
    assert got[("u", "dislike_only")] == 0.0
    assert abs(got[("u", "r9_r2")] - 0.2) < 1e-12
    assert got[("u", "r2_like")] == 0.7
    assert abs(got[("u", "like_r2")] - 0.2) < 1e-12
    assert got[("u", "rating_null")] == 1.0
    assert abs(got[("u", "view_after")] - 0.9) < 1e-12


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.sampled_from(["x", "y"]),
                          st.sampled_from(fixed.INTERACTION_TYPES),
                          st.one_of(st.none(), st.floats(0, 10, allow_nan=False))),
                min_size=1, max_size=25))
def test_fold_equals_replay(spark, rows):
    seq_rows = [(i, u, it, t, v) for i, (u, it, t, v) in enumerate(rows)]
    got = fold(spark, seq_rows)
    want = python_fold(seq_rows)
    assert got.keys() == want.keys()
    for k in want:
        assert abs(got[k] - want[k]) < 1e-12


def test_validation_rules(spark):
    rows = [(0, "u", "i", "view", 10.5), (1, "u", "i", "view", -1.0), (2, "u", "i", "rating", None),
            (3, "u", "i", "poke", None), (4, "", "i", "view", None), (5, "u", "i", "view", 10.0),
            (6, "u", "i", "rating", 0.0)]
    df = spark.createDataFrame(rows, INTER_SCHEMA)
    ok, bad = validate.split(df, validate.interaction_rules())
    assert sorted(r.seq for r in ok.collect()) == [5, 6]
    reasons = {r.seq: r.reason for r in bad.collect()}
    assert reasons == {0: "value range", 1: "value range", 2: "rating needs value",
                       3: "interaction_type", 4: "user_id length"}


def test_liked_keeps_repeats(spark):
    rows = [(0, "u", "i", "like", None), (1, "u", "i", "rating", 8.0), (2, "u", "j", "rating", 6.0),
            (3, "u", "k", "bookmark", None), (4, "u", "m", "dislike", None)]
    df = spark.createDataFrame(rows, INTER_SCHEMA)
    liked = {(r.item_id): r.n_likes for r in strength.liked_items(df).collect()}
    assert liked == {"i": 2, "k": 1}
    touched = {r.item_id for r in strength.touched_items(df).collect()}
    assert touched == {"i", "j", "k", "m"}


def test_fold_plan_is_partial_hash_aggregate(spark):
    """One hot (user, item) pair holding most rows: map-side combined, no window."""
    from pyspark.sql import functions as F
    n = 20000
    df = (spark.range(n).select(F.col("id").alias("seq"),
                                F.when(F.col("id") % 10 == 0, F.lit("other")).otherwise(F.lit("hot")).alias("user_id"),
                                F.lit("i").alias("item_id"),
                                F.when(F.col("id") % 7 == 0, F.lit("rating")).otherwise(F.lit("view"))
                                .alias("interaction_type"),
                                F.when(F.col("id") % 7 == 0, (F.col("id") % 11).cast("double")).alias("value"))
          .repartition(8))
    out = strength.strength_fold(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortAggregate" not in plan
    assert plan.count("HashAggregate") >= 2  # partial (map side) + final
    rows = [tuple(r) for r in df.orderBy("seq").collect()]
    want = python_fold(rows)
    got = {(r.user_id, r.item_id): r.strength for r in out.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
