"""Step 7 queries: collaborative model (SVD). The factors come from an iterative
decomposition: SQL states what every such decomposition fulfils, tests compare
the products with NumPy."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankfold import fixed
from rankfold.functions.scalar import out_score
from rankfold.operators import collab as K
from rankfold.operators import strength
from rankfold.plans.models import collab_model, interactions
from rankfold.plans.q_ingest import STRENGTH_SQL
from rankfold.plans.registry import query
from rankfold.sources import views as V

N = 10


def model(spark, sf) -> K.CollabModel:
    return collab_model(spark, sf)


@query("svd_summary")
def q_svd_summary(spark, sf):
    return K.summary(model(spark, sf), spark)


@query("svd_invariants", sql=f"""
WITH s AS ({STRENGTH_SQL}),
k AS (SELECT greatest(1, least({fixed.N_FACTORS}, {fixed.N_FACTORS_CAP}, count(DISTINCT user_id) - 1,
             count(DISTINCT item_id) - 1)) AS k FROM s),
f AS (SELECT unnest(range(k)) AS a FROM k)
SELECT 'orthonormal' AS part, CAST(x.a AS INTEGER) AS a, CAST(y.a AS INTEGER) AS b,
  CASE WHEN x.a = y.a THEN 1.0 ELSE 0.0 END AS value FROM f x, f y
UNION ALL SELECT 'diagonal', x.a, y.a, 0.0 FROM f x, f y WHERE x.a <> y.a
UNION ALL SELECT 'eigen', a, 0, 0.0 FROM f
UNION ALL SELECT 'sum_squares', 0, 0, round(sum(strength * strength), 4) FROM s""")
def q_svd_invariants(spark, sf):
    """V'V = I, (U S)'(U S) diagonal, A'A V = V S^2, energy + residual = |A|^2."""
    rows = K.invariants(model(spark, sf), strength.strength_fold(interactions(spark, sf)))
    near = F.when(F.abs("value") < 5e-6, F.lit(0.0)).otherwise(F.round("value", 4))
    return rows.select("part", "a", "b", near.alias("value"))


@query("predict_rating")
def q_predict(spark, sf):
    pairs = V.interactions_raw_v(spark, sf).select("user_id", "item_id").distinct()
    return K.predict_rating(model(spark, sf), pairs).select(
        "user_id", "item_id", out_score(F.col("prediction")).alias("prediction"))


@query("collab_recommendations", bench=True)
def q_collab_recs(spark, sf):
    users = V.users_v(spark, sf)
    touched = strength.touched_items(interactions(spark, sf))
    return K.recommend(model(spark, sf), users, touched, N).select(
        "user_id", "rank", "item_id", out_score(F.col("score")).alias("score"))


@query("popular_items")
def q_popular(spark, sf):
    return K.popular_items(model(spark, sf), N).select(
        "rank", "item_id", out_score(F.col("score")).alias("score"))


@query("similar_users")
def q_similar_users(spark, sf):
    return K.similar(model(spark, sf).user_factors, "user_id", N).select(
        "user_id", "rank", "other_id", out_score(F.col("score")).alias("score"))


@query("similar_items_collab")
def q_similar_items_collab(spark, sf):
    return K.similar(model(spark, sf).item_factors, "item_id", N).select(
        "item_id", "rank", "other_id", out_score(F.col("score")).alias("score"))
