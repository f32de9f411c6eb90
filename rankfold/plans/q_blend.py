"""Step 8 queries: blending and serving."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankfold.functions.scalar import out_score
from rankfold.operators import blend as B
from rankfold.operators import strength
from rankfold.plans.models import collab_model, content_model, interactions
from rankfold.plans.q_content import CONTENT_RECS_SQL
from rankfold.plans.q_factors import FILTERS, SERVED
from rankfold.plans.registry import query
from rankfold.sources import views as V

N = 10


def _rounded(df, *cols):
    return df.select(*[out_score(F.col(c)).alias(c) if c == "score" else F.col(c) for c in cols])


@query("similar_items_hybrid", bench=True)
def q_similar_hybrid(spark, sf):
    r = B.similar_items(content_model(spark, sf), collab_model(spark, sf), N)
    return _rounded(r, "item_id", "rank", "other_id", "score", "explanation")


@query("hybrid_recommendations", bench=True)
def q_hybrid(spark, sf):
    inter = interactions(spark, sf)
    users = inter.select("user_id").distinct()
    r = B.recommend_hybrid(content_model(spark, sf), collab_model(spark, sf), users,
                           strength.liked_items(inter), strength.touched_items(inter), N)
    return _rounded(r, "user_id", "rank", "item_id", "score", "explanation")


@query("fallback_recommendations", sql=V.sql_with("items_v", "interactions_v", "users_v") + f""",
newest AS (SELECT item_id, row_number() OVER (ORDER BY seq DESC, item_id) AS pos
           FROM items_v ORDER BY seq DESC, item_id LIMIT {N}),
per_user AS (
  SELECT u.user_id, n.item_id, n.pos FROM users_v u CROSS JOIN newest n
  WHERE NOT EXISTS (SELECT 1 FROM interactions_v i WHERE i.user_id = u.user_id AND i.item_id = n.item_id))
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY pos) AS INTEGER) AS rank, item_id,
       0.5 AS score, 'Popular item' AS explanation
FROM per_user""")
def q_fallback(spark, sf):
    inter = interactions(spark, sf)
    r = B.fallback(V.items_v(spark, sf), V.users_v(spark, sf), strength.touched_items(inter), N)
    return r.select("user_id", "rank", "item_id", "score", "explanation")


@query("filtered_recommendations")
def q_filtered(spark, sf):
    """Hybrid results for interacting users, then item_type = 'movie' and
    a metadata/feature filter, counted, cut to n, enriched and clamped. More than n
    are ranked, so that the cut has something to choose from."""
    inter = interactions(spark, sf)
    users = inter.select("user_id").distinct()
    r = B.recommend_hybrid(content_model(spark, sf), collab_model(spark, sf), users,
                           strength.liked_items(inter), strength.touched_items(inter), SERVED)
    s = B.serve(r, V.items_v(spark, sf), N, item_type="movie", filters=FILTERS)
    return _rounded(s, "user_id", "rank", "item_id", "title", "item_type", "score", "explanation", "metadata",
                    "total_candidates")


@query("content_strategy_recommendations", sql=CONTENT_RECS_SQL.replace(
    "SELECT user_id, CAST(rank AS INTEGER) AS rank, item_id, round(score, 6) AS score FROM ranked",
    "SELECT user_id, CAST(rank AS INTEGER) AS rank, item_id, round(score, 6) AS score, "
    "'Based on your preferences' AS explanation FROM ranked"))
def q_content_strategy(spark, sf):
    inter = interactions(spark, sf)
    r = B.recommend_content(content_model(spark, sf), strength.liked_items(inter),
                            strength.touched_items(inter), N)
    return _rounded(r, "user_id", "rank", "item_id", "score", "explanation")
