"""Step 9 queries: result logs (S15) built from served results."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankfold.operators import blend as B
from rankfold.operators import strength
from rankfold.plans.models import interactions
from rankfold.plans.registry import query
from rankfold.sources import store
from rankfold.sources import views as V

N = 10


@query("recommendation_log", sql=V.sql_with("items_v", "interactions_v", "users_v") + f""",
newest AS (SELECT item_id, row_number() OVER (ORDER BY seq DESC, item_id) AS pos
           FROM items_v ORDER BY seq DESC, item_id LIMIT {N}),
per_user AS (
  SELECT u.user_id, n.item_id, n.pos FROM users_v u CROSS JOIN newest n
  WHERE NOT EXISTS (SELECT 1 FROM interactions_v i WHERE i.user_id = u.user_id AND i.item_id = n.item_id))
SELECT user_id, 'fallback' AS strategy, {N} AS num_requested, count(*) AS num_returned,
       string_agg(item_id, ',' ORDER BY pos) AS recommended_items
FROM per_user GROUP BY user_id""")
def q_recommendation_log(spark, sf):
    """One log row per user for the fallback results of every user."""
    recs = B.fallback(V.items_v(spark, sf), V.users_v(spark, sf),
                      strength.touched_items(interactions(spark, sf)), N)
    rows = store.log_rows(recs, "fallback", N)
    return rows.select("user_id", "strategy", F.col("num_requested").cast("long").alias("num_requested"),
                       F.col("num_returned").cast("long").alias("num_returned"),
                       F.concat_ws(",", "recommended_items").alias("recommended_items"))
