"""Step 3 queries: statistics."""

from __future__ import annotations

from rankfold.operators import stats as S
from rankfold.operators import strength
from rankfold.plans.models import interactions
from rankfold.plans.registry import query
from rankfold.sources import views as V


@query("store_stats", bench=True, sql=V.sql_with("items_v", "users_v", "interactions_v") + """
SELECT 'items' AS kind, item_type AS type, count(*) AS n FROM items_v GROUP BY GROUPING SETS ((), (item_type))
UNION ALL SELECT 'users', NULL, count(*) FROM users_v
UNION ALL SELECT 'interactions', interaction_type, count(*) FROM interactions_v
          GROUP BY GROUPING SETS ((), (interaction_type))""")
def q_store_stats(spark, sf):
    return S.store_stats(V.items_v(spark, sf), V.users_v(spark, sf), interactions(spark, sf))


@query("interaction_stats", sql=V.sql_with("interactions_v") + """
SELECT 'interactions' AS kind, interaction_type AS type, count(*) AS n FROM interactions_v
GROUP BY GROUPING SETS ((), (interaction_type))""")
def q_interaction_stats(spark, sf):
    return S.interaction_stats(interactions(spark, sf))


@query("interactions_per_user", sql=V.sql_with("interactions_v") + """
SELECT user_id, count(*) AS n FROM interactions_v GROUP BY user_id""")
def q_interactions_per_user(spark, sf):
    """A5 for every user at once."""
    from pyspark.sql import functions as F
    return interactions(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("strength_summary", sql=V.sql_with("interactions_v") + """,
marked AS (
  SELECT *, (interaction_type = 'rating' AND value IS NOT NULL) AS is_r,
         max(CASE WHEN interaction_type = 'rating' AND value IS NOT NULL THEN seq END)
           OVER (PARTITION BY user_id, item_id) AS lr
  FROM interactions_v),
st AS (
  SELECT user_id, item_id,
         greatest(coalesce(max(CASE WHEN seq = lr THEN value / 10.0 END), 0.0),
                  coalesce(max(CASE WHEN NOT is_r AND (lr IS NULL OR seq > lr) THEN
                    CASE interaction_type WHEN 'view' THEN 0.1 WHEN 'click' THEN 0.2 WHEN 'like' THEN 0.7
                      WHEN 'dislike' THEN -0.5 WHEN 'purchase' THEN 1.0 WHEN 'rating' THEN 1.0
                      WHEN 'bookmark' THEN 0.5 ELSE 0.1 END END), 0.0)) AS strength
  FROM marked GROUP BY user_id, item_id)
SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, count(*) AS n_pairs,
       CAST(sum(CASE WHEN strength > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_positive,
       coalesce(avg(CASE WHEN strength > 0 THEN strength END), 0.0) AS global_mean,
       1.0 - sum(CASE WHEN strength > 0 THEN 1 ELSE 0 END) / (count(DISTINCT user_id) * count(DISTINCT item_id))
         AS sparsity
FROM st""")
def q_strength_summary(spark, sf):
    return S.strength_summary(strength.strength_fold(interactions(spark, sf)))


@query("request_counters", sql=V.sql_with("requests_v") + """
SELECT endpoint, status, count(*) AS n FROM requests_v GROUP BY endpoint, status""")
def q_request_counters(spark, sf):
    return S.request_counters(V.requests_v(spark, sf))


@query("latency_histogram", sql=V.sql_with("requests_v") + """,
agg AS (
  SELECT count(*) AS total, sum(processing_time_ms / 1000.0) AS sum_s,
         sum(CASE WHEN processing_time_ms / 1000.0 <= 0.01 THEN 1 ELSE 0 END) AS b0,
         sum(CASE WHEN processing_time_ms / 1000.0 <= 0.05 THEN 1 ELSE 0 END) AS b1,
         sum(CASE WHEN processing_time_ms / 1000.0 <= 0.1 THEN 1 ELSE 0 END) AS b2,
         sum(CASE WHEN processing_time_ms / 1000.0 <= 0.25 THEN 1 ELSE 0 END) AS b3,
         sum(CASE WHEN processing_time_ms / 1000.0 <= 0.5 THEN 1 ELSE 0 END) AS b4,
         sum(CASE WHEN processing_time_ms / 1000.0 <= 1.0 THEN 1 ELSE 0 END) AS b5,
         sum(CASE WHEN processing_time_ms / 1000.0 <= 2.5 THEN 1 ELSE 0 END) AS b6,
         sum(CASE WHEN processing_time_ms / 1000.0 <= 5.0 THEN 1 ELSE 0 END) AS b7,
         sum(CASE WHEN processing_time_ms / 1000.0 <= 10.0 THEN 1 ELSE 0 END) AS b8
  FROM requests_v)
SELECT le, CAST(n AS BIGINT) AS n, total, sum_s FROM agg,
  (VALUES ('0.01', 0), ('0.05', 1), ('0.1', 2), ('0.25', 3), ('0.5', 4), ('1.0', 5), ('2.5', 6),
          ('5.0', 7), ('10.0', 8), ('+Inf', 9)) AS b(le, i),
  LATERAL (SELECT CASE i WHEN 0 THEN b0 WHEN 1 THEN b1 WHEN 2 THEN b2 WHEN 3 THEN b3 WHEN 4 THEN b4
                         WHEN 5 THEN b5 WHEN 6 THEN b6 WHEN 7 THEN b7 WHEN 8 THEN b8 ELSE total END AS n)""")
def q_latency_histogram(spark, sf):
    return S.latency_histogram(V.requests_v(spark, sf))
