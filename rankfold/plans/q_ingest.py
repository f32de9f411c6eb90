"""Step 1 queries: validation, strength fold, liked and touched items."""

from __future__ import annotations

from rankfold.operators import strength, validate
from rankfold.plans.models import interactions
from rankfold.plans.registry import query
from rankfold.sources import views as V

W_CASE = ("CASE interaction_type WHEN 'view' THEN 0.1 WHEN 'click' THEN 0.2 WHEN 'like' THEN 0.7 "
          "WHEN 'dislike' THEN -0.5 WHEN 'purchase' THEN 1.0 WHEN 'rating' THEN 1.0 "
          "WHEN 'bookmark' THEN 0.5 ELSE 0.1 END")


@query("valid_interactions", sql=V.sql_with("interactions_v") + """
SELECT seq, user_id, item_id, interaction_type, value FROM interactions_v""")
def q_valid(spark, sf):
    return interactions(spark, sf).select("seq", "user_id", "item_id", "interaction_type", "value")


@query("rejected_interactions", sql=V.sql_with("interactions_raw_v") + """
SELECT seq, user_id, item_id, interaction_type, value,
       CASE WHEN coalesce(length(user_id) BETWEEN 1 AND 100, false) = false THEN 'user_id length'
            WHEN coalesce(length(item_id) BETWEEN 1 AND 100, false) = false THEN 'item_id length'
            WHEN coalesce(interaction_type IN ('view','click','like','dislike','purchase','rating','bookmark'), false) = false
                 THEN 'interaction_type'
            WHEN NOT (value IS NULL OR (value >= 0 AND value <= 10)) THEN 'value range'
            ELSE 'rating needs value' END AS reason
FROM interactions_raw_v
WHERE NOT (coalesce(length(user_id) BETWEEN 1 AND 100, false)
       AND coalesce(length(item_id) BETWEEN 1 AND 100, false)
       AND coalesce(interaction_type IN ('view','click','like','dislike','purchase','rating','bookmark'), false)
       AND (value IS NULL OR (value >= 0 AND value <= 10))
       AND NOT (interaction_type = 'rating' AND value IS NULL))""")
def q_rejected(spark, sf):
    return (validate.rejected_interactions(V.interactions_raw_v(spark, sf))
            .select("seq", "user_id", "item_id", "interaction_type", "value", "reason"))


STRENGTH_SQL = V.sql_with("interactions_v") + f""",
marked AS (
  SELECT *, (interaction_type = 'rating' AND value IS NOT NULL) AS is_r,
         max(CASE WHEN interaction_type = 'rating' AND value IS NOT NULL THEN seq END)
           OVER (PARTITION BY user_id, item_id) AS lr
  FROM interactions_v)
SELECT user_id, item_id,
       greatest(coalesce(max(CASE WHEN seq = lr THEN value / 10.0 END), 0.0),
                coalesce(max(CASE WHEN NOT is_r AND (lr IS NULL OR seq > lr) THEN {W_CASE} END), 0.0))
         AS strength
FROM marked GROUP BY user_id, item_id"""


@query("strength_fold", sql=STRENGTH_SQL, bench=True)
def q_strength(spark, sf):
    return strength.strength_fold(interactions(spark, sf))


@query("liked_items", sql=V.sql_with("interactions_v") + """
SELECT user_id, item_id, count(*) AS n_likes FROM interactions_v
WHERE interaction_type IN ('like','purchase','bookmark') OR (interaction_type = 'rating' AND value >= 7)
GROUP BY user_id, item_id""")
def q_liked(spark, sf):
    return strength.liked_items(interactions(spark, sf))


@query("touched_items", sql=V.sql_with("interactions_v") + """
SELECT DISTINCT user_id, item_id FROM interactions_v""")
def q_touched(spark, sf):
    return strength.touched_items(interactions(spark, sf))


@query("strength_fold_known", sql=V.sql_with("interactions_v", "items_v", "users_v") + f""",
known AS (SELECT * FROM interactions_v WHERE item_id IN (SELECT item_id FROM items_v)
          AND user_id IN (SELECT user_id FROM users_v)),
marked AS (
  SELECT *, (interaction_type = 'rating' AND value IS NOT NULL) AS is_r,
         max(CASE WHEN interaction_type = 'rating' AND value IS NOT NULL THEN seq END)
           OVER (PARTITION BY user_id, item_id) AS lr
  FROM known)
SELECT user_id, item_id,
       greatest(coalesce(max(CASE WHEN seq = lr THEN value / 10.0 END), 0.0),
                coalesce(max(CASE WHEN NOT is_r AND (lr IS NULL OR seq > lr) THEN {W_CASE} END), 0.0))
         AS strength
FROM marked GROUP BY user_id, item_id""")
def q_strength_known(spark, sf):
    """A1: fold restricted to users and items known to the store."""
    return strength.strength_fold(interactions(spark, sf), items=V.items_v(spark, sf),
                                  users=V.users_v(spark, sf))
