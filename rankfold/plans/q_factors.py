"""Serving queries on given factor tables.

The serving operators take any factor tables. Here both come from ``embeddings``:
every vector is the factor row of item ``vec_id`` (scaled by its label, so that
norms differ) and of user ``2 * vec_id``. Users are all customers and all users of
the log, so odd ids are cold-start users, many of them with touched items. With
the factors given, SQL states every result.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rankfold import fixed
from rankfold.functions.scalar import out_score
from rankfold.operators import blend as B
from rankfold.operators import collab as K
from rankfold.operators import strength
from rankfold.plans.models import content_model, interactions
from rankfold.plans.q_content import CONTENT_RECS_SQL, content_sql_prefix
from rankfold.plans.q_ingest import STRENGTH_SQL
from rankfold.plans.registry import query
from rankfold.sources import views as V

N = 10
SERVED = 50
FILTERS = {"brand": "Brand#1"}


def factors(spark, sf) -> K.CollabModel:
    """Embeddings as a collaborative model; the mean is that of the folded log."""
    e = V.table(spark, sf, "embeddings").where("vec_id is not null and embedding is not null") \
        .select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    scale = F.lit(1.0) + F.coalesce(F.col("label"), F.lit(0)) / F.lit(100.0)
    items = e.select(F.col("vec_id").cast("string").alias("item_id"),
                     F.transform("v", lambda x: x * scale).alias("f"))
    users = e.select((F.col("vec_id") * 2).cast("string").alias("user_id"), F.col("v").alias("f"))
    mean = strength.strength_fold(interactions(spark, sf)).where("strength > 0").agg(F.avg("strength")).first()[0]
    n = e.count()
    return K.CollabModel(users, items, 0, float(mean or 0.0), {"num_users": n, "num_items": n})


def users(spark, sf):
    return V.users_v(spark, sf).select("user_id").union(interactions(spark, sf).select("user_id")).distinct()


FACTORS_SQL = """
e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, 1.0 + coalesce(label, 0) / CAST(100 AS DOUBLE) AS m FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
itf AS (SELECT CAST(vec_id AS STRING) AS item_id, list_transform(v, lambda x: x * m) AS f FROM e),
usf AS (SELECT CAST(2 * vec_id AS STRING) AS user_id, v AS f FROM e),
pop AS (SELECT item_id, sqrt(list_inner_product(f, f)) AS nv,
               row_number() OVER (ORDER BY round(sqrt(list_inner_product(f, f)), 9) DESC, item_id) AS place FROM itf)"""


def recommend_sql(n: int) -> str:
    """CTEs ``everyone`` and ``ks``: top n of every user, known or cold."""
    return FACTORS_SQL + f""",
everyone AS (SELECT user_id FROM users_v UNION SELECT user_id FROM interactions_v),
touched AS (SELECT DISTINCT user_id, item_id FROM interactions_v),
rated AS (
  SELECT q.user_id, i.item_id, list_inner_product(u2.f, i.f) AS raw, CAST(NULL AS BIGINT) AS place
  FROM everyone q JOIN usf u2 ON u2.user_id = q.user_id CROSS JOIN itf i
  UNION ALL
  SELECT q.user_id, p.item_id, p.nv, p.place FROM everyone q CROSS JOIN pop p
  WHERE q.user_id NOT IN (SELECT user_id FROM usf)),
left_over AS (
  SELECT r.*, row_number() OVER (PARTITION BY user_id
                ORDER BY place NULLS FIRST, CASE WHEN place IS NULL THEN round(raw, 9) END DESC, item_id) AS rank,
         max(raw) OVER (PARTITION BY user_id) AS top
  FROM rated r ANTI JOIN touched t ON t.user_id = r.user_id AND t.item_id = r.item_id),
ks AS (
  SELECT user_id, rank, item_id,
         CASE WHEN place IS NULL THEN greatest(0.0, least(1.0, raw)) WHEN top > 0 THEN raw / top ELSE 0.0 END AS score
  FROM left_over WHERE rank <= {n})"""


RECOMMEND_SQL = V.sql_with("users_v", "interactions_v") + "," + recommend_sql(N)


def similar_sql(table: str, key: str, n: int) -> str:
    """CTEs ``unit`` and ``near``: cosine neighbours of the rows of a factor table."""
    return f"""
unit AS (SELECT {key} AS id, list_transform(f, lambda x: x / sqrt(list_inner_product(f, f))) AS f
         FROM {table} WHERE sqrt(list_inner_product(f, f)) > 1e-12),
cosines AS (SELECT a.id, b.id AS other_id, list_inner_product(a.f, b.f) AS score FROM unit a JOIN unit b ON a.id <> b.id),
near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, other_id) AS rank
         FROM cosines WHERE round(score, 9) > 0 QUALIFY rank <= {n})"""


@query("factor_ratings", sql=V.sql_with("interactions_v") + "," + FACTORS_SQL + f""",
folded AS ({STRENGTH_SQL}),
mean AS (SELECT avg(strength) FILTER (WHERE strength > 0) AS m FROM folded)
SELECT p.user_id, p.item_id,
       round(CASE WHEN u.f IS NULL OR i.f IS NULL THEN mean.m
             ELSE greatest(0.0, least(1.0, list_inner_product(u.f, i.f))) END, 6) AS prediction
FROM (SELECT DISTINCT user_id, item_id FROM interactions_v) p CROSS JOIN mean
LEFT JOIN usf u ON u.user_id = p.user_id LEFT JOIN itf i ON i.item_id = p.item_id""")
def q_ratings(spark, sf):
    """Predictions of all touched pairs; the mean for cold users."""
    pairs = strength.touched_items(interactions(spark, sf))
    return K.predict_rating(factors(spark, sf), pairs).select(
        "user_id", "item_id", out_score(F.col("prediction")).alias("prediction"))


@query("factor_popular_items", sql="WITH" + FACTORS_SQL + f"""
SELECT CAST(place AS INTEGER) AS rank, item_id, round(nv / max(nv) OVER (), 6) AS score FROM pop WHERE place <= {N}""")
def q_popular(spark, sf):
    """Popular items by factor norm."""
    return K.popular_items(factors(spark, sf), N).select("rank", "item_id", out_score(F.col("score")).alias("score"))


@query("factor_recommendations", sql=RECOMMEND_SQL + """
SELECT user_id, CAST(rank AS INTEGER) AS rank, item_id, round(score, 6) AS score FROM ks""")
def q_recommendations(spark, sf):
    """All users, cold ones with their touched items left out too."""
    r = K.recommend(factors(spark, sf), users(spark, sf), strength.touched_items(interactions(spark, sf)), N)
    return r.select("user_id", "rank", "item_id", out_score(F.col("score")).alias("score"))


@query("factor_strategy_recommendations", sql=RECOMMEND_SQL + f"""
SELECT user_id, CAST(rank AS INTEGER) AS rank, item_id, round(score, 6) AS score,
       '{fixed.EXPLAIN_COLLAB}' AS explanation FROM ks""")
def q_strategy(spark, sf):
    """The collaborative strategy through dispatch."""
    r = B.dispatch(None, factors(spark, sf), N, "collaborative", users=users(spark, sf),
                   exclude=strength.touched_items(interactions(spark, sf)))
    return r.select("user_id", "rank", "item_id", out_score(F.col("score")).alias("score"), "explanation")


@query("factor_similar_users", sql="WITH" + FACTORS_SQL + "," + similar_sql("usf", "user_id", N) + """
SELECT id AS user_id, CAST(rank AS INTEGER) AS rank, other_id, round(score, 6) AS score FROM near""")
def q_similar_users(spark, sf):
    """M17."""
    return K.similar(factors(spark, sf).user_factors, "user_id", N).select(
        "user_id", "rank", "other_id", out_score(F.col("score")).alias("score"))


@query("factor_similar_items", sql="WITH" + FACTORS_SQL + "," + similar_sql("itf", "item_id", N) + """
SELECT id AS item_id, CAST(rank AS INTEGER) AS rank, other_id, round(score, 6) AS score FROM near""")
def q_similar_items(spark, sf):
    """M18."""
    return K.similar(factors(spark, sf).item_factors, "item_id", N).select(
        "item_id", "rank", "other_id", out_score(F.col("score")).alias("score"))


@query("factor_similar_hybrid", sql=content_sql_prefix() + "," + FACTORS_SQL + ","
       + similar_sql("itf", "item_id", fixed.SIMILAR_OVERFETCH * N) + f""",
pairs AS (
  SELECT a.item_id, b.item_id AS other_id, sum(a.w * b.w) AS score
  FROM u a JOIN u b ON a.f = b.f AND a.item_id <> b.item_id GROUP BY a.item_id, b.item_id),
cnear AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, other_id) AS rank
  FROM pairs WHERE round(score, 9) > 0 QUALIFY rank <= {fixed.SIMILAR_OVERFETCH * N}),
merged AS (
  SELECT item_id, other_id, score, 0 AS src, rank AS pos, '{fixed.EXPLAIN_SIMILAR_CONTENT}' AS explanation FROM cnear
  UNION ALL
  SELECT id, other_id, score * {fixed.COLLAB_NEIGHBOUR_DISCOUNT}, 1, rank, '{fixed.EXPLAIN_USERS_ALSO_LIKED}' FROM near
  WHERE NOT EXISTS (SELECT 1 FROM cnear c WHERE c.item_id = near.id AND c.other_id = near.other_id))
SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id, round(score, 6) AS score, explanation
FROM merged WINDOW w AS (PARTITION BY item_id ORDER BY round(score, 9) DESC, src, pos)
QUALIFY row_number() OVER w <= {N}""")
def q_similar_hybrid(spark, sf):
    """Content and factor neighbours merged."""
    r = B.similar_items(content_model(spark, sf), factors(spark, sf), N)
    return r.select("item_id", "rank", "other_id", out_score(F.col("score")).alias("score"), "explanation")


def hybrid_sql(n: int) -> str:
    """CTE ``blended``: the weighted blend of both sources for every user."""
    m = fixed.BLEND_OVERFETCH * n
    views, rest = V.sql_with("items_v", "interactions_v"), V.sql_with("items_v", "interactions_v", "users_v")
    content = CONTENT_RECS_SQL.replace(views, rest, 1).rsplit("\nSELECT user_id, CAST(rank", 1)[0]
    return content + "," + recommend_sql(m) + f""",
cs AS (SELECT user_id, item_id, score, rank FROM ranked WHERE rank <= {m}),
lk AS (SELECT user_id, sum(n_likes) AS n FROM liked GROUP BY user_id),
both_legs AS (
  SELECT coalesce(cs.user_id, ks.user_id) AS user_id, coalesce(cs.item_id, ks.item_id) AS item_id,
         cs.score AS c, ks.score AS k, coalesce(cs.rank, ks.rank) AS pos
  FROM cs FULL JOIN ks ON cs.user_id = ks.user_id AND cs.item_id = ks.item_id),
scored AS (
  SELECT b.user_id, b.item_id, pos, CASE WHEN c IS NULL THEN 1 ELSE 0 END AS src,
         CASE WHEN coalesce(lk.n, 0) < {fixed.COLD_START_THRESHOLD}
              THEN {fixed.COLD_START_CONTENT_WEIGHT} * coalesce(c, 0.0) + {fixed.COLD_START_COLLAB_WEIGHT} * coalesce(k, 0.0)
              ELSE {fixed.CONTENT_WEIGHT} * coalesce(c, 0.0) + {fixed.COLLAB_WEIGHT} * coalesce(k, 0.0) END AS score,
         CASE WHEN c IS NOT NULL AND k IS NOT NULL THEN '{fixed.EXPLAIN_BOTH}'
              WHEN c IS NOT NULL THEN '{fixed.EXPLAIN_CONTENT}' ELSE '{fixed.EXPLAIN_COLLAB}' END AS explanation
  FROM both_legs b LEFT JOIN lk ON lk.user_id = b.user_id),
blended AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, src, pos) AS rank, item_id,
         score, explanation
  FROM scored QUALIFY rank <= {n})"""


def hybrid(spark, sf, n):
    inter = interactions(spark, sf)
    return B.recommend_hybrid(content_model(spark, sf), factors(spark, sf), users(spark, sf),
                              strength.liked_items(inter), strength.touched_items(inter), n)


@query("factor_hybrid_recommendations", sql=hybrid_sql(N) + """
SELECT user_id, CAST(rank AS INTEGER) AS rank, item_id, round(score, 6) AS score, explanation FROM blended""")
def q_hybrid(spark, sf):
    """The blend for all users, cold ones included."""
    return hybrid(spark, sf, N).select("user_id", "rank", "item_id", out_score(F.col("score")).alias("score"),
                                       "explanation")


@query("factor_filtered_recommendations", sql=hybrid_sql(SERVED) + f""",
passed AS (
  SELECT b.*, i.title, i.item_type, count(*) OVER (PARTITION BY user_id) AS total_candidates
  FROM blended b JOIN items_v i ON i.item_id = b.item_id
  WHERE i.item_type = 'movie' AND i.category = '{FILTERS["brand"]}')
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY rank) AS INTEGER) AS rank, item_id, title,
       item_type, round(greatest(0.0, least(1.0, score)), 6) AS score, explanation, total_candidates FROM passed""")
def q_filtered(spark, sf):
    """Blend, then a type and a metadata filter, counted and enriched."""
    s = B.serve(hybrid(spark, sf, SERVED), V.items_v(spark, sf), SERVED, item_type="movie", filters=FILTERS)
    return s.select("user_id", "rank", "item_id", "title", "item_type", out_score(F.col("score")).alias("score"),
                    "explanation", "total_candidates")
