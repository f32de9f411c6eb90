"""Mixed requests (M20, M25, M26, P13, J5) on the factor tables of ``q_factors``.

Every customer is a request: four kinds (hybrid, content, collaborative, similar items),
different n, with and without excluding what the user touched, some with a type or filters.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rankfold import fixed
from rankfold.functions.scalar import out_score
from rankfold.operators import requests as R
from rankfold.plans.models import content_model, interactions
from rankfold.plans.q_content import content_sql_prefix
from rankfold.plans.q_factors import FACTORS_SQL, factors
from rankfold.plans.registry import query
from rankfold.sources import views as V

REQUESTS_SQL = """
rq AS (
  SELECT CAST(c_custkey AS STRING) AS request_id, CASE WHEN c_custkey % 4 < 3 THEN CAST(c_custkey % 150 AS STRING) END AS user_id,
         CASE WHEN c_custkey % 4 = 3 THEN CAST(c_custkey AS STRING) END AS asked_item,
         CASE c_custkey % 4 WHEN 1 THEN 'content_based' WHEN 2 THEN 'collaborative' ELSE 'hybrid' END AS strategy,
         CAST(5 + c_custkey % 7 AS INTEGER) AS n, c_custkey % 5 <> 0 AS exclude_interacted,
         CASE WHEN c_custkey % 3 = 0 THEN 'movie' END AS want_type,
         CASE WHEN c_custkey % 7 = 0 THEN 'Brand#1' END AS want_brand, CASE WHEN c_custkey % 11 = 0 THEN 2005 END AS want_year
  FROM customer)"""


def requests(spark, sf):
    k = F.col("c_custkey")
    brand = F.when(k % 7 == 0, F.lit('"brand":"Brand#1"'))
    year = F.when(k % 11 == 0, F.lit('"year":2005.0'))
    return V.table(spark, sf, "customer").select(
        k.cast("string").alias("request_id"), F.when(k % 4 < 3, (k % 150).cast("string")).alias("user_id"),
        F.when(k % 4 == 3, k.cast("string")).alias("item_id"),
        F.when(k % 4 == 1, "content_based").when(k % 4 == 2, "collaborative").alias("strategy"),
        (5 + k % 7).cast("int").alias("n"), (k % 5 != 0).alias("exclude_interacted"),
        F.when(k % 3 == 0, "movie").alias("item_type"),
        F.when(brand.isNotNull() | year.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", brand, year), F.lit("}"))).alias("filters"))


FINISH_SQL = """
told AS (
  SELECT f.*, r.strategy, i.title, i.item_type, count(*) OVER (PARTITION BY f.request_id) AS total_candidates, i.item_id AS there
  FROM final f JOIN rq r ON r.request_id = f.request_id LEFT JOIN items_v i ON i.item_id = f.item_id
  WHERE (want_type IS NULL AND want_brand IS NULL AND want_year IS NULL)
     OR (i.item_id IS NOT NULL AND (want_type IS NULL OR i.item_type = want_type)
         AND (want_brand IS NULL OR i.category = want_brand) AND (want_year IS NULL OR i.year = want_year)))
SELECT request_id, strategy, CAST(row_number() OVER (PARTITION BY request_id ORDER BY rank) AS INTEGER) AS rank, item_id, title,
       item_type, round(greatest(0.0, least(1.0, score)), 6) AS score, explanation, total_candidates
FROM told WHERE there IS NOT NULL"""

MIXED_SQL = content_sql_prefix() + "," + FACTORS_SQL + "," + REQUESTS_SQL + f""",
mine AS (SELECT r.request_id, i.* EXCLUDE (seq) FROM rq r JOIN interactions_v i ON i.user_id = r.user_id),
liked AS (
  SELECT request_id, item_id, count(*) AS n_likes FROM mine
  WHERE interaction_type IN ('like','purchase','bookmark') OR (interaction_type = 'rating' AND value >= 7) GROUP BY ALL),
touched AS (SELECT DISTINCT m.request_id, m.item_id FROM mine m JOIN rq r ON r.request_id = m.request_id WHERE r.exclude_interacted),
known AS (SELECT * FROM liked WHERE item_id IN (SELECT item_id FROM u)),
den AS (SELECT request_id, sum(n_likes) AS den FROM known GROUP BY request_id),
prof AS (
  SELECT k.request_id, u.f, sum(k.n_likes * u.w) / max(den.den) AS w
  FROM known k JOIN u ON k.item_id = u.item_id JOIN den ON k.request_id = den.request_id GROUP BY k.request_id, u.f),
cscore AS (SELECT p.request_id, u.item_id, sum(p.w * u.w) AS score FROM prof p JOIN u ON p.f = u.f GROUP BY ALL),
gone AS (SELECT request_id, item_id FROM touched UNION SELECT request_id, item_id FROM liked),
cs AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(score, 9) DESC, item_id) AS rank
       FROM cscore s ANTI JOIN gone g ON g.request_id = s.request_id AND g.item_id = s.item_id WHERE round(score, 9) > 0),
rated AS (
  SELECT q.request_id, i.item_id, list_inner_product(x.f, i.f) AS raw, CAST(NULL AS BIGINT) AS place
  FROM rq q JOIN usf x ON x.user_id = q.user_id CROSS JOIN itf i
  UNION ALL
  SELECT q.request_id, p.item_id, p.nv, p.place FROM rq q CROSS JOIN pop p
  WHERE q.user_id IS NOT NULL AND q.user_id NOT IN (SELECT user_id FROM usf)),
kept AS (
  SELECT r.*, row_number() OVER (PARTITION BY request_id
                ORDER BY place NULLS FIRST, CASE WHEN place IS NULL THEN round(raw, 9) END DESC, item_id) AS rank,
         max(raw) OVER (PARTITION BY request_id) AS top
  FROM rated r ANTI JOIN touched t ON t.request_id = r.request_id AND t.item_id = r.item_id),
ks AS (SELECT request_id, item_id, rank, CASE WHEN place IS NULL THEN greatest(0.0, least(1.0, raw))
              WHEN top > 0 THEN raw / top ELSE 0.0 END AS score FROM kept),
lk AS (SELECT request_id, sum(n_likes) AS n FROM liked GROUP BY request_id),
hyb AS (SELECT * FROM rq WHERE strategy = 'hybrid' AND user_id IS NOT NULL),
c3 AS (SELECT c.* FROM cs c JOIN hyb h ON h.request_id = c.request_id WHERE c.rank <= {fixed.BLEND_OVERFETCH} * h.n),
k3 AS (SELECT k.* FROM ks k JOIN hyb h ON h.request_id = k.request_id WHERE k.rank <= {fixed.BLEND_OVERFETCH} * h.n),
both_legs AS (
  SELECT coalesce(c.request_id, k.request_id) AS request_id, coalesce(c.item_id, k.item_id) AS item_id, c.score AS c, k.score AS k,
         coalesce(c.rank, k.rank) AS pos FROM c3 c FULL JOIN k3 k ON c.request_id = k.request_id AND c.item_id = k.item_id),
scored AS (
  SELECT b.*, CASE WHEN c IS NULL THEN 1 ELSE 0 END AS src,
         CASE WHEN coalesce(lk.n, 0) < {fixed.COLD_START_THRESHOLD}
              THEN {fixed.COLD_START_CONTENT_WEIGHT} * coalesce(c, 0.0) + {fixed.COLD_START_COLLAB_WEIGHT} * coalesce(k, 0.0)
              ELSE {fixed.CONTENT_WEIGHT} * coalesce(c, 0.0) + {fixed.COLLAB_WEIGHT} * coalesce(k, 0.0) END AS score,
         CASE WHEN c IS NOT NULL AND k IS NOT NULL THEN '{fixed.EXPLAIN_BOTH}'
              WHEN c IS NOT NULL THEN '{fixed.EXPLAIN_CONTENT}' ELSE '{fixed.EXPLAIN_COLLAB}' END AS explanation
  FROM both_legs b LEFT JOIN lk ON lk.request_id = b.request_id),
blended AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(score, 9) DESC, src, pos) AS rank FROM scored),
asked AS (SELECT request_id, asked_item, n FROM rq WHERE asked_item IS NOT NULL),
cpairs AS (
  SELECT q.request_id, q.n, b.item_id, sum(a.w * b.w) AS score
  FROM asked q JOIN u a ON a.item_id = q.asked_item JOIN u b ON a.f = b.f AND b.item_id <> a.item_id GROUP BY q.request_id, q.n, b.item_id),
cnear AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(score, 9) DESC, item_id) AS rank
          FROM cpairs WHERE round(score, 9) > 0 QUALIFY rank <= {fixed.SIMILAR_OVERFETCH} * n),
unit AS (SELECT item_id, list_transform(f, lambda x: x / sqrt(list_inner_product(f, f))) AS f
         FROM itf WHERE sqrt(list_inner_product(f, f)) > 1e-12),
knear AS (
  SELECT q.request_id, q.n, b.item_id, list_inner_product(a.f, b.f) AS score,
         row_number() OVER (PARTITION BY q.request_id ORDER BY round(list_inner_product(a.f, b.f), 9) DESC, b.item_id) AS rank
  FROM asked q JOIN unit a ON a.item_id = q.asked_item JOIN unit b ON b.item_id <> a.item_id
  WHERE round(list_inner_product(a.f, b.f), 9) > 0 QUALIFY rank <= {fixed.SIMILAR_OVERFETCH} * q.n),
merged AS (
  SELECT request_id, n, item_id, score, 0 AS src, rank AS pos, '{fixed.EXPLAIN_SIMILAR_CONTENT}' AS explanation FROM cnear
  UNION ALL
  SELECT k.request_id, n, item_id, score * {fixed.COLLAB_NEIGHBOUR_DISCOUNT}, 1, rank, '{fixed.EXPLAIN_USERS_ALSO_LIKED}' FROM knear k
  WHERE NOT EXISTS (SELECT 1 FROM cnear c WHERE c.request_id = k.request_id AND c.item_id = k.item_id)),
final AS (
  SELECT b.request_id, rank, item_id, score, explanation FROM blended b JOIN rq r ON r.request_id = b.request_id WHERE rank <= n
  UNION ALL
  SELECT c.request_id, rank, item_id, score, '{fixed.EXPLAIN_CONTENT}' FROM cs c JOIN rq r ON r.request_id = c.request_id
  WHERE rank <= n AND strategy = 'content_based'
  UNION ALL
  SELECT k.request_id, rank, item_id, score, '{fixed.EXPLAIN_COLLAB}' FROM ks k JOIN rq r ON r.request_id = k.request_id
  WHERE rank <= n AND strategy = 'collaborative'
  UNION ALL
  SELECT request_id, row_number() OVER w, item_id, score, explanation FROM merged
  WINDOW w AS (PARTITION BY request_id ORDER BY round(score, 9) DESC, src, pos) QUALIFY row_number() OVER w <= n),""" + FINISH_SQL

FALLBACK_SQL = V.sql_with("items_v", "interactions_v") + "," + REQUESTS_SQL + f""",
newest AS (SELECT item_id, item_type AS t, row_number() OVER (PARTITION BY item_type ORDER BY seq DESC, item_id) AS pos FROM items_v
           UNION ALL SELECT item_id, NULL, row_number() OVER (ORDER BY seq DESC, item_id) FROM items_v),
final AS (
  SELECT r.request_id, row_number() OVER (PARTITION BY r.request_id ORDER BY pos) AS rank, n.item_id, {fixed.FALLBACK_SCORE} AS score,
         '{fixed.EXPLAIN_FALLBACK}' AS explanation
  FROM rq r JOIN newest n ON n.t IS NOT DISTINCT FROM r.want_type AND pos <= r.n
  WHERE NOT EXISTS (SELECT 1 FROM interactions_v i WHERE i.user_id = r.user_id AND i.item_id = n.item_id AND r.exclude_interacted)),""" + FINISH_SQL


def _told(answers):
    return answers.select("request_id", "strategy", "rank", "item_id", "title", "item_type",
                          out_score(F.col("score")).alias("score"), "explanation", "total_candidates")


@query("mixed_requests", sql=MIXED_SQL)
def q_mixed(spark, sf):
    """Requests of all kinds answered by one call."""
    return _told(R.answer(requests(spark, sf), content_model(spark, sf), factors(spark, sf), V.items_v(spark, sf),
                          interactions(spark, sf))[0])


@query("untrained_requests", sql=FALLBACK_SQL)
def q_untrained(spark, sf):
    """The same requests while no model is trained."""
    return _told(R.answer(requests(spark, sf), None, None, V.items_v(spark, sf), interactions(spark, sf))[0])
