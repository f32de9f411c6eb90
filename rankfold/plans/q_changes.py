"""Step 4 queries: import, updates, deletes, user creation, staleness."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankfold.operators import changes as U
from rankfold.plans.models import interactions
from rankfold.plans.registry import query
from rankfold.sources import views as V
from rankfold.sources.files import Dataset
from rankfold.sources.importer import import_dataset

DOC_SEQ_OFFSET = 10 ** 12
STORED_AT = "2024-01-15 00:00:00"


def _empty_store(spark):
    items = spark.createDataFrame([], "item_id string, title string, item_type string, description string, "
                                      "features string, metadata string, is_active boolean, "
                                      "created_at timestamp_ntz, updated_at timestamp_ntz")
    users = spark.createDataFrame([], "user_id string, preferences string, is_active boolean, "
                                      "created_at timestamp_ntz")
    inter = spark.createDataFrame([], "seq long, user_id string, item_id string, interaction_type string, "
                                      "value double, timestamp timestamp_ntz")
    return Dataset(items, users, inter)


@query("import_stats", sql=V.sql_with("items_v", "doc_items_v", "users_v", "interactions_v") + """,
batch AS (SELECT item_id FROM items_v UNION ALL SELECT item_id FROM doc_items_v),
items AS (SELECT DISTINCT item_id FROM batch)
SELECT 'items' AS entity, (SELECT count(*) FROM items) AS imported,
       (SELECT count(*) FROM batch) - (SELECT count(*) FROM items) AS skipped
UNION ALL SELECT 'users', (SELECT count(DISTINCT user_id) FROM users_v),
       (SELECT count(*) - count(DISTINCT user_id) FROM users_v)
UNION ALL SELECT 'interactions',
       (SELECT count(*) FROM interactions_v WHERE item_id IN (SELECT item_id FROM items)),
       (SELECT count(*) FROM interactions_v WHERE item_id NOT IN (SELECT item_id FROM items))
UNION ALL SELECT 'users_auto_created',
       (SELECT count(DISTINCT user_id) FROM interactions_v WHERE user_id NOT IN (SELECT user_id FROM users_v)), 0""")
def q_import_stats(spark, sf):
    """Import part items, then document items (conflicting ids are
    skipped, first wins), customers, and the validated interaction log into an
    empty store."""
    items = V.items_v(spark, sf).select("item_id", "title", "item_type", "description", "features",
                                        "metadata", F.col("item_id").cast("long").alias("seq"))
    docs = V.doc_items_v(spark, sf).select(
        "item_id", "title", "item_type", "description", F.lit("{}").alias("features"),
        F.lit("{}").alias("metadata"), (F.col("item_id").cast("long") + DOC_SEQ_OFFSET).alias("seq"))
    users = V.users_v(spark, sf).select("user_id", "preferences", F.col("user_id").cast("long").alias("seq"))
    batch = Dataset(items.unionByName(docs), users, interactions(spark, sf))
    return import_dataset(_empty_store(spark), batch).stats


@query("apply_item_updates", sql=V.sql_with("items_v") + """,
upd AS (
  SELECT CAST(l_partkey AS STRING) AS item_id, l_orderkey * 8 + l_linenumber AS seq,
         CASE WHEN l_quantity > 45 THEN 'lot ' || CAST(l_orderkey AS STRING) END AS title,
         CASE WHEN l_discount > 0.09 THEN 'flag ' || l_returnflag END AS description
  FROM lineitem),
last AS (
  SELECT item_id, arg_max(title, seq) FILTER (WHERE title IS NOT NULL) AS t,
         arg_max(description, seq) FILTER (WHERE description IS NOT NULL) AS d
  FROM upd GROUP BY item_id)
SELECT i.item_id, coalesce(l.t, i.title) AS title, coalesce(l.d, i.description) AS description
FROM items_v i LEFT JOIN last l ON i.item_id = l.item_id""")
def q_apply_item_updates(spark, sf):
    """U4: every line item is a partial update of its part; applied in
    (order, line) order, the last non-null value per field wins."""
    li = V.table(spark, sf, "lineitem")
    upd = li.select(
        F.col("l_partkey").cast("string").alias("item_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        F.when(F.col("l_quantity") > 45, F.concat(F.lit("lot "), F.col("l_orderkey").cast("string"))).alias("title"),
        F.when(F.col("l_discount") > 0.09, F.concat(F.lit("flag "), F.col("l_returnflag"))).alias("description"))
    items = V.items_v(spark, sf).withColumn("updated_at", F.col("created_at"))
    return U.update_items(items, upd).select("item_id", "title", "description")


@query("soft_delete", sql=V.sql_with("items_v") + """
SELECT item_id, NOT (item_type = 'product' AND rating < 1.0) AS is_active FROM items_v""")
def q_soft_delete(spark, sf):
    """U6 soft: products rated below 1.0 are deactivated."""
    items = V.items_v(spark, sf)
    ids = items.where((F.col("item_type") == "product") & (F.col("rating") < 1.0)).select("item_id")
    out, _ = U.delete_items(items, ids)
    return out.select("item_id", "is_active")


@query("hard_delete_cascade", sql=V.sql_with("items_v", "interactions_v") + """
SELECT seq, user_id, item_id FROM interactions_v
WHERE item_id NOT IN (SELECT item_id FROM items_v WHERE rating < 1.0)""")
def q_hard_delete(spark, sf):
    """U6 hard: items rated below 1.0 removed with their interactions."""
    items = V.items_v(spark, sf)
    ids = items.where(F.col("rating") < 1.0).select("item_id")
    _, inter = U.delete_items(items, ids, interactions(spark, sf), hard=True)
    return inter.select("seq", "user_id", "item_id")


@query("get_or_create_users", sql="""
WITH c AS (SELECT CAST(c_custkey AS STRING) AS user_id FROM customer WHERE c_mktsegment <> 'BUILDING'),
x AS (SELECT DISTINCT CAST(user_id AS STRING) AS user_id FROM events)
SELECT user_id, false AS created FROM c
UNION ALL SELECT user_id, true FROM x WHERE user_id NOT IN (SELECT user_id FROM c)""")
def q_get_or_create(spark, sf):
    """The store holds the non-BUILDING customers; every user of the raw
    interaction log is created if absent (before any item check)."""
    c = V.table(spark, sf, "customer").where(F.col("c_mktsegment") != "BUILDING") \
        .select(F.col("c_custkey").cast("string").alias("user_id"), F.lit("{}").alias("preferences"))
    return U.get_or_create_users(c, V.interactions_raw_v(spark, sf)).select("user_id", "created")


@query("touch_last_active", sql=V.sql_with("users_v", "interactions_v") + """
SELECT u.user_id, m.last AS last_active_at FROM users_v u
LEFT JOIN (SELECT user_id, max(timestamp) AS last FROM interactions_v GROUP BY user_id) m
ON u.user_id = m.user_id""")
def q_touch_last_active(spark, sf):
    """U8."""
    return U.touch_last_active(V.users_v(spark, sf).select("user_id"), interactions(spark, sf)) \
        .select("user_id", "last_active_at")


@query("stale_users", sql=V.sql_with("interactions_v") + f"""
SELECT DISTINCT user_id FROM interactions_v WHERE timestamp > TIMESTAMP '{STORED_AT}'""")
def q_stale_users(spark, sf):
    """Results stored for every interacting user at STORED_AT go
    stale for users with a later interaction."""
    inter = interactions(spark, sf)
    stored = inter.select("user_id").distinct().withColumn(
        "computed_at", F.lit(STORED_AT).cast("timestamp_ntz"))
    return U.stale_users(stored, inter)
