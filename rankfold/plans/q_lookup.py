"""Step 2 queries: lookups, pages, histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankfold.operators import lookup as L
from rankfold.plans.models import interactions
from rankfold.plans.registry import query
from rankfold.sources import views as V


@query("items_by_ids", sql=V.sql_with("items_v") + """
SELECT l_orderkey AS request_id, l_linenumber AS pos, i.item_id, i.title
FROM lineitem l JOIN items_v i ON CAST(l.l_partkey AS STRING) = i.item_id""")
def q_items_by_ids(spark, sf):
    """Every order is a request for its line items' parts, in line order,
    repeats kept, unknown ids skipped."""
    req = V.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("pos"),
        F.col("l_partkey").cast("string").alias("item_id"))
    return L.by_ids(V.items_v(spark, sf).select("item_id", "title"), "item_id", req) \
        .select("request_id", "pos", "item_id", "title")


@query("items_page", sql=V.sql_with("items_v") + """
SELECT item_id, title FROM items_v WHERE item_type = 'book'
ORDER BY seq DESC, item_id LIMIT 50 OFFSET 20""")
def q_items_page(spark, sf):
    """Type filter, newest first, offset 20, limit 50."""
    return L.page(V.items_v(spark, sf), [F.col("created_at").desc(), F.col("item_id")],
                  offset=20, limit=50, where=F.col("item_type") == "book").select("item_id", "title")


@query("items_of_type", sql=V.sql_with("items_v") + """
SELECT item_id, title, item_type FROM items_v WHERE item_type IN ('movie', 'song')""")
def q_items_of_type(spark, sf):
    return V.items_v(spark, sf).where(F.col("item_type").isin("movie", "song")) \
        .select("item_id", "title", "item_type")


@query("users_page", sql=V.sql_with("users_v") + """
SELECT user_id, (SELECT count(*) FROM users_v) AS total FROM users_v
ORDER BY CAST(user_id AS BIGINT) LIMIT 50 OFFSET 100""")
def q_users_page(spark, sf):
    """P5: insertion order (customer key), page of 50 after 100, with the total."""
    users = V.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("seq"), F.col("c_custkey").cast("string").alias("user_id"))
    total = users.count()
    return L.page(users, [F.col("seq")], offset=100, limit=50) \
        .select("user_id", F.lit(total).cast("long").alias("total"))


@query("user_history", sql=V.sql_with("interactions_v") + """,
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, seq DESC) AS rn
      FROM interactions_v WHERE interaction_type IN ('like', 'purchase', 'bookmark'))
SELECT user_id, CAST(rn AS INTEGER) AS rn, seq, item_id, interaction_type FROM r WHERE rn <= 20""")
def q_user_history(spark, sf):
    """Newest 20 positive interactions of every user."""
    x = L.user_interactions(interactions(spark, sf), ["like", "purchase", "bookmark"])
    return L.newest_per_key(x, "user_id", 20).select("user_id", "rn", "seq", "item_id", "interaction_type")


@query("item_history", sql=V.sql_with("interactions_v") + """
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY timestamp DESC, seq DESC) AS INTEGER) AS rn,
       seq, user_id FROM interactions_v""")
def q_item_history(spark, sf):
    """Every item's interactions, newest first."""
    x = interactions(spark, sf).select("item_id", "timestamp", "seq", "user_id")
    return L.full_history(x, "item_id").select("item_id", F.col("rn").cast("int").alias("rn"), "seq", "user_id")


@query("item_exists", sql=V.sql_with("items_v", "interactions_raw_v") + """
SELECT DISTINCT item_id FROM interactions_raw_v WHERE item_id IN (SELECT item_id FROM items_v)""")
def q_item_exists(spark, sf):
    """Requested ids (raw interaction item ids) that exist."""
    req = V.interactions_raw_v(spark, sf).select("item_id").distinct()
    return L.exists(V.items_v(spark, sf), "item_id", req)


@query("user_item_ids", sql=V.sql_with("interactions_v") + """
SELECT user_id, count(DISTINCT item_id) AS n_items FROM interactions_v GROUP BY user_id""")
def q_user_item_ids(spark, sf):
    """P8 summarised per user: number of distinct items touched."""
    return interactions(spark, sf).select("user_id", "item_id").distinct() \
        .groupBy("user_id").agg(F.count(F.lit(1)).alias("n_items"))


@query("item_records", sql=V.sql_with("items_v") + """
SELECT item_id, title, item_type, description FROM items_v""")
def q_item_records(spark, sf):
    """Record projection (JSON defaults)."""
    return L.item_records(V.items_v(spark, sf)).select("item_id", "title", "item_type", "description")
