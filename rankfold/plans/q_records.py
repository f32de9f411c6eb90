"""Validation, records, histories, artifacts and stored results (V1, V2, P3, P4, P10, P14,
P15, P17, U5, U9, U10, W5, A5, A15). Broken rows are made from the tables by rules that
the SQL states too."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankfold.operators import changes as U
from rankfold.operators import lookup as L
from rankfold.operators import stats as S
from rankfold.operators import stored, validate
from rankfold.plans.models import interactions
from rankfold.plans.registry import query
from rankfold.sources import store
from rankfold.sources import views as V

NOW = "2024-02-01 00:00:00"


def _some_broken(spark, sf):
    """V1 input: every item row with an own defect now and then."""
    k = F.col("item_id").cast("long")
    i = V.items_v(spark, sf)
    return i.select(
        F.when(k % 29 == 0, F.repeat(F.lit("x"), 101)).otherwise(F.col("item_id")).alias("item_id"), k.alias("seq"),
        F.when(k % 5 == 0, F.lit("")).otherwise(F.col("title")).alias("title"),
        F.when(k % 7 == 0, F.lit("gadget")).otherwise(F.col("item_type")).alias("item_type"),
        F.when(k % 13 == 0, F.repeat(F.lit("d"), 5001)).when(k % 17 != 0, F.col("description")).alias("description"),
        F.when(k % 11 == 0, F.lit("[1]")).otherwise(F.col("features")).alias("features"),
        F.when(k % 19 == 0, F.lit("{")).when(k % 23 != 0, F.col("metadata")).alias("metadata"))


REASON_SQL = """
SELECT p_partkey AS seq, CASE WHEN p_partkey % 29 = 0 THEN 'item_id length' WHEN p_partkey % 5 = 0 THEN 'title length'
  WHEN p_partkey % 7 = 0 THEN 'item_type' WHEN p_partkey % 13 = 0 THEN 'description length'
  WHEN p_partkey % 11 = 0 THEN 'features object' WHEN p_partkey % 19 = 0 OR p_partkey % 23 = 0 THEN 'metadata object' END AS reason
FROM part"""


@query("valid_items", sql=f"SELECT seq FROM ({REASON_SQL}) WHERE reason IS NULL")
def q_valid_items(spark, sf):
    """V1."""
    return validate.split(_some_broken(spark, sf), validate.item_rules())[0].select("seq")


@query("rejected_items", sql=f"SELECT seq, reason FROM ({REASON_SQL}) WHERE reason IS NOT NULL")
def q_rejected_items(spark, sf):
    """V1: the first rule that fails."""
    return validate.split(_some_broken(spark, sf), validate.item_rules())[1].select("seq", "reason")


@query("checked_users", sql="""
SELECT c_custkey AS seq, CASE WHEN c_custkey % 9 = 0 THEN 'user_id length'
  WHEN c_custkey % 4 = 0 OR c_custkey % 7 = 0 THEN 'preferences object' END AS reason FROM customer""")
def q_checked_users(spark, sf):
    """V2: accepted users without, rejected ones with a reason."""
    k = F.col("user_id").cast("long")
    u = V.users_v(spark, sf).select(
        F.when(k % 9 == 0, F.lit("")).otherwise(F.col("user_id")).alias("user_id"), k.alias("seq"),
        F.when(k % 4 == 0, F.lit("[]")).when(k % 7 != 0, F.col("preferences")).alias("preferences"))
    good, bad = validate.split(u, validate.user_rules())
    return good.select("seq", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("seq", "reason"))


@query("users_by_ids", sql=V.sql_with("users_v") + """
SELECT o_orderkey AS request_id, u.user_id FROM orders JOIN users_v u ON u.user_id = CAST(o_custkey AS STRING)""")
def q_users_by_ids(spark, sf):
    """The user of every order."""
    req = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").cast("string").alias("user_id"))
    return L.by_ids(V.users_v(spark, sf), "user_id", req).select("request_id", "user_id")


def _flagged(spark, sf):
    return V.items_v(spark, sf).withColumn("is_active", F.when(F.col("item_id").cast("long") % 10 != 0, F.col("item_id").cast("long") % 6 != 0))


@query("active_items", sql="SELECT CAST(p_partkey AS STRING) AS item_id FROM part WHERE p_partkey % 10 = 0 OR p_partkey % 6 <> 0")
def q_active_items(spark, sf):
    """P10: inactive items hidden; those without a flag count as active."""
    return L.active(_flagged(spark, sf)).select("item_id")


PAGE_SQL = "SELECT CAST(p_partkey AS STRING) AS item_id FROM part {0} ORDER BY p_partkey DESC LIMIT 40 OFFSET 10"


@query("active_items_page", sql=PAGE_SQL.format("WHERE p_partkey % 10 = 0 OR p_partkey % 6 <> 0"))
def q_active_page(spark, sf):
    """A page of active items."""
    return L.page(_flagged(spark, sf), [F.col("created_at").desc()], offset=10, limit=40).select("item_id")


@query("all_items_page", sql=PAGE_SQL.format(""))
def q_all_page(spark, sf):
    """P3 with include_inactive."""
    return L.page(_flagged(spark, sf), [F.col("created_at").desc()], offset=10, limit=40, include_inactive=True).select("item_id")


@query("log_history", sql=V.sql_with("requests_v") + """
SELECT client_id AS user_id, request_id, CAST(row_number() OVER (PARTITION BY client_id ORDER BY ts DESC, request_id DESC) AS INTEGER) AS rn
FROM requests_v QUALIFY rn <= 20""")
def q_log_history(spark, sf):
    """The newest 20 log rows of every user."""
    logs = V.requests_v(spark, sf).select(F.col("client_id").alias("user_id"), "request_id", F.col("ts").alias("created_at"))
    return store.history(logs, 20).select("user_id", "request_id", "rn")


@query("item_json_records", sql=V.sql_with("items_v") + """
SELECT item_id, title, CASE WHEN CAST(item_id AS BIGINT) % 10 = 0 THEN '{}'
         ELSE '{"category":"' || category || '","year":' || year || ',"rating":' || rating || '}' END AS features,
       CASE WHEN CAST(item_id AS BIGINT) % 4 = 0 THEN '{}' ELSE '{"brand":"' || category || '"}' END AS metadata FROM items_v""")
def q_item_json_records(spark, sf):
    """Item records with their JSON columns, null ones as {}."""
    k = F.col("item_id").cast("long")
    i = V.items_v(spark, sf).withColumn("features", F.when(k % 10 != 0, F.col("features"))) \
        .withColumn("metadata", F.when(k % 4 != 0, F.col("metadata")))
    return L.item_records(i).select("item_id", "title", "features", "metadata")


@query("user_records", sql="""
SELECT CAST(c_custkey AS STRING) AS user_id, CASE WHEN c_custkey % 3 = 0 THEN '{}' ELSE '{"segment":"' || c_mktsegment || '"}' END AS preferences
FROM customer""")
def q_user_records(spark, sf):
    """User records."""
    u = V.users_v(spark, sf).withColumn("preferences", F.when(F.col("user_id").cast("long") % 3 != 0, F.col("preferences")))
    return L.user_records(u).select("user_id", "preferences")


@query("interaction_records", sql=V.sql_with("interactions_v") + """
SELECT seq, user_id, item_id, interaction_type, value, '{}' AS context FROM interactions_v""")
def q_interaction_records(spark, sf):
    """Interaction records; the log has no context, so it reads as {}."""
    x = interactions(spark, sf).withColumn("context", F.lit(None).cast("string"))
    return L.interaction_records(x).select("seq", "user_id", "item_id", "interaction_type", "value", "context")


def _artifacts(spark, sf):
    k = F.col("s_suppkey")
    return V.table(spark, sf, "supplier").select(
        F.concat(F.lit("model_"), F.col("s_nationkey").cast("string")).alias("model_name"), k.cast("string").alias("model_version"),
        F.when(k % 2 == 0, "content").otherwise("collaborative").alias("model_type"),
        F.when(k % 5 != 0, F.concat(F.lit('{"k":'), k.cast("string"), F.lit("}"))).alias("hyperparameters"),
        F.lit(None).cast("string").alias("metrics"), (k % 3 == 0).alias("is_active"),
        F.when(k % 7 == 0, "error").otherwise("success").alias("status"))


@query("artifact_records", sql="""
SELECT 'model_' || s_nationkey AS model_name, CAST(s_suppkey AS STRING) AS model_version,
  CASE WHEN s_suppkey % 5 = 0 THEN '{}' ELSE '{"k":' || s_suppkey || '}' END AS hyperparameters, '{}' AS metrics FROM supplier""")
def q_artifact_records(spark, sf):
    """Artifact records."""
    return L.artifact_records(_artifacts(spark, sf)).select("model_name", "model_version", "hyperparameters", "metrics")


@query("activated_models", sql="""
WITH v AS (SELECT s_nationkey, max(s_suppkey) AS m FROM supplier WHERE s_nationkey IN (1, 3) GROUP BY s_nationkey)
SELECT 'model_' || s.s_nationkey AS model_name, CAST(s_suppkey AS STRING) AS model_version,
  CASE WHEN s.s_nationkey = 3 THEN s_suppkey = v.m WHEN s.s_nationkey = 1 THEN false ELSE s_suppkey % 3 = 0 END AS is_active
FROM supplier s LEFT JOIN v ON v.s_nationkey = s.s_nationkey""")
def q_activated(spark, sf):
    """The newest version of model_3 activated, an unknown version of model_1 asked for."""
    a = _artifacts(spark, sf)
    newest = a.where("model_name = 'model_3'").agg(F.max(F.col("model_version").cast("long")).cast("string")).first()[0]
    a = U.activate_model(a, "model_3", newest) if newest is not None else a
    return U.activate_model(a, "model_1", "none").select("model_name", "model_version", "is_active")


@query("active_artifacts", sql="""
SELECT CAST(s_suppkey AS STRING) AS model_version FROM supplier WHERE s_nationkey = 2 AND s_suppkey % 3 = 0""")
def q_active_artifacts(spark, sf):
    """The active versions of a model."""
    return store.active_model(_artifacts(spark, sf), "model_2").select("model_version")


@query("training_runs", sql="""
SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'content' ELSE 'collaborative' END AS model_type,
  CASE WHEN s_suppkey % 7 = 0 THEN 'error' ELSE 'success' END AS status, count(*) AS n FROM supplier GROUP BY ALL""")
def q_training_runs(spark, sf):
    """Training runs by model type and status."""
    return S.training_counters(_artifacts(spark, sf))


@query("request_counters_by_method", sql=V.sql_with("requests_v") + """
SELECT endpoint, CASE WHEN endpoint IN ('view', 'click') THEN 'GET' ELSE 'POST' END AS method, status, count(*) AS n
FROM requests_v GROUP BY ALL""")
def q_request_methods(spark, sf):
    """Requests by endpoint, method and status."""
    r = V.requests_v(spark, sf).withColumn("method", F.when(F.col("endpoint").isin("view", "click"), "GET").otherwise("POST"))
    return S.request_counters(r)


@query("interactions_per_pair", sql=V.sql_with("interactions_v") + """
SELECT user_id, item_id, count(*) AS n FROM interactions_v GROUP BY GROUPING SETS ((item_id), (user_id, item_id))""")
def q_per_pair(spark, sf):
    """A5 by item (user null) and by both."""
    x = interactions(spark, sf)
    return S.interaction_count(x, ["item_id"]).select(F.lit(None).cast("string").alias("user_id"), "item_id", "n") \
        .unionByName(S.interaction_count(x, ["user_id", "item_id"]).select("user_id", "item_id", "n"))


@query("soft_delete_keeps_log", sql=V.sql_with("items_v", "interactions_v") + """
SELECT x.item_id, count(*) AS n, bool_or(coalesce(i.rating < 1.0, false)) AS gone
FROM interactions_v x LEFT JOIN items_v i ON i.item_id = x.item_id GROUP BY x.item_id""")
def q_soft_keeps(spark, sf):
    """Soft-deleted items keep their interactions."""
    items = V.items_v(spark, sf)
    after, log = U.delete_items(items, items.where("rating < 1.0").select("item_id"), interactions(spark, sf))
    flags = after.select("item_id", (~F.col("is_active")).alias("gone"))
    return log.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).join(flags, "item_id", "left") \
        .select("item_id", "n", F.coalesce("gone", F.lit(False)).alias("gone"))


STORED_SQL = f"""
s AS (
  SELECT o_orderkey AS result_key, CAST(o_custkey % 300 AS STRING) AS user_id,
         CASE o_orderkey % 3 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'content_based' ELSE 'collaborative' END AS strategy,
         TIMESTAMP '2024-01-01' + to_hours(CAST(o_orderkey % 720 AS INTEGER)) AS computed_at,
         TIMESTAMP '2024-01-01' + to_hours(CAST(o_orderkey % 720 + 700 AS INTEGER)) AS expires_at FROM orders),
shown AS (SELECT DISTINCT l_orderkey AS result_key, CAST(l_partkey AS STRING) AS item_id FROM lineitem),
moved AS (SELECT CAST(p_partkey AS STRING) AS item_id, TIMESTAMP '2024-01-01' + to_hours(CAST(p_partkey % 720 AS INTEGER)) AS t
          FROM part WHERE p_partkey % 40 = 0)"""


def _stored(spark, sf):
    hours = lambda c: F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(hours=c.cast("int"))
    k = F.col("o_orderkey")
    lists = V.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))).alias("item_ids"))
    rows = V.table(spark, sf, "orders").join(lists, "o_orderkey", "left").select(
        k.alias("result_key"), (F.col("o_custkey") % 300).cast("string").alias("user_id"),
        F.when(k % 3 == 0, "hybrid").when(k % 3 == 1, "content_based").otherwise("collaborative").alias("strategy"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        hours(k % 720).alias("computed_at"), hours(k % 720 + 700).alias("expires_at"))
    moved = V.table(spark, sf, "part").where("p_partkey % 40 = 0").select(
        F.col("p_partkey").cast("string").alias("item_id"), hours(F.col("p_partkey") % 720).alias("changed_at"))
    return rows, moved


@query("stale_results", sql=V.sql_with("interactions_v") + "," + STORED_SQL + f""",
seen AS (SELECT user_id, max(timestamp) AS t FROM interactions_v GROUP BY user_id),
item_at AS (SELECT result_key, max(moved.t) AS t FROM shown JOIN moved USING (item_id) GROUP BY result_key),
r AS (SELECT s.result_key, CASE WHEN expires_at <= TIMESTAMP '{NOW}' THEN 'expired'
        WHEN strategy IN ('hybrid', 'content_based') AND computed_at < TIMESTAMP '2024-01-04' THEN 'trained'
        WHEN strategy IN ('hybrid', 'collaborative') AND computed_at < TIMESTAMP '2024-01-08' THEN 'trained'
        WHEN seen.t > computed_at THEN 'interaction' WHEN item_at.t > computed_at THEN 'item' END AS reason
      FROM s LEFT JOIN seen ON seen.user_id = s.user_id LEFT JOIN item_at ON item_at.result_key = s.result_key)
SELECT * FROM r WHERE reason IS NOT NULL""")
def q_stale_results(spark, sf):
    """What expiry, two trainings, new interactions and item changes make stale."""
    rows, moved = _stored(spark, sf)
    trainings = spark.sql("SELECT 'content' AS model, TIMESTAMP_NTZ '2024-01-04' AS trained_at UNION ALL "
                          "SELECT 'collaborative', TIMESTAMP_NTZ '2024-01-08' UNION ALL SELECT 'content', TIMESTAMP_NTZ '2024-01-02'")
    return stored.stale(rows, F.lit(NOW).cast("timestamp_ntz"), interactions(spark, sf).select("user_id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp")),
                        moved, trainings)


@query("served_results", sql=STORED_SQL.replace("\ns AS", "WITH s AS", 1) + f""",
item_at AS (SELECT result_key, max(moved.t) AS t FROM shown JOIN moved USING (item_id) GROUP BY result_key),
f AS (SELECT s.result_key, expires_at > TIMESTAMP '{NOW}' AND NOT coalesce(item_at.t > computed_at, false) AS hit
      FROM s LEFT JOIN item_at ON item_at.result_key = s.result_key),
q AS (SELECT DISTINCT o_orderkey + 1 AS result_key FROM orders WHERE o_orderkey % 2 = 0)
SELECT q.result_key, coalesce(hit, false) AS hit,
  CASE WHEN hit THEN coalesce((SELECT count(*) FROM shown WHERE shown.result_key = q.result_key), 0) ELSE 1 END AS n_items
FROM q LEFT JOIN f ON f.result_key = q.result_key""")
def q_served(spark, sf):
    """Requests served from stored rows, the others computed (here: one item each)."""
    rows, moved = _stored(spark, sf)
    asked = V.table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(
        (F.col("o_orderkey") + 1).alias("result_key"), F.lit("u").alias("user_id"), F.lit("hybrid").alias("strategy"))
    answers, _ = stored.get_or_compute(
        asked, rows, lambda missing: missing.select("result_key", F.array(F.lit("new")).alias("item_ids")),
        F.lit(NOW).cast("timestamp_ntz"), changed_items=moved)
    return answers.select("result_key", "hit", F.size("item_ids").cast("long").alias("n_items"))
