"""Recommender views over the driver's test tables.

The driver tables carry no recommender schema; these fixed mappings turn them
into items, users and an interaction log (see FIXTURES.md section 3). Every
view is a lazy DataFrame over the parquet scan, so filters and column
selections downstream reach the scan.

The same mappings exist as SQL text (``SQL_VIEWS``) for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold.functions.scalar import map_values


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# FIXED VALUES: part type -> item type, event type -> interaction type
PART_TYPE_TO_ITEM_TYPE = {"ECONOMY": "movie", "MEDIUM": "book", "PROMO": "song", "SMALL": "course"}
PART_TYPE_DEFAULT = "product"
SIGNUP_TYPES = {0: "like", 1: "dislike", 2: "bookmark"}
LANG_TO_ITEM_TYPE = {"en": "book", "fr": "movie", "de": "song", "es": "course"}
BASE_EPOCH_S = 1704067200  # 2024-01-01 00:00:00 UTC


def items_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items from ``part``: one item per part; features and metadata as JSON text."""
    p = table(spark, sf_dir, "part")
    year = (F.lit(2000) + F.pmod(F.col("p_size"), F.lit(25))).cast("int")
    rating = F.col("p_size").cast("double") / F.lit(10.0).cast("double")
    return p.select(
        F.col("p_partkey").cast("string").alias("item_id"),
        F.col("p_name").alias("title"),
        map_values(F.col("p_type"), PART_TYPE_TO_ITEM_TYPE, PART_TYPE_DEFAULT).alias("item_type"),
        F.concat(F.col("p_name"), F.lit(" "), F.lower("p_type")).alias("description"),
        F.col("p_brand").alias("category"),
        year.alias("year"),
        rating.alias("rating"),
        F.to_json(F.struct(F.col("p_brand").alias("category"), year.alias("year"),
                           rating.alias("rating"))).alias("features"),
        F.to_json(F.struct(F.col("p_brand").alias("brand"))).alias("metadata"),
        F.timestamp_seconds(F.lit(BASE_EPOCH_S) + F.col("p_partkey")).cast("timestamp_ntz")
         .alias("created_at"),
    )


def doc_items_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text-heavy second item table from ``documents``."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("item_id"),
        F.col("source").alias("title"),
        map_values(F.col("lang"), LANG_TO_ITEM_TYPE, PART_TYPE_DEFAULT).alias("item_type"),
        F.col("text").alias("description"),
        F.col("source").alias("category"),
    )


def users_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").cast("string").alias("user_id"),
        F.to_json(F.struct(F.col("c_mktsegment").alias("segment"))).alias("preferences"),
    )


def _interaction_type(event_type: Column, event_id: Column) -> Column:
    signup = F.when(F.pmod(event_id, F.lit(3)) == 0, SIGNUP_TYPES[0]) \
              .when(F.pmod(event_id, F.lit(3)) == 1, SIGNUP_TYPES[1]) \
              .otherwise(SIGNUP_TYPES[2])
    return (F.when(event_type == "signup", signup)
             .when(event_type == "error", F.lit("rating"))
             .otherwise(event_type))


def interactions_raw_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw interaction log from ``events`` (arrival order = ``seq``)."""
    return interactions_from_events(table(spark, sf_dir, "events"))


def interactions_from_events(e: DataFrame) -> DataFrame:
    """The interaction mapping over any events DataFrame (batch or stream)."""
    return e.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").cast("string").alias("user_id"),
        F.regexp_extract("props", "[0-9]+", 0).alias("item_id"),
        _interaction_type(F.col("event_type"), F.col("event_id")).alias("interaction_type"),
        F.when(F.col("event_type") == "error",
               F.col("value") / F.lit(10).cast("double")).alias("value"),
        F.col("ts").alias("timestamp"),
    )


def requests_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request log from ``events``: one request per event.

    client = user id, endpoint = event type, processing_time_ms = value * 10,
    status 500 for error events else 200.
    """
    return requests_from_events(table(spark, sf_dir, "events"))


def requests_from_events(e: DataFrame) -> DataFrame:
    return e.select(
        F.col("event_id").alias("request_id"),
        F.col("user_id").cast("string").alias("client_id"),
        F.col("ts").alias("ts"),
        F.col("event_type").alias("endpoint"),
        F.when(F.col("event_type") == "error", F.lit(500)).otherwise(F.lit(200)).alias("status"),
        (F.col("value") * F.lit(10).cast("double")).alias("processing_time_ms"),
    )


# --- the same mappings in SQL, for the DuckDB oracle --------------------------
SQL_VIEWS = {
    "items_v": """
SELECT CAST(p_partkey AS STRING) AS item_id, p_name AS title,
       CASE p_type WHEN 'ECONOMY' THEN 'movie' WHEN 'MEDIUM' THEN 'book' WHEN 'PROMO' THEN 'song'
                   WHEN 'SMALL' THEN 'course' ELSE 'product' END AS item_type,
       concat(p_name, ' ', lower(p_type)) AS description, p_brand AS category,
       CAST(2000 + p_size % 25 AS INTEGER) AS year, p_size / CAST(10 AS DOUBLE) AS rating,
       p_partkey AS seq
FROM part""",
    "doc_items_v": """
SELECT CAST(doc_id AS STRING) AS item_id, source AS title,
       CASE lang WHEN 'en' THEN 'book' WHEN 'fr' THEN 'movie' WHEN 'de' THEN 'song'
                 WHEN 'es' THEN 'course' ELSE 'product' END AS item_type,
       text AS description, source AS category
FROM documents""",
    "users_v": """
SELECT CAST(c_custkey AS STRING) AS user_id FROM customer""",
    "interactions_raw_v": """
SELECT event_id AS seq, CAST(user_id AS STRING) AS user_id,
       regexp_extract(props, '[0-9]+', 0) AS item_id,
       CASE event_type WHEN 'signup' THEN CASE event_id % 3 WHEN 0 THEN 'like' WHEN 1 THEN 'dislike' ELSE 'bookmark' END
                       WHEN 'error' THEN 'rating' ELSE event_type END AS interaction_type,
       CASE WHEN event_type = 'error' THEN value / CAST(10 AS DOUBLE) END AS value,
       ts AS timestamp
FROM events""",
    "interactions_v": """
SELECT * FROM interactions_raw_v
WHERE length(user_id) BETWEEN 1 AND 100 AND length(item_id) BETWEEN 1 AND 100
  AND interaction_type IN ('view','click','like','dislike','purchase','rating','bookmark')
  AND (value IS NULL OR (value >= 0 AND value <= 10))
  AND NOT (interaction_type = 'rating' AND value IS NULL)""",
    "requests_v": """
SELECT event_id AS request_id, CAST(user_id AS STRING) AS client_id, ts, event_type AS endpoint,
       CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
       value * CAST(10 AS DOUBLE) AS processing_time_ms
FROM events""",
}


def sql_with(*names: str) -> str:
    """A WITH clause defining the named views (dependencies first)."""
    order = list(SQL_VIEWS)
    need = set(names)
    if "interactions_v" in need:
        need.add("interactions_raw_v")
    parts = [f"{n} AS ({SQL_VIEWS[n]}\n)" for n in order if n in need]
    return "WITH " + ",\n".join(parts) + "\n"
