"""Model and result stores (S12-S16, S19, P14, P15, U9, U10) as Parquet tables.

No pickles: a model is a folder of tables plus a one-row config table, so a
model written by one job is read by any other (and by any engine)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankfold import fixed
from rankfold.operators import collab as K
from rankfold.operators import content as C
from rankfold.operators.blend import Weights
from rankfold.sources.files import _exists


# --- S12: content model --------------------------------------------------------------

def save_content(model: C.ContentModel, path: str) -> None:
    spark = model.vectors.sparkSession
    p = path.rstrip("/")
    model.vocab.write.mode("overwrite").parquet(f"{p}/vocab")
    model.features.write.mode("overwrite").parquet(f"{p}/item_features")
    model.vectors.write.mode("overwrite").parquet(f"{p}/item_vectors")
    cfg = model.config
    conf = {"text_fields": cfg.text_fields, "categorical_fields": cfg.categorical_fields,
            "numerical_fields": cfg.numerical_fields, "max_features": cfg.max_features,
            "min_df": cfg.min_df, "ngram_range": [1, fixed.NGRAM_MAX], "stop_words": cfg.stop_words,
            "n_items": model.n_items, "n_dims": model.n_dims}
    spark.createDataFrame([(json.dumps(conf),)], "config string").coalesce(1) \
        .write.mode("overwrite").parquet(f"{p}/config")


def load_content(spark: SparkSession, path: str) -> C.ContentModel:
    p = path.rstrip("/")
    if not _exists(spark, f"{p}/config"):
        raise FileNotFoundError(f"Model file not found: {p}")
    conf = json.loads(spark.read.parquet(f"{p}/config").first()["config"])
    cfg = C.ContentConfig(conf["text_fields"], conf["categorical_fields"], conf["numerical_fields"],
                          conf["max_features"], conf["min_df"], conf["stop_words"])
    return C.ContentModel(cfg, spark.read.parquet(f"{p}/vocab"), spark.read.parquet(f"{p}/item_features"),
                          spark.read.parquet(f"{p}/item_vectors"), conf["n_items"], conf["n_dims"])


# --- S13: collaborative model ------------------------------------------------------------

def save_collab(model: K.CollabModel, path: str, n_iterations: int = fixed.N_ITERATIONS) -> None:
    spark = model.user_factors.sparkSession
    p = path.rstrip("/")
    model.user_factors.write.mode("overwrite").parquet(f"{p}/user_factors")
    model.item_factors.write.mode("overwrite").parquet(f"{p}/item_factors")
    info = dict(model.info, k=model.k, global_mean=model.global_mean, n_iterations=n_iterations)
    spark.createDataFrame([(json.dumps(info),)], "info string").coalesce(1) \
        .write.mode("overwrite").parquet(f"{p}/model_info")


def load_collab(spark: SparkSession, path: str) -> K.CollabModel:
    p = path.rstrip("/")
    if not _exists(spark, f"{p}/model_info"):
        raise FileNotFoundError(f"Model file not found: {p}")
    info = json.loads(spark.read.parquet(f"{p}/model_info").first()["info"])
    return K.CollabModel(spark.read.parquet(f"{p}/user_factors"), spark.read.parquet(f"{p}/item_factors"),
                         int(info["k"]), float(info["global_mean"]), info)


# --- S14: hybrid directory -------------------------------------------------------------------

def save_hybrid(directory: str, content: C.ContentModel | None, collab: K.CollabModel | None,
                weights: Weights = Weights()) -> None:
    """Both models and how they are blended (weights and cold-start threshold)."""
    d = directory.rstrip("/")
    spark = (content.vectors if content is not None else collab.user_factors).sparkSession
    if content is not None:
        save_content(content, f"{d}/content_model")
    if collab is not None:
        save_collab(collab, f"{d}/collaborative_model")
    conf = {**weights.config(), "is_content_trained": content is not None, "is_collaborative_trained": collab is not None}
    spark.createDataFrame([(json.dumps(conf),)], "config string").coalesce(1) \
        .write.mode("overwrite").parquet(f"{d}/hybrid_config")


def load_hybrid(spark: SparkSession, directory: str):
    """Returns (content model or None, collab model or None, config dict); missing parts are
    tolerated. ``Weights.of(config)`` are the weights to blend with."""
    d = directory.rstrip("/")
    conf = Weights().config()
    if _exists(spark, f"{d}/hybrid_config"):
        conf.update(json.loads(spark.read.parquet(f"{d}/hybrid_config").first()["config"]))
    content = load_content(spark, f"{d}/content_model") if _exists(spark, f"{d}/content_model/config") else None
    collab = load_collab(spark, f"{d}/collaborative_model") \
        if _exists(spark, f"{d}/collaborative_model/model_info") else None
    return content, collab, conf


# --- S15 / P14: recommendation log ---------------------------------------------------------

def log_rows(results: DataFrame, strategy: str, n_requested: int, model_version: str | None = None,
             experiment_id: str | None = None, processing_time_ms: float | None = None,
             created_at=None) -> DataFrame:
    """One log row per user request: the ranked item list (at most 100 ids, a
    bounded group) plus counts."""
    created = created_at if created_at is not None else F.current_timestamp().cast("timestamp_ntz")
    return (results.groupBy("user_id")
            .agg(F.sort_array(F.collect_list(F.struct("rank", "item_id"))).alias("r"))
            .select(F.substring(F.expr("uuid()"), 1, 8).alias("request_id"), "user_id",
                    F.lit(None).cast("string").alias("item_id"), F.lit(strategy).alias("strategy"),
                    F.lit(n_requested).alias("num_requested"), F.size("r").alias("num_returned"),
                    F.transform("r", lambda e: e["item_id"]).alias("recommended_items"),
                    F.lit(processing_time_ms).cast("double").alias("processing_time_ms"),
                    F.lit(model_version).cast("string").alias("model_version"),
                    F.lit(experiment_id).cast("string").alias("experiment_id"),
                    created.alias("created_at")))


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def history(logs: DataFrame, limit: int = 100) -> DataFrame:
    """P14 for every user: newest ``limit`` log rows."""
    w = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("request_id").desc())
    return logs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit)


# --- S16 / P15 / U9: model artifacts ----------------------------------------------------------

ARTIFACT_SCHEMA = ("model_name string, model_version string, model_type string, artifact_path string, "
                   "hyperparameters string, metrics string, item_count int, user_count int, "
                   "interaction_count int, is_active boolean, trained_at timestamp_ntz")


def save_artifact(spark: SparkSession, path: str, rows: list[tuple]) -> DataFrame:
    """Append artifact rows whose (name, version) is new; returns the rows written."""
    keys = ["model_name", "model_version"]
    new = spark.createDataFrame(rows, ARTIFACT_SCHEMA)
    if _exists(spark, path):
        # the clashing keys are at most len(rows): pull them, filter the literal rows
        old = spark.read.parquet(path).select(*keys)
        taken = {(r[0], r[1]) for r in old.join(new.select(*keys), keys, "left_semi").collect()}
        rows = [r for r in rows if (r[0], r[1]) not in taken]
        new = spark.createDataFrame(rows, ARTIFACT_SCHEMA)
    new.write.mode("append").parquet(path)
    return new


def active_model(artifacts: DataFrame, name: str) -> DataFrame:
    """P15."""
    return artifacts.where((F.col("model_name") == name) & F.col("is_active"))


# --- S19 / U10: stored recommendations with expiry --------------------------------------------

def store_results(results: DataFrame, key_cols: dict, ttl_s: int = fixed.RESULT_TTL_S) -> DataFrame:
    """Attach the request key (md5 of the sorted JSON arguments, 12 hex) and expiry."""
    args = json.dumps(key_cols, sort_keys=True)
    now = F.current_timestamp().cast("timestamp_ntz")
    return results.select("*", F.substring(F.md5(F.concat(F.col("user_id"), F.lit("|" + args))), 1, 12)
                          .alias("result_key"), now.alias("computed_at"),
                          (now + F.make_interval(secs=F.lit(ttl_s))).alias("expires_at"))


def valid_results(stored: DataFrame, now=None) -> DataFrame:
    now = now if now is not None else F.current_timestamp().cast("timestamp_ntz")
    return stored.where(F.col("expires_at") > now)


def misses(requests: DataFrame, stored: DataFrame, now=None) -> DataFrame:
    """Users whose results must be computed: no unexpired stored rows."""
    return requests.join(valid_results(stored, now).select("user_id").distinct(), "user_id", "left_anti")
