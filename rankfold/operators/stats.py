"""Statistics (A3-A9, A13-A16): single-pass aggregates with partial
(map-side) aggregation; grouping sets give totals and per-type counts in one
job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold import fixed


def counts_by(df: DataFrame, kind: str, col: str | None) -> DataFrame:
    """(kind, type, n): total (type null) and per value of ``col``;
    ROLLUP over one column = GROUPING SETS ((), (col))."""
    if col is None:
        return df.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("type"), "n")
    return (df.rollup(col).agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(kind).alias("kind"), F.col(col).cast("string").alias("type"), "n"))


def store_stats(items: DataFrame, users: DataFrame, interactions: DataFrame) -> DataFrame:
    """Three totals, items by type, interactions by type. Interactions of
    deleted items still count (they stay in the log)."""
    return (counts_by(items, "items", "item_type")
            .unionByName(counts_by(users, "users", None))
            .unionByName(counts_by(interactions, "interactions", "interaction_type")))


def interaction_stats(interactions: DataFrame, user_id: str | None = None,
                      item_id: str | None = None) -> DataFrame:
    """Total and by type, optionally for one user and/or item."""
    df = interactions
    if user_id is not None:
        df = df.where(F.col("user_id") == user_id)
    if item_id is not None:
        df = df.where(F.col("item_id") == item_id)
    return counts_by(df, "interactions", "interaction_type")


def strength_summary(strengths: DataFrame) -> DataFrame:
    """A8, A9, A13 in one aggregate over the long strength table."""
    return strengths.agg(
        F.countDistinct("user_id").alias("n_users"),
        F.countDistinct("item_id").alias("n_items"),
        F.count(F.lit(1)).alias("n_pairs"),
        F.sum(F.when(F.col("strength") > 0, 1).otherwise(0)).cast("long").alias("n_positive"),
        F.coalesce(F.avg(F.when(F.col("strength") > 0, F.col("strength"))), F.lit(0.0)).alias("global_mean"),
    ).select("*", (F.lit(1.0) - F.col("n_positive") / (F.col("n_users") * F.col("n_items")))
             .alias("sparsity"))


def request_counters(requests: DataFrame) -> DataFrame:
    """Request counts by endpoint, method (where the log has it) and status."""
    keys = [c for c in ("endpoint", "method", "status") if c in requests.columns]
    return requests.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def training_counters(runs: DataFrame) -> DataFrame:
    """Training runs by model type and status."""
    return runs.groupBy("model_type", "status").agg(F.count(F.lit(1)).alias("n"))


def interaction_count(interactions: DataFrame, keys: list[str]) -> DataFrame:
    """A5: interactions per user, item or both."""
    return interactions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def latency_histogram(requests: DataFrame, ms_col: str = "processing_time_ms") -> DataFrame:
    """Cumulative bucket counts (le in seconds), +Inf, sum and count --
    one aggregate, one row per bucket after a stack."""
    sec = F.col(ms_col) / F.lit(1000.0)
    aggs = [F.sum(F.when(sec <= F.lit(b), 1).otherwise(0)).cast("long").alias(f"b{i}")
            for i, b in enumerate(fixed.LATENCY_BUCKETS_S)]
    aggs += [F.count(F.lit(1)).alias("count"), F.sum(sec).alias("sum")]
    row = requests.agg(*aggs)
    stack = ", ".join([f"'{b}', b{i}" for i, b in enumerate(fixed.LATENCY_BUCKETS_S)] + ["'+Inf', count"])
    return row.selectExpr(f"stack({len(fixed.LATENCY_BUCKETS_S) + 1}, {stack}) AS (le, n)",
                          "count AS total", "sum AS sum_s")
